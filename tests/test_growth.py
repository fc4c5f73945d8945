"""Steps whose work must not grow faster than their input: done once a document, once a pair, in tasks of bounded rows."""

import re

import pytest
from pyspark.sql import functions as F

from jobweave import rules
from jobweave.functions import dates, skills
from jobweave.functions.common import alternation, text
from jobweave.operators import extract as X
from jobweave.operators import keywords as KW
from jobweave.operators import matching as MT
from jobweave.sources import derived as D


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


TEXTS = ["", None, "C++ and C# +x #y a+b a+ b", "Café été naïve x1 1x 9to5", "see http://a.b/c?d=e data http", "HTTPS://X.y  Über-Straße\tœuvre",
         "Power BI, power-bi node.js Node JS ci/cd R", "năm kinh nghiệm python3 pythoné éSQL sql"]


def test_words_are_cut_as_from_cleaned_text(rows):
    df = rows("t string", [(t,) for t in TEXTS])
    cleaned = F.filter(F.regexp_extract_all(KW.clean_keyword_text("t"), F.lit(KW.TOKEN), F.lit(0)), lambda t: ~t.isin(*KW.STOP_WORDS))
    got = df.select("t", KW.tokens("t").alias("a"), cleaned.alias("b"), skills.extract_skills("t").alias("c"), skills.extract_skills_regex("t").alias("d"))
    assert [r for r in got.collect() if r.a != r.b or r.c != r.d] == []
    # one pattern over the text, no replacement of each separator
    assert "[^a-z0-9+#" not in plan(df.select(KW.tokens("t"))) and plan(df.select(skills.extract_skills("t"))).count("regexp_replace") == 0


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("few", [0, 10_000])
def test_rare_runs_of_words_are_left_out_of_the_count(spark, monkeypatch, by, few):
    monkeypatch.setattr(KW, "FEW_WORDS", few)
    word = lambda p, m: F.concat(F.lit(p), F.pmod(F.xxhash64("id", F.lit(p)), F.lit(m)))
    df = spark.range(900).select(F.col("id").alias("doc"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 > 0, F.concat_ws(
        " ", F.lit("data team data"), word("alpha", 3), word("beta", 9), word("gamma", 700))).alias("t"))
    every = KW.with_terms(df, "t", 2, [*by, "doc"])
    some = KW._candidate_terms(df, "t", "doc", by, 12, 2, 2)
    want, got = ({tuple(r) for r in KW.vocabulary(x, by, 12, 2).collect()} for x in (every, some))
    assert got == want and some.count() == every.count()
    counts = [x.agg(F.sum(F.size("terms"))).first()[0] for x in (some, every)]
    assert counts[0] < counts[1] if few else counts[0] == counts[1]


def matched(rows):
    r = rows("resume_id long, skills array<string>, years double, terms array<string>", [(1, ["SQL", " sql", "C++"], 2.0, ["a", "b"]), (2, None, None, None)])
    j = rows("job_id long, skills array<string>, years double, terms array<string>", [(1, ["sql", "Java"], 3.0, ["b", "c"]), (2, [], None, [])])
    pairs = rows("resume_id long, job_id long", [(1, 1), (1, 2), (2, 1), (2, 2), (None, 1), (1, 1)])
    return MT.match_pairs(pairs, r, j)


def test_normal_forms_of_skills_are_found_before_the_pairs_meet(rows):
    got = plan(matched(rows).select("resume_id", "job_id", "skill_score"))
    assert "regexp_replace" in got and "regexp_replace" not in got[:got.index("Join")]
    assert sorted((r.resume_id, r.job_id, r.matched_skills, r.missing_skills) for r in matched(rows).where("job_id = 1 and resume_id is not null").collect()) == [
        (1, 1, ["sql"], ["Java"]), (1, 1, ["sql"], ["Java"]), (2, 1, [], [])]


def test_a_report_scores_its_pairs_once(rows):
    report = MT.full_report(matched(rows))
    assert "Join" not in plan(report)
    keep = report.columns
    frames = [f(matched(rows)) for f in (MT.summary_frame, MT.skills_frame, MT.keywords_frame, MT.recommendations_frame)]
    assert report.count() == sum(f.count() for f in frames) and report.where("section = 'skills'").count() == frames[1].count()
    assert "section" in keep and "size(" not in plan(frames[2])[:plan(frames[2]).index("Generate")]


def test_a_record_is_parsed_once(rows):
    df = rows("id long, record string", [(1, '{"jobTitle": " A ", "companyName": "x"}'), (2, "no json"), (3, None), (4, '{"title": ""}'), (5, '{"title": "B"}')])
    out = X.posting_from_api(df)
    assert len(re.findall("(?i)parse_?json", plan(out))) == 1
    assert [(r.id, r.job_title, r.company_name) for r in out.orderBy("id").collect()] == [(1, "A", "x"), (5, "B", "")]


def old_relative(c, reference):
    t = text(c)
    word = lambda words: rf"(?iuU)\b(?:{alternation(words)})\b"
    out = F.when(t.rlike(word(rules.TODAY_WORDS)), reference).when(t.rlike(word(rules.YESTERDAY_WORDS)), F.date_sub(reference, 1))
    for pattern, days in rules.RELATIVE_DATE_RULES:
        n = F.regexp_extract(t, pattern, 1).try_cast("int")
        n = F.when(n <= dates.DAYS_OF_ERA // max(days, 1), n)
        out = out.when(n.isNotNull(), F.date_sub(reference, n * days))
    return out


def test_relative_dates_are_sought_only_where_their_words_are(rows):
    data = ["", None, "3 days ago", "3 DAYS AGO", "2 tuần trước", "2 TUẦN TRƯỚC", "juſt now", "JUST NOW", "todays", "Hôm Qua", "yeſterday", "5 hours ago, 2 days ago",
            "99999999999 days ago", "800000 days ago 4 weeks ago", "4 mİnutes ago", "4 minutes ago", "soon", "ago", "1 month ago", "x7ngày trước", "hôm nay 3 days ago"]
    df = rows("t string", [(t,) for t in data]).withColumn("r", F.when(F.col("t") != "1 month ago", F.to_date(F.lit("2001-08-02"))))
    got = df.select("t", dates.parse_relative_date("t", F.col("r")).alias("a"), old_relative("t", F.col("r")).alias("b")).collect()
    assert [r for r in got if r.a != r.b] == [] and sum(r.a is not None for r in got) >= 13
    # a text without such a word reaches no pattern: the patterns lie behind the test for the word
    absolute = rows("t string", [(t,) for t in ("2001-8-2", " 02/08/2001 ", "2 Aug 2001", "August 2, 2001", "2001-08-02T10:00:00Z", "soon", "", None, "x2001")])
    assert [str(r[0]) for r in absolute.select(dates.parse_absolute_date("t")).collect()] == ["2001-08-02"] * 5 + ["None"] * 4


def test_tasks_hold_a_bounded_number_of_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(D, "TASK_ROWS", 50)
    orders, events = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("orders", "events"))
    assert D.raw_jobs(spark, sf).rdd.getNumPartitions() == -(-orders // 50) > 8
    assert D.events(spark, sf).rdd.getNumPartitions() == -(-events // 50) > 8
