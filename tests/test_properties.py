"""Properties, skew, plan shape, sources and sinks."""

import uuid

import pytest
from pyspark.sql import functions as F

from jobweave import rules
from jobweave.functions import skills
from jobweave.functions import text as tx
from jobweave.operators import cleaning as C
from jobweave.operators import gold as G
from jobweave.operators import matching as MT
from jobweave.operators import quantiles as Q
from jobweave.plans import silver as P
from jobweave.plans import warehouse as W
from jobweave.sources import derived as D
from jobweave.sources import readers, writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_idempotent(spark, sf):
    raw = D.raw_jobs(spark, sf)
    for fn, col in ((tx.clean_text_field, "company_name"), (tx.clean_company_name, "company_name"), (tx.remove_html_tags, "job_description"),
                    (lambda c: skills.normalize_skill(F.col(c) if isinstance(c, str) else c), "skills_required")):
        once = raw.select(fn(col).alias("a"))
        assert once.where(F.col("a") != fn("a")).count() == 0


def test_silver_properties(spark, sf):
    s = P.to_silver(D.raw_jobs(spark, sf), W.OPTIONS)
    assert s.groupBy("url").count().where("count > 1").count() == 0
    assert s.where("salary_min_usd > salary_max_usd OR salary_min_usd < 50").count() == 0
    assert s.columns == [c for c in __import__("jobweave.schema", fromlist=["x"]).SILVER_COLUMNS]


def test_skill_extraction_equals_patterns(spark, sf):
    df = D.raw_jobs(spark, sf).select(F.concat_ws(" ", "job_title", "skills_required", "job_description").alias("t")).distinct()
    extra = spark.createDataFrame([("sqlà C++/C# node.js, R&D",), ("machine-learning; power  bi",), ("go golang GO!",)], "t string")
    df = df.unionByName(extra)
    same = skills.extract_skills("t").eqNullSafe(skills.extract_skills_regex("t"))
    assert df.where(~same).count() == 0


def test_exact_quantiles_with_hot_group(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"),
                                   (F.xxhash64("id") / 1e12).alias("v"))
    got = {r["g"]: (r["q50"], r["q99"]) for r in Q.exact_quantiles(df, ["g"], "v", [0.5, 0.99]).collect()}
    want = {r["g"]: (r["a"], r["b"]) for r in df.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("a"), F.percentile("v", F.lit(0.99)).alias("b")).collect()}
    assert got.keys() == want.keys()
    for g in got:
        assert got[g] == pytest.approx(want[g], rel=1e-9)


def test_keep_first_limits_groups_before_the_shuffle(spark, sf):
    text = plan(C.keep_first(D.raw_jobs(spark, sf), ["source_website"], ["ingest_seq"]))
    assert text.count("WindowGroupLimit") == 2


def test_step_statistics_in_one_pass(spark, sf):
    """Equal to counting every stage, ties, repeated rows, NULLs and an empty table included; the input is read once."""
    raw = D.raw_jobs(spark, sf)
    text = plan(P.step_statistics(raw, W.OPTIONS))
    assert text.count("Location: ") <= 2 * plan(raw).count("Location: ") and text.count("orders.parquet") == plan(raw).count("orders.parquet")
    assert "job_description" not in text and "Window" not in text
    odd = raw.where("ingest_seq < 150").unionByName(raw.where("ingest_seq < 150")).unionByName(raw.where("ingest_seq < 20").withColumns({"url": F.lit(None).cast("string")})).unionByName(
        raw.where("ingest_seq < 30").withColumns({"url": F.lit("http://same"), "company_name": F.lit(None).cast("string")}))
    for df, opt in ((raw, W.OPTIONS), (odd, P.Options(unique=None)), (raw.where("false"), W.OPTIONS),
                    (raw, P.Options(as_of=W.OPTIONS.as_of, analysis_start="1996-01-01", analysis_end="1997-01-01", in_period_only=True))):
        got = [tuple(r) for r in P.step_statistics(df, opt).orderBy("step_no").collect()]
        assert got == [tuple(r) for r in C.step_counts(P.stages(df, opt)).orderBy("step_no").collect()]


def test_survivors_by_id(spark, sf):
    """The three forms keep the same rows; elected by id, no text but the keys is shuffled before the survivors are known."""
    raw = D.raw_jobs(spark, sf)
    forms = [C.remove_duplicates(raw, **how) for how in ({}, {"unique": "ingest_seq"}, {"unique": "ingest_seq", "elect_by_id": True})]
    ids = [sorted(r.ingest_seq for r in f.select("ingest_seq").collect()) for f in forms]
    assert ids[0] == ids[1] == ids[2] and len(ids[0]) < raw.count()
    assert "job_description" not in plan(forms[1].select("ingest_seq", "url"))
    text = forms[2]._jdf.queryExecution().optimizedPlan().toString()
    right = text[text.index("+- Project [ingest_seq"):] if "+- Project [ingest_seq" in text else text.split("LeftSemi", 1)[1]
    assert right.count("Window [") == 2 and "benefits" not in right
    same = spark.createDataFrame([(1, "http://a", "t", "c"), (2, "http://a", "t", "c")], "id int, url string, job_title string, company_name string")
    assert [r.id for r in C.remove_duplicates(same, [], "id", True).collect()] == [1]
    with pytest.raises(ValueError):
        C.remove_duplicates(same, elect_by_id=True)


def test_filters_reach_the_scan(spark, sf):
    df = G.apply_filters(D.table(spark, sf, "orders").withColumn("city", F.col("o_orderstatus")), G.FilterSpec(cities=["F"]))
    text = plan(df.select("o_orderkey", "city"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in text
    assert "o_totalprice" not in text


def test_no_cross_products_and_no_python(spark, sf):
    import __spark_entry__ as entry

    for name in ("g1_overview_kpis", "g13_skill_by_role", "k5_corpus_keywords", "l8_match_scores", "l13_top_postings"):
        text = plan(entry.queries()[name](spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text


def test_filter_keeps_rows_without_salary(rows):
    df = rows("id int, salary_midpoint_usd double", [(1, None), (2, 500.0), (3, 5000.0)])
    assert [r["id"] for r in G.apply_filters(df, G.FilterSpec(salary_range=(0, 1000))).orderBy("id").collect()] == [1, 2]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "itboard_jobs_2026_05_14.jsonl"
    p.write_text('{"job_id":"1","skills_required":["a","b"]}\n\n{bad\n{"job_id":"2","skills_required":"x, y"}\n', encoding="utf-8")
    df = readers.read_postings(spark, str(p))
    got = {r["job_id"]: (r["skills_required"], r["file_source"], str(r["crawl_date"])) for r in df.collect()}
    assert got == {"1": ('["a","b"]', "itboard", "2026-05-14"), "2": ("x, y", "itboard", "2026-05-14")}
    kept = readers.read_postings(spark, str(p), keep_rejected=True).select("job_id", "_corrupt_record").collect()
    assert [r["_corrupt_record"] for r in kept if r["_corrupt_record"]] == ["{bad"]
    assert [tuple(r) for r in readers.raw_line_counts(spark, str(p)).collect()] == [("itboard", 3)]
    assert writers.dated_name("itboard", "2026-05-14") == p.name


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc'), (2, "ế")], "id int, t string")
    out = str(tmp_path / "c")
    writers.write_csv(df, out)
    head = next((tmp_path / "c").glob("part*")).read_bytes()[:3]
    assert head == b"\xef\xbb\xbf"
    assert sorted(tuple(r) for r in readers.read_csv(spark, out, "id int, t string").collect()) == [(1, 'a,"b"\nc'), (2, "ế")]


def test_csv_in_parts(spark, tmp_path, monkeypatch):
    """Files end at the record limit, each with its header; without line breaks a file is split over tasks."""
    monkeypatch.setattr(writers, "MAX_RECORDS_PER_FILE", 1000)
    out = str(tmp_path / "c")
    writers.write_csv(spark.range(0, 5000, 1, 2).selectExpr("id", "concat('ế, ', id) AS t"), out)
    assert len(list((tmp_path / "c").glob("part*"))) == 6
    whole, split = readers.read_csv(spark, out, "id long, t string"), readers.read_csv(spark, out, "id long, t string", False)
    want = [(i, f"ế, {i}") for i in range(5000)]
    assert sorted(tuple(r) for r in whole.collect()) == want == sorted(tuple(r) for r in split.collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        tasks = lambda df: df.select(F.spark_partition_id().alias("p"), "id").groupBy("p").count().count()
        assert tasks(readers.read_csv(spark, out, "id long, t string", False)) > tasks(readers.read_csv(spark, out, "id long, t string"))
        assert sorted(tuple(r) for r in readers.read_csv(spark, out, "id long, t string", False).collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_resume_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿kỹ năng".encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("café".encode("latin-1"))
    page = bytes(b for b in range(32, 256) if bytes([b]).decode("cp1258", "ignore"))
    (tmp_path / "c.txt").write_bytes(page)
    (tmp_path / "d.txt").write_bytes(page + b"\x81")
    (tmp_path / "e.txt").write_bytes(b"")
    got = dict(tuple(r) for r in readers.read_resumes(spark, str(tmp_path)).collect())
    assert got == {"a.txt": "kỹ năng", "b.txt": "café", "c.txt": page.decode("cp1258"), "d.txt": (page + b"\x81").decode("latin-1")}


def test_dated_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "topcv", "2026-03-24"), (2, "it_jobs_viec", "2026-03-25"), (3, None, "2026-03-25")],
                                 "n int, source_website string, day string").selectExpr("n", "source_website", "date(day) AS crawl_date")
    writers.write_dated(rows, str(tmp_path / "x"))
    df = readers.read_dated(spark, str(tmp_path / "x"), "n int, file string")
    assert sorted((r.n, r.file_source, str(r.crawl_date)) for r in df.where("file IS NOT NULL").collect()) == [
        (1, "topcv", "2026-03-24"), (2, "it_jobs_viec", "2026-03-25")]
    assert [tuple(r) for r in df.where("file IS NULL").select("n", "file_source", "crawl_date").collect()] == [(3, None, None)]
    assert "PartitionFilters: [isnotnull(file" in df.where("file = 'topcv_jobs_2026_03_24'")._jdf.queryExecution().toString()


def test_run_writes_all_tables(spark, sf, tmp_path):
    paths = P.run(spark, D.raw_jobs(spark, sf), str(tmp_path / "p"), str(tmp_path / "c"), W.OPTIONS)
    silver = spark.read.parquet(paths["processed_parquet"])
    assert silver.count() == P.to_silver(D.raw_jobs(spark, sf), W.OPTIONS).count()
    assert spark.read.parquet(paths["cleaned_parquet"]).where("trim(company_name) = ''").count() == 0


def test_empty_input_is_an_error(spark, sf, tmp_path):
    with pytest.raises(ValueError):
        P.run(spark, D.raw_jobs(spark, sf).where("false"), str(tmp_path / uuid.uuid4().hex), str(tmp_path / "x"), W.OPTIONS)


def test_rules_are_consistent():
    assert set(rules.SKILL_LIST_ALIASES) == {k.lower() for k in rules.SKILL_LIST_ALIASES}


def test_bad_dates_do_not_end_the_job(spark):
    from jobweave.operators.normalize import normalize_dates
    df = spark.createDataFrame([("not a date", "999999999 months ago", None), ("2026-01-05", "3 days ago", None)],
                               "crawled_at string, posted_date string, expiry_date string")
    got = normalize_dates(df, as_of="2026-02-01").collect()
    assert len(got) == 2


def test_repeated_details_keep_one_posting(spark):
    from jobweave.operators import ingest
    card = spark.createDataFrame([("u", "a")], "url string, job_title string")
    detail = spark.createDataFrame([("u", "old", "2026-01-01"), ("u", "new", "2026-01-02")],
                                   "url string, job_title string, crawled_at string")
    assert [r.job_title for r in ingest.overlay(card, detail).collect()] == ["new"]


def test_bare_less_than_and_blank_titles(spark):
    from jobweave.functions import text
    from jobweave.operators.cleaning import drop_missing_titles
    df = spark.createDataFrame([("lương < 10 triệu, kinh nghiệm > 2 năm <b>SQL</b>",), ("\t ",)], "t string")
    got = drop_missing_titles(df, "t").select(text.strip_html("t").alias("x")).collect()
    assert [r.x for r in got] == ["lương < 10 triệu, kinh nghiệm > 2 năm SQL"]


def test_no_cap_on_skills_or_on_the_relevant_part(spark):
    from jobweave.functions import skills
    from jobweave.operators import ingest
    df = spark.createDataFrame([("x", "y " * 400 + "python sql data engineer", ["s%d" % k for k in range(60)])],
                               "job_title string, job_description string, s array<string>")
    row = df.select(ingest.is_relevant().alias("r"), skills.normalize_skills("s").alias("s")).first()
    assert row.r and len(row.s) == 60


def test_html_references_in_one_pass(rows):
    from jobweave.functions.text import strip_html

    cases = {"<b>Caf&eacute;</b> &#233;&#xE9;": "Café éé", "&amp;lt;": "&lt;", "&lt;b&gt;": "<b>", "a &nope; b & c": "a &nope; b & c",
             "&#0;&#x110000;&#xDFFF;": "\ufffd\ufffd\ufffd", "x&nbsp;&nbsp;y": "x y", "&ndash": "&ndash", "": "", "lương < 10 <i>SQL</i>": "lương < 10 SQL"}
    got = rows("k string, v string", list(cases.items())).select("v", strip_html("k").alias("got")).collect()
    assert all(r.v == r.got for r in got), got


def test_lists_have_no_cap(rows):
    from jobweave import rules
    from jobweave.functions import skills
    from jobweave.operators import matching

    names = list(dict.fromkeys(s for g in rules.SKILL_TAXONOMY.values() for s in g if len(s) > 1))
    title = "Analyst (" + "/".join(f"tool{k:02d}" for k in range(30)) + ")"
    row = rows("t string, d string", [(title, ", ".join(names))]).select(skills.taxonomy_scan("t", "d").alias("f")).first()
    assert set(row.f) >= {f"tool{k:02d}" for k in range(30)} and len(row.f) > 40
    short = rows("t string", [("Analyst (R/C; SQL)",)])
    assert set(short.select(skills.taxonomy_scan("t").alias("f")).first().f) >= {"R", "C", "SQL"}
    assert not {"R", "C"} & set(short.select(skills.taxonomy_scan("t", min_length=2).alias("f")).first().f)
    text = "\n".join(f"line {k}" for k in range(40))
    assert matching.with_sections(rows("text string", [(text,)])).first().summary == text
    asked = [f"s{k}" for k in range(30)]
    assert len(rows("m array<string>", [(asked,)]).select(matching.recommendations("m").alias("r")).first().r) == 30
    assert rows("s string", [("C#, Go, R, " + "x" * 60,)]).select(skills.dashboard_skills("s").alias("f")).first().f == ["c#", "go", "r", "x" * 60]


def test_equal_skill_keys_count_once(rows):
    from jobweave.operators.matching import with_skill_overlap

    df = rows("r array<string>, j array<string>", [(["Node.js"], ["Node.js", "Node js", "SQL"]), ([], []), (None, ["SQL"])])
    got = with_skill_overlap(df, "r", "j").select("skill_overlap", "missing_skills").collect()
    assert got[0].skill_overlap == 0.5 and got[0].missing_skills == ["SQL"] and got[1].skill_overlap == 0.0


def test_api_records_under_older_names(rows):
    from jobweave.operators.extract import posting_from_api

    old = '{"title":"Data Engineer","company_name":"ACME","canonical":"/a?x=1","skills":["Python",{"skillName":"SQL"},7],"benefits":["Gym"],"salaryMin":20000000}'
    got = posting_from_api(rows("id int, record string", [(1, old), (2, "not json"), (3, None), (4, "{}")]), base_url="https://x.org").collect()
    assert [r.id for r in got] == [1]
    assert got[0].url == "https://x.org/a" and got[0].skills_required == ["Python", "SQL"] and got[0].benefits == "Gym"
    assert got[0].salary_min == 20000000.0 and got[0].salary_currency == "USD" and got[0].location == ""


def test_every_named_html_reference(rows):
    from html import unescape

    from jobweave.functions.text import NAMED_ENTITIES, decode_entities

    df = rows("k string", [(name,) for name in NAMED_ENTITIES] + [("&nope;",), ("&Amp;",)])
    got = {r.k: r.v for r in df.select("k", decode_entities("k").alias("v")).collect()}
    assert got == {k: unescape(k).replace("\xa0", " ") for k in got} and len(got) > 2000
    text = df.select(decode_entities("k").alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in text                          # done once, while the plan was made


def test_a_page_is_parsed_once(rows):
    from jobweave.operators import extract as X

    page = '<script type="application/ld+json">{"@type":"JobPosting","title":"%s"}</script>'
    df = rows("url string, html string, ld string", [("a", page % "x", "old"), ("b", "<p>none</p>", None), ("c", None, None)])
    out = X.with_json_ld(df)
    assert [(r.url, r.title) for r in out.select("url", F.try_variant_get("ld", "$.title", "string").alias("title")).collect()] == [("a", "x")]
    for posting in (X.posting_from_ld_a, X.posting_from_ld_b):
        text = posting(out)._jdf.queryExecution().optimizedPlan().toString()
        assert text.lower().count("regexp_extract_all(coalesce(html") == 1, text
