"""Grouped vocabularies against groups taken one by one; names in texts against one pattern a name."""

import re

import pytest
from pyspark.sql import functions as F

from jobweave import rules
from jobweave.functions import skills
from jobweave.operators import keywords as KW

NAMES = list(dict.fromkeys(s for g in rules.SKILL_TAXONOMY.values() for s in g))


@pytest.fixture(scope="module")
def grouped(spark):
    """A group with a third of all texts, many of a few texts, NULL groups, blank and NULL texts."""
    g = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 != 1, F.concat(F.lit("g"), F.col("id") % 1500))
    body = F.concat_ws(" ", F.lit("data team"), *[F.concat(F.lit(p), F.pmod(F.xxhash64("id", F.lit(p)), F.lit(m)))
                                                  for p, m in (("alpha", 5), ("beta", 11), ("gamma", 400))])
    body = F.when(F.col("id") % 40 == 7, F.lit(" ")).when(F.col("id") % 41 != 8, body)
    return spark.range(6000).select(F.col("id").alias("doc"), g.alias("g"), body.alias("text")).cache()


def test_groups_equal_groups_taken_one_by_one(grouped):
    fit = dict(max_features=20, min_df=1)
    every = KW.corpus_keywords(grouped, "text", "doc", ["g"], 8, **fit).collect()
    assert len({r.g for r in every}) > 900 and None not in {r.g for r in every}
    for name in ("hot", "g2", "g500"):
        want = KW.corpus_keywords(grouped.where(F.col("g") == name), "text", "doc", (), 8, **fit).collect()
        got = {r.keyword: r.score for r in every if r.g == name}
        assert got == pytest.approx({r.keyword: r.score for r in want}) and len(got) > 3


def test_large_groups_are_bounded(grouped, rows):
    assert KW.large_groups(grouped, ["g"], parts=100).collect() == [("hot",)]
    assert KW.large_groups(grouped.where("g <> 'hot'"), ["g"], parts=10).count() == 0
    even = grouped.where("g is not null").select("g").distinct()
    assert KW.large_groups(even.limit(50), ["g"], parts=50).count() == 50
    assert KW.large_groups(rows("g string", []), ["g"]).count() == 0
    assert KW.large_groups(rows("g string, h int", [("a", 1), ("a", None), (None, 1)]), ["g", "h"]).collect() == [("a", 1)]


def test_terms_of_large_groups_are_not_shuffled(spark, grouped, monkeypatch):
    monkeypatch.setattr(KW, "LARGE_PARTS", 100)
    df = grouped.where("g is not null")
    vocab = KW.written(KW.vocabulary(KW.with_terms(df, "text", 2, ["g", "doc"]), ["g"], 20, 1), "test")
    hits = KW._grouped_hits(df, "text", "doc", ["g"], 2, vocab)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    large = plan[plan.index("Union"):].split("LeftAnti")[0]
    terms = [line for line in large.splitlines() if "Exchange hashpartitioning" in line and "term" in line and "tf" in line]
    assert not terms and "BroadcastHashJoin" in large and "NestedLoop" not in plan, large
    by_group = {r.g: r.n for r in hits.groupBy("g").agg(F.countDistinct("doc").alias("n")).collect()}
    full = df.where("trim(text) <> ''").groupBy("g").count().collect()
    assert by_group == {r.g: r["count"] for r in full}


def test_no_documents(rows):
    empty = rows("doc long, g string, text string", [])
    assert KW.corpus_keywords(empty, "text", "doc", ["g"], 5).count() == 0


def test_names_equal_patterns_on_documents(spark, sf):
    docs = spark.read.parquet(sf + "/documents.parquet")
    forms = [x for n in NAMES for x in (n, n + "x", "_" + n, n + "́", f"({n.upper()})", "é" + n, n + "-" + n, n + "+")]
    each = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    pick = F.element_at(F.array(*[F.lit(x) for x in forms]), ((F.col("doc_id") * 8 + F.col("k")) % len(forms) + 1).cast("int"))
    both = each.select(F.concat_ws(" ", "text", pick).alias("t")).select(
        "t", skills.named_in(F.col("t"), NAMES).alias("a"), skills.named_in_regex(F.col("t"), NAMES).alias("b"))
    assert both.where("a IS DISTINCT FROM b").limit(3).collect() == []
    found = {r[0] for r in both.select(F.explode("a")).distinct().collect()}
    assert found >= {n for n in NAMES if re.fullmatch(r"\w+", n)}


@pytest.mark.parametrize("names", [["R", "r", "C", "C++", "C#", ".NET", "Power BI", "power"], ["SQL"], ["a b"], []])
def test_names_of_any_shape(rows, names):
    texts = ["", "r", "R&D c++x .net", "power bi", "power  bi", "SQL,sql", "a b", "xa b", "c# c#x", "_r r_", "POWER BI."]
    both = rows("t string", [(t,) for t in texts]).select(
        "t", skills.named_in(F.col("t"), names).alias("a"), skills.named_in_regex(F.col("t"), names).alias("b")).collect()
    assert [r for r in both if r.a != r.b] == []


def test_names_are_sought_by_one_pattern_each_text(rows):
    text = rows("t string", [("x",)]).select(skills.named_in(F.col("t"), NAMES).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    single = [n for n in NAMES if re.fullmatch(r"\w+", n.lower())]
    assert len(single) > 80 and text.count("RLIKE") <= len(NAMES) - len(single)
