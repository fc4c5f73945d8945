"""Exact quantiles against Python, the plans of what uses them, and the reports whose minimum counts are gone."""

import math
import os
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from test_properties import plan

from jobweave import rules
from jobweave.operators import charts as CH
from jobweave.operators import market as M
from jobweave.operators import quantiles as Q

QS = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]


def brute(values, q):
    v = sorted(values)
    r = Fraction(str(q)) * (len(v) - 1)
    low, high = v[math.floor(r)], v[math.ceil(r)]
    return float(low) if low == high else float(low) + (float(high) - float(low)) * float(r - math.floor(r))


def assert_quantiles(df, pairs):
    groups = {}
    for g, v in pairs:
        if v is not None:
            groups.setdefault(g, []).append(v)
    got = {r.g: r for r in Q.exact_quantiles(df, ["g"], "v", QS).collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        assert got[g].n == len(values)
        for q in QS:
            assert got[g][Q.name_of(q)] == pytest.approx(brute(values, q), rel=1e-12, abs=1e-300), (g, q)


def test_groups_of_all_shapes(rows):
    r = random.Random(7)
    pairs = [("hot", r.lognormvariate(7, 1)) for _ in range(6000)] + [("few", float(r.randrange(5))) for _ in range(3000)]
    pairs += [("sign", r.uniform(-1, 1) * 10.0 ** r.randrange(-300, 300)) for _ in range(2000)] + [("one", 5.5)]
    pairs += [("near", 1.0 + k * 2.0 ** -50) for k in r.sample(range(3000), 1500)] + [("tiny", k * 5e-324) for k in range(60)]
    pairs += [(None, float(k)) for k in range(11)] + [("none", None)] * 3 + [("zero", 0.0), ("zero", -0.0), ("zero", 1.0)]
    assert_quantiles(rows("g string, v double", pairs), pairs)


def test_whole_numbers(rows):
    pairs = [("big", 2 ** 60 + 4096 * k) for k in range(500)] + [("int", k % 17 - 8) for k in range(999)]
    assert_quantiles(rows("g string, v long", pairs), pairs)


def test_endless_and_nan_sort_last(rows):
    df = rows("v double", [(float("nan"),), (float("inf"),), (1.0,), (float("-inf"),), (2.0,)])
    got = Q.exact_quantiles(df, [], "v", [0.0, 0.25, 0.5, 0.75, 1.0]).first()
    assert got[1:5] == (float("-inf"), 1.0, 2.0, float("inf")) and math.isnan(got[5])


def test_no_values(rows):
    df = rows("g string, v double", [("a", None)])
    assert Q.exact_quantiles(df, ["g"], "v", [0.5]).collect() == [] == Q.exact_quantiles(df, [], "v", [0.5]).collect()
    assert Q.median_by(df, ["g"], "v").collect()[0][:] == ("a", None, 0)
    assert df.agg(F.count("*").alias("n")).select(Q.overall_one(df, "v").alias("q")).first().q is None


def test_whole_column_is_spread_over_tasks(spark):
    """No stage hands one task more than a small share of a table that is a single group of distinct values."""
    df = spark.range(0, 200_000, 1, 8).select((F.xxhash64("id") / 1e12).alias("v"))
    want = df.agg(F.percentile("v", F.lit(0.5)).alias("q")).first().q
    out = Q.exact_quantiles(df, [], "v", [0.5])
    assert out.first().q50 == pytest.approx(want, rel=1e-12)
    cells = df.groupBy(Q._cell(F.col("v"), Q.COARSE).alias("c")).count()
    assert cells.agg(F.max("count")).first()[0] < 2000


def test_plans_have_no_nested_loops(spark, sf):
    import __spark_entry__ as entry

    names = ("g1_overview_kpis g5_salary_kpis g6_quartiles g9_role_salary_stats g22_two_city_roles g27_dataset_overview "
             "e11_trimmed_salary_subset e12_filter_options e18_salary_bands m3_exact_quantiles m4_describe o2_box_stats p8_salary_distribution")
    for name in names.split():
        text = plan(entry.queries()[name](spark, sf))
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_one_scan_for_all_quantiles(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    text = plan(Q.exact_quantiles(df, ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75]))
    # the counts of values are needed at three levels; equal subplans share one exchange when run
    counted = re.findall(r"HashAggregate\(keys=\[l_returnflag#\d+, [^\]]*l_extendedprice#\d+\]", text)
    out = Q.exact_quantiles(df, ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75])
    out.collect()
    final = plan(out).split("Initial Plan")[0]
    assert counted and final.count("FileScan") == 1 and final.count("ReusedExchange") >= 1


def test_built_in_percentile_is_not_used():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "jobweave")
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "F.percentile" not in f.read() and "F.median" not in name, name


# reports that once left small groups out ---------------------------------------------------------

def test_two_city_report_of_few_postings(rows):
    df = rows("role_category string, city string, salary_midpoint_usd double",
              [("a", rules.HCM_KEYS[0], 900.0), ("a", rules.HANOI_KEYS[0], None), ("b", rules.HANOI_KEYS[0], 700.0), ("b", "Hue", 1.0)])
    got = {r.role_category: tuple(r)[1:] for r in M.two_city_roles(df).collect()}
    assert got == {"a": (1, 1, 900.0, None), "b": (0, 1, None, 700.0)}
    assert M.two_city_roles(df, min_jobs=2).collect() == []
    assert {r.left_median for r in M.two_city_roles(df, min_paid=2).collect()} == {None}


def test_skill_shares_of_small_roles(rows):
    role, other = rules.HEATMAP_ROLES[:2]
    first, second = rules.FOCUS_SKILLS[:2]
    df = rows("role_category string, chart_skills array<string>", [(role, [first])] + [(other, [])] * 99 + [(other, [second])])
    got = {(r.role_category, r.skill): r.pct for r in M.skill_role_percent(df).collect()}
    assert got[role, first] == 100.0 and got[other, second] == 1.0 and got[other, first] == 0.0
    assert {s for _, s in got} == set(rules.FOCUS_SKILLS)
    few = {(r.role_category, r.skill): r.pct for r in M.skill_role_percent(df, min_jobs=5, min_max=0.5).collect()}
    assert few[role, second] is None and {s for _, s in few} == {second}


def test_box_of_one_value(rows):
    df = rows("g string, v double", [("a", 3.0), ("b", 1.0), ("b", 2.0), ("c", None)])
    got = {r.g: (r.n, r.q1, r["median"], r.q3, r.whisker_low, r.whisker_high, r.outliers) for r in CH.box_stats(df, "g", "v").collect()}
    assert got == {"a": (1, 3.0, 3.0, 3.0, 3.0, 3.0, 0), "b": (2, 1.25, 1.5, 1.75, 1.0, 2.0, 0)}
    assert {r.g for r in CH.box_stats(df, "g", "v", min_rows=2).collect()} == {"b"}
