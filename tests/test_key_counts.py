"""Counts of many keys in one pass."""

from collections import Counter

from pyspark.sql import functions as F

from jobweave.operators import counts as K
from jobweave.operators import gold, market

SCHEMA = "a string, b int, l array<string>"
DATA = [("x", 1, ["p", "q"]), ("x", None, ["p", None, "p"]), (None, 1, []), ("y", 2, None), ("x", 1, ["x"]), ("", 2, ["p"])]


def test_equal_to_counters(rows):
    got = K.key_counts(rows(SCHEMA, DATA), {"a": "a", "b": "b", "both": F.concat("a", F.lit("!"))}, {"l": "l"}).collect()
    want = Counter()
    for a, b, items in DATA:
        want.update([("a", a), ("b", None if b is None else str(b)), ("both", None if a is None else a + "!")])
        want.update(("l", x) for x in items or [] if x is not None)
    assert {(r.kind, r.value): r.n for r in got} == dict(want) and len(got) == len(want)


def test_no_rows_and_no_lists(rows):
    assert K.key_counts(rows(SCHEMA, []), {"a": "a"}, {"l": "l"}).count() == 0
    assert K.key_counts(rows(SCHEMA, DATA), {"a": "a"}).count() == 4


POSTING = ("company_name string, city string, source_website string, role_category string, experience_level_inferred string, "
           "salary_midpoint_usd double, has_salary boolean, dash_skills array<string>")


def test_overview_of_no_postings(rows):
    one = market.overview_kpis(rows(POSTING, [])).first()
    assert (one.jobs, one.companies, one.salary_coverage, one.top_city, one.median_salary) == (0, 0, 0.0, None, None)
    assert [tuple(r) for r in gold.filter_options(rows(POSTING, [])).collect()] == [("salary_cap", "5000", 0)]


def test_ties_go_to_the_smaller_key(rows):
    row = lambda company, city, level: (company, city, "s", "r", level, 1000.0, True, ["sql", "python"])
    df = rows(POSTING, [row("b", "Z", "junior"), row("a", "Y", "other"), row(None, "X", None)])
    one = market.overview_kpis(df.where("company_name IS NOT NULL")).first()
    assert (one.top_company, one.top_city, one.top_skill, one.jobs, one.salary_coverage) == ("a", "Y", "python", 2, 100.0)
    options = {(r.option, r.value) for r in gold.filter_options(df, 2).collect()}
    assert {v for o, v in options if o == "city"} == {"X", "Y"} and not any(v == "other" for o, v in options if o == "level")


def test_counts_merge_before_the_shuffle(rows):
    plan = K.key_counts(rows(SCHEMA, DATA), {"a": "a", "b": "b"}, {"l": "l"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan and plan.count("Scan") == 1
