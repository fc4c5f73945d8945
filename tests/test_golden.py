"""Rows worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobweave.functions import dates, experience, location, roles, salary, skills
from jobweave.functions import text as tx
from jobweave.operators import extract as X
from jobweave.operators import keywords as KW
from jobweave.operators import matching as MT
from jobweave.operators import timeseries as TS


def one(spark, value, fn):
    return spark.range(1).select(F.lit(value).alias("x")).select(fn("x").alias("y")).first()["y"]


@pytest.mark.parametrize("text,lo,hi", [
    ("8 - 15 triệu", 313.73, 588.24), ("1,500 - 2,000 USD", 1500, 2000), ("Upto 2000", 1400, 2000),
    ("from $1000", 1000, 1400), ("15,000,000 VND", 588.24, 588.24), ("40 - 60 USD", 50, 60),
    ("$30", None, None), ("Thỏa thuận", None, None), ("", None, None)])
def test_parse_salary(spark, text, lo, hi):
    df = salary.with_parsed_salary(spark.range(1).select(F.lit(text).alias("salary")))
    assert (df.first()["parsed_min"], df.first()["parsed_max"]) == (lo, hi)


@pytest.mark.parametrize("lo,hi,cur,text,want", [
    (2000.0, 3500.0, "USD", "", (2000, 3500)), (25500000.0, 51000000.0, "VND", "", (1000, 2000)),
    (10.0, 20.0, "USD", "$900", (900, 900)), (None, None, "", "Thỏa thuận", (None, None))])
def test_normalize_salary(rows, lo, hi, cur, text, want):
    df = rows("salary_min double, salary_max double, salary_currency string, salary string", [(lo, hi, cur, text)])
    r = salary.normalize_salary(df).first()
    got = (r["salary_min_usd"], r["salary_max_usd"])
    assert got == tuple(None if w is None else pytest.approx(w) for w in want)


@pytest.mark.parametrize("text,want", [
    ("$1,000 - $2,000", (1000, 2000, "USD")), ("20 - 30 triệu", (20e6, 30e6, "VND")), ("Up to $3,000", (0, 3000, "USD")),
    ("500 - 700 nghìn đồng", (500000, 700000, "VND")), ("Thỏa thuận", (None, None, "negotiable")), ("", (None, None, ""))])
def test_ingest_salary(spark, text, want):
    r = salary.with_ingest_salary(spark.range(1).select(F.lit(text).alias("salary"))).first()
    assert (r["ingest_min"], r["ingest_max"], r["ingest_currency"]) == want


@pytest.mark.parametrize("text,want", [
    ("Quận 1, TP.HCM", "Ho Chi Minh City"), ("Hà Nội, Hồ Chí Minh", "Ho Chi Minh City"), ("Hai Phong, Hue", "Hai Phong + more"),
    ("Binh Duong", "Binh Duong"), ("", "Unknown"), ("Technopark", "Hanoi")])
def test_location(spark, text, want):
    assert one(spark, text, location.normalize_location) == want


@pytest.mark.parametrize("text,want", [
    ("3-5 years", 3), ("ít nhất 2 năm", 2), ("24 months", 2), ("fresher", 0), ("25 years", None), ("10 years", 0),
    ("international team, 5 years", 0)])
def test_experience_years(spark, text, want):
    assert one(spark, text, experience.parse_experience_years) == want


@pytest.mark.parametrize("years,title,level,want,compat", [
    (4.0, "Data Engineer", "", "mid", "mid"), (1.0, "Senior Analyst", "", "senior", "senior"), (0.0, "Analyst", "", "fresher", "fresher"),
    (8.0, "Analyst", "", "lead", "lead"), (None, "Analyst", "Senior", "senior", "lead"), (None, "Analyst", "", "mid", "lead")])
def test_level(rows, years, title, level, want, compat):
    df = rows("experience_years_parsed double, job_title string, job_level string", [(years, title, level)])
    r = df.select(experience.experience_level().alias("a"), experience.experience_level(nan_as_lead=True).alias("b")).first()
    assert (r["a"], r["b"]) == (want, compat)


@pytest.mark.parametrize("text,want", [("sklearn, Python, python", ["Scikit-learn", "Python"]),
                                       ("K8s, Docker, AWS", ["Kubernetes", "Docker", "AWS"]), ("", []), ('["sql","SQL "]', ["SQL"])])
def test_skill_list(spark, text, want):
    assert one(spark, text, lambda c: skills.normalize_skills(skills.parse_skill_list(c))) == want


@pytest.mark.parametrize("title,want", [
    ("Senior Data Analyst", "Data Analyst"), ("MLOps Engineer", "MLOps/DevOps"), ("Backend Developer", "Software Engineer"),
    ("Tech Lead", "Manager/Lead"), ("DBA", "Database/DBA"), ("International Sales", "Intern/Fresher"), ("", "Khác")])
def test_role(spark, title, want):
    assert one(spark, title, roles.role_category) == want


@pytest.mark.parametrize("text,day,status", [
    ("2026-01-15", "2026-01-15", "exact"), ("15/01/2026", "2026-01-15", "exact"), ("Jan 15, 2026", "2026-01-15", "exact"),
    ("2026-01-15T10:00:00+0700", "2026-01-15", "exact"), ("3 days ago", "2026-05-11", "estimated"), ("1 tuần trước", "2026-05-07", "estimated"),
    ("hôm qua", "2026-05-13", "estimated"), ("5 hours ago", "2026-05-14", "estimated"), ("soon", None, "unknown"), ("31/02/2026", None, "unknown")])
def test_dates(spark, text, day, status):
    d, s = dates.posted_date(F.lit(text), F.lit(dt.date(2026, 5, 14)))
    r = spark.range(1).select(d.cast("string").alias("d"), s.alias("s")).first()
    assert (r["d"], r["s"]) == (day, status)


@pytest.mark.parametrize("c,r,want", [(1.0, None, 1.0), (None, 3.0, 0.4), (5.0, 3.0, 1.0), (1.0, 2.0, 0.5), (0.1, 0.2, 0.2)])
def test_alignment(rows, c, r, want):
    df = rows("c double, r double", [(c, r)])
    assert df.select(experience.experience_alignment("c", "r")).first()[0] == pytest.approx(want)


def test_pairs(rows):
    df = rows("s array<string>", [(["b", "a", "b"],), (["a", "b"],), (["a", "c"],)])
    assert [tuple(r) for r in KW.pair_rankings(df, "s").collect()] == [("a", "b", 2), ("a", "c", 1)]


def test_moving_average(rows):
    out = TS.centred_average(rows("t int, n int", [(1, 1), (2, 2), (3, 3), (4, 4)]), "t").orderBy("t").collect()
    assert [r["moving_avg"] for r in out] == [None, 2, 3, None]


@pytest.mark.parametrize("text,want", [
    ("[HN] Data Engineer", "Data Engineer"), ("Dong Da, Data Engineer", "Data Engineer"), ("JOB-42 Tester", "Tester"),
    ("Senior Data, Backend", "Senior Data, Backend")])
def test_clean_title(spark, text, want):
    assert one(spark, text, X.clean_title) == want


@pytest.mark.parametrize("text,phrase,years", [
    ("Need 3-5 years of experience.", "3-5 years of experience", 3), ("ít nhất 2 năm", "2 năm", 2), ("At least 1 year experience", "1 year experience", 1),
    ("No requirements", "", None)])
def test_experience_phrase(spark, text, phrase, years):
    assert one(spark, text, experience.experience_phrase) == phrase
    assert one(spark, phrase, experience.phrase_years) == years


def test_card(rows):
    df = rows("card string, t string, c string, s string", [(
        "Data Engineer (Spark/Airflow) ACME $900 Hà Nội Parttime Python 3 days ago", "Data Engineer (Spark/Airflow)", "ACME", "$900")])
    r = df.select(*[v.alias(k) for k, v in X.card_metadata("card", "t", "c", "s").items()]).first()
    assert (r["location"], r["employment_type"], r["posted_date"]) == ("Hà Nội", "Part-time", "3 days ago")
    assert r["skills_required"] == ["Python", "Spark", "Airflow"]


def test_html_and_accents(spark):
    assert one(spark, "<p>a&amp;b</p><script>x<1</script> c", tx.strip_html) == "a&b c"
    assert one(spark, "thỏa thuận Đồng đ", tx.strip_diacritics) == "thoa thuan Đong đ"


RESUME = "Jane\nSummary:\nAnalyst\nKỹ năng\nPython\n\nSkills\nSQL\nEducation\nX"


def test_sections(rows):
    r = MT.with_sections(rows("text string", [(RESUME,), ("a\nb",)])).collect()
    assert (r[0]["summary"], r[0]["skills"], r[0]["education"], r[0]["projects"]) == ("Analyst", "SQL", "X", "")
    assert r[1]["summary"] == "a\nb"


def test_score(rows):
    # skill 0.5, keyword 0.25, experience 1.0 -> 55.0
    cv = rows("resume_id int, skills array<string>, years double, terms array<string>, counts array<int>", [(1, ["SQL"], 5.0, ["x"], [1])])
    jd = rows("job_id int, skills array<string>, years double, terms array<string>, counts array<int>",
              [(7, ["Python", "SQL"], 3.0, ["p", "q", "r", "x"], [1, 1, 1, 1])])
    r = MT.match_pairs(rows("resume_id int, job_id int", [(1, 7)]), cv, jd).first()
    assert (r["score"], r["skill_score"], r["keyword_score"], r["experience_score"]) == (55.0, 50.0, 25.0, 100.0)
    assert r["missing_skills"] == ["Python"] and r["recommendations"][0].startswith("Ôn Python")
