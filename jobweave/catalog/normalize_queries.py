"""Registered queries: normalisation (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave import rules
from jobweave.catalog import layers as L
from jobweave.catalog import oracle as O
from jobweave.catalog.registry import query
from jobweave.functions import experience, location, salary, skills
from jobweave.functions.common import half_even
from jobweave.operators import normalize as N
from jobweave.sources import derived as D


@query("d1_is_negotiable", O.raw(f"SELECT ingest_seq, {O.negotiable('salary')} AS is_negotiable FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", salary.is_negotiable("salary").alias("is_negotiable"))


@query("d2_parse_salary_string", O.over(
    f"{O.RAW}, {O.parsed_salary('raw_jobs', 'ps')}",
    "SELECT ingest_seq, salary, parsed_min, parsed_max FROM ps"))
def _(spark, d):
    return salary.with_parsed_salary(L.raw(spark, d)).select(
        "ingest_seq", "salary", "parsed_min", "parsed_max")


@query("d3_normalize_salary", O.over(
    f"{O.RAW}, {O.full_salary('raw_jobs', 'ns')}",
    "SELECT ingest_seq, round(salary_min_usd, 4) AS salary_min_usd, "
    "round(salary_max_usd, 4) AS salary_max_usd, salary_currency_norm FROM ns"))
def _(spark, d):
    return N.normalize_salary(L.raw(spark, d)).select(
        "ingest_seq", F.round("salary_min_usd", 4).alias("salary_min_usd"),
        F.round("salary_max_usd", 4).alias("salary_max_usd"), "salary_currency_norm")


@query("d4_salary_midpoint", O.over(
    f"{O.RAW}, {O.full_salary('raw_jobs', 'ns')}",
    "SELECT ingest_seq, salary_midpoint_usd, has_salary FROM ns"))
def _(spark, d):
    return N.normalize_salary(L.raw(spark, d)).select(
        "ingest_seq", "salary_midpoint_usd", "has_salary")


@query("d5_normalize_location", O.raw(
    f"SELECT ingest_seq, {O.location('location')} AS location_normalized FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", location.normalize_location("location")
                                  .alias("location_normalized"))


@query("d6_is_remote", O.raw(f"SELECT ingest_seq, {O._REMOTE} AS is_remote FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", location.is_remote().alias("is_remote"))


@query("d7_normalize_skill", O.raw(f"""
SELECT skill, coalesce({O.sql_map(rules.SKILL_LIST_ALIASES)}[lower(trim(skill))], trim(skill)) AS canonical,
  count(*) AS n FROM (SELECT unnest(string_split(skills_required, ',')) AS skill FROM raw_jobs)
GROUP BY 1, 2"""))
def _(spark, d):
    each = L.raw(spark, d).select(F.explode(F.split("skills_required", ",")).alias("skill"))
    return (each.withColumn("canonical", skills.normalize_skill(F.col("skill")))
            .groupBy("skill", "canonical").agg(F.count("*").alias("n")))


@query("d8_parse_skill_list", O.raw(f"""
SELECT ingest_seq, array_to_string({O.comma_list('skills_required')}, '|') AS items,
  CASE WHEN skills_required = '' THEN '[]' ELSE '["' || replace(skills_required, ', ', '","') || '"]' END AS as_json,
  array_to_string({O.comma_list('skills_required')}, '|') AS json_items FROM raw_jobs"""))
def _(spark, d):
    df = L.raw(spark, d).withColumn(
        "as_json", F.when(F.col("skills_required") == "", "[]").otherwise(F.concat(
            F.lit('["'), F.replace("skills_required", F.lit(", "), F.lit('","')), F.lit('"]'))))
    return df.select("ingest_seq", "as_json",
                     F.array_join(skills.parse_skill_list("skills_required"), "|").alias("items"),
                     F.array_join(skills.parse_skill_list("as_json"), "|").alias("json_items"))


@query("d9_normalize_skills", O.over(
    f"{O.RAW}, s AS (SELECT ingest_seq, {O.norm_skills('skills_required')} AS sk FROM raw_jobs)",
    f"SELECT ingest_seq, array_to_string({O.dedup_ci('sk')}, '|') AS skills_normalized FROM s"))
def _(spark, d):
    return N.normalize_skills_columns(L.raw(spark, d)).select(
        "ingest_seq", F.array_join("skills_normalized", "|").alias("skills_normalized"))


@query("d10_skills_str_and_count", O.over(
    f"{O.RAW}, s AS (SELECT ingest_seq, {O.norm_skills('skills_required')} AS sk FROM raw_jobs), "
    f"u AS (SELECT ingest_seq, {O.dedup_ci('sk')} AS sk FROM s)",
    "SELECT ingest_seq, array_to_string(sk, ', ') AS skills_str, CAST(len(sk) AS INTEGER) AS skill_count FROM u"))
def _(spark, d):
    return N.normalize_skills_columns(L.raw(spark, d)).select("ingest_seq", "skills_str", "skill_count")


@query("d11_parse_experience_years", O.raw(
    f"SELECT ingest_seq, job_description, {O.years_of('job_description')} AS years FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", "job_description",
                                  experience.parse_experience_years("job_description").alias("years"))


@query("d12_experience_years", O.raw(f"SELECT ingest_seq, {O.YEARS} AS experience_years_parsed FROM raw_jobs"))
def _(spark, d):
    return L.raw(spark, d).select("ingest_seq", experience.experience_years()
                                  .alias("experience_years_parsed"))


@query("d13_infer_experience_level", O.raw(f"""
SELECT ingest_seq, y, {O.level('y', 'job_title', 'job_level')} AS experience_level_inferred
FROM (SELECT *, {O.YEARS} AS y FROM raw_jobs)"""))
def _(spark, d):
    return N.normalize_experience_columns(L.raw(spark, d)).select(
        "ingest_seq", F.col("experience_years_parsed").alias("y"), "experience_level_inferred")


@query("d14_normalize_dates", O.raw(f"""
SELECT ingest_seq, CAST(coalesce({O.abs_date('posted_date')}, {O.rel_date('posted_date', O.REF)}) AS VARCHAR) AS posted,
  CAST({O.abs_date('expiry_date')} AS VARCHAR) AS expiry FROM raw_jobs"""))
def _(spark, d):
    return N.normalize_dates(L.raw(spark, d), D.AS_OF).select(
        "ingest_seq", F.col("posted_date_dt").cast("string").alias("posted"),
        F.col("expiry_date_dt").cast("string").alias("expiry"))


@query("d15_days_since_posted", O.silver("SELECT job_hash, days_since_posted FROM silver"))
def _(spark, d):
    return L.silver(spark, d).select("job_hash", "days_since_posted")


@query("d16_value_maps", O.silver(f"""
SELECT job_hash, coalesce({O.sql_map(rules.CITY_SYNONYMS)}[location_normalized], location_normalized, 'Other') AS city,
  coalesce({O.sql_map(rules.EMPLOYMENT_SYNONYMS)}[employment_type], employment_type) AS emp_type FROM silver"""))
def _(spark, d):
    return L.silver(spark, d).select(
        "job_hash", location.city_synonym("location_normalized").alias("city"),
        location.employment_synonym("employment_type").alias("emp_type"))


@query("d0_silver_table", O.silver("""
SELECT job_hash, job_title, company_name_normalized, round(salary_min_usd, 4) AS salary_min_usd,
  round(salary_max_usd, 4) AS salary_max_usd, salary_midpoint_usd, has_salary, is_negotiable,
  location_normalized, is_remote, skills_str, skill_count, experience_years_parsed,
  experience_level_inferred, CAST(posted_date_dt AS VARCHAR) AS posted_date_dt,
  CAST(expiry_date_dt AS VARCHAR) AS expiry_date_dt, days_since_posted, data_completeness,
  is_active, in_analysis_period, source_website FROM silver"""))
def _(spark, d):
    text = lambda c: F.col(c).cast("string").alias(c)
    num = lambda c: F.round(c, 4).alias(c)
    return L.silver(spark, d).select(
        "job_hash", "job_title", "company_name_normalized", num("salary_min_usd"),
        num("salary_max_usd"), "salary_midpoint_usd", "has_salary", "is_negotiable",
        "location_normalized", "is_remote", "skills_str", "skill_count",
        "experience_years_parsed", "experience_level_inferred", text("posted_date_dt"),
        text("expiry_date_dt"), "days_since_posted", "data_completeness", "is_active",
        "in_analysis_period", "source_website")
