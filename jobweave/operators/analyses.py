"""Named analyses over a postings frame: market, salary and skills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions.common import explode_each
from jobweave.functions.location import workplace
from jobweave.functions.skills import skill_category, skill_pairs
from jobweave.operators import counts as K
from jobweave.operators import market as M
from jobweave.operators import statistics as ST
from jobweave.operators import timeseries as TS
from jobweave.operators.quantiles import median_by


# market
def top_job_titles(df: DataFrame, n: int = 15) -> DataFrame:
    return K.value_counts(df, "job_title", n)


def jobs_by_city(df: DataFrame, col: str = "location_normalized") -> DataFrame:
    return K.value_counts(df, col)


def remote_vs_onsite(df: DataFrame) -> DataFrame:
    return K.value_counts(df.withColumn("workplace", workplace()), "workplace")


def hiring_trend_by_month(df: DataFrame) -> DataFrame:
    return TS.monthly_counts(df)


def top_hiring_companies(df: DataFrame, n: int = 20) -> DataFrame:
    return K.value_counts(df, "company_name", n)


def jobs_by_experience_level(df: DataFrame) -> DataFrame:
    return K.value_counts(df, "experience_level_inferred")


def jobs_by_source(df: DataFrame) -> DataFrame:
    return K.value_counts(df, "source_website")


# salary (of the lower bound, as stated in the contract)
def salary_distribution(df: DataFrame, col: str = "salary_min_usd") -> DataFrame:
    return ST.describe(df, col).select("mean", "median", "std", "min", "max")


def _median(df: DataFrame, key: str, col: str) -> DataFrame:
    paid = df.where(F.col(col).isNotNull())
    return median_by(paid, [key], col, "median_salary").drop("n")


def salary_by_role(df: DataFrame, col: str = "salary_min_usd") -> DataFrame:
    return _median(df, "job_title", col)


def salary_by_location(df: DataFrame, col: str = "salary_min_usd") -> DataFrame:
    return _median(df, "location_normalized", col)


def salary_by_experience(df: DataFrame, col: str = "salary_min_usd") -> DataFrame:
    return _median(df, "experience_level_inferred", col)


def salary_currency_split(df: DataFrame, col: str = "salary_currency") -> DataFrame:
    return K.shares(df, col)


def negotiable_salary_rate(df: DataFrame, col: str = "salary_min_usd") -> DataFrame:
    return df.agg(F.avg(F.col(col).isNull().cast("int")).alias("rate"))


# skills
def top_skills(df: DataFrame, n: int = 30, skills: str = "skills") -> DataFrame:
    return M.skill_counts(df, skills, n)


def skills_by_category(df: DataFrame, skills: str = "skills") -> DataFrame:
    per = M.skill_counts(df, skills).withColumn("category", skill_category("skill"))
    return per.groupBy("category").agg(F.sum("n").alias("n"), F.count("*").alias("skills"))


def skill_cooccurrence_matrix(df: DataFrame, n: int = 20, skills: str = "skills") -> DataFrame:
    """Zero-filled (skill_a, skill_b, n) among the n most frequent skills, both directions.

    Rows are cut down to the top skills before pairs are built, so a row gives at
    most n * (n - 1) / 2 of them.
    """
    top = M.skill_counts(df, skills, n)
    keys = K.key_array(top, "skill")
    kept = df.select(F.array_intersect(F.col(skills), keys).alias("kept"))
    pairs = explode_each(kept, skill_pairs("kept"), "p")
    counts = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    both = F.array(F.struct(F.col("a").alias("skill_a"), F.col("b").alias("skill_b"), "n"),
                   F.struct(F.col("b").alias("skill_a"), F.col("a").alias("skill_b"), "n"))
    grid = top.select(F.col("skill").alias("skill_a"), F.explode(keys).alias("skill_b"))
    return grid.join(counts.select(F.inline(both)), ["skill_a", "skill_b"], "left").na.fill({"n": 0})


def skills_by_experience_level(df: DataFrame, n: int = 10, skills: str = "skills") -> DataFrame:
    each = M.explode_skills(df, skills, keep=["experience_level_inferred"])
    per = each.groupBy("experience_level_inferred", "skill").agg(F.count("*").alias("n"))
    return K.top_per_group(per, ["experience_level_inferred"], [F.desc("n"), F.col("skill")], n)


def skills_by_role(df: DataFrame, role: str, skills: str = "skills", n: int | None = None) -> DataFrame:
    return M.skill_counts(df.where(F.col("job_title") == role), skills, n)


def trending_skills(df: DataFrame, as_of: str, window_months: int = 3, n: int = 20,
                    skills: str = "skills") -> DataFrame:
    each = M.explode_skills(df, skills, keep=["posted_date_dt"])
    return TS.trending(each, "skill", as_of, window_months, n)
