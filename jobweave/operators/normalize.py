"""Silver columns: salary, location, skills, experience and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave import rules
from jobweave.functions import dates, experience, location, skills
from jobweave.functions.salary import normalize_salary

__all__ = ["normalize_salary", "normalize_location_columns", "normalize_skills_columns",
           "normalize_experience_columns", "normalize_dates"]


def normalize_location_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({"location_normalized": location.normalize_location("location"),
                           "is_remote": location.is_remote()})


def normalize_skills_columns(df: DataFrame, col: str = "skills_required") -> DataFrame:
    listed = (F.col(col) if dict(df.dtypes)[col].startswith("array")
              else skills.parse_skill_list(col))
    df = df.withColumn("skills_list", listed)
    df = df.withColumn("skills_normalized", skills.normalize_skills("skills_list"))
    return df.withColumns({"skills_str": F.array_join("skills_normalized", ", "),
                           "skill_count": F.size("skills_normalized")})


def normalize_experience_columns(df: DataFrame, nan_as_lead: bool = False) -> DataFrame:
    texts = [c for c in ("job_description", "requirements", "benefits") if c in df.columns]
    df = df.withColumn("experience_years_parsed", experience.experience_years(texts=texts))
    return df.withColumn("experience_level_inferred",
                         experience.experience_level(nan_as_lead=nan_as_lead))


def normalize_dates(df: DataFrame, as_of: str = rules.REFERENCE_DATE,
                    strict_iso: bool = False) -> DataFrame:
    """Posted and expiry dates; relative forms count from the crawl date.

    ``strict_iso`` accepts ISO dates only.
    """
    ref = F.coalesce(F.col("crawled_at").try_cast("date"), F.to_date(F.lit(as_of)))
    if strict_iso:
        iso = lambda c: F.when(F.trim(c).rlike(dates.DATE_SHAPES[0][0]),
                               F.try_to_date(F.trim(c), "yyyy-M-d"))
        posted, expiry = iso(F.col("posted_date")), iso(F.col("expiry_date"))
    else:
        posted, _ = dates.posted_date("posted_date", ref)
        expiry = dates.parse_absolute_date("expiry_date")
    df = df.withColumns({"posted_date_dt": posted, "expiry_date_dt": expiry})
    return df.withColumn("days_since_posted", dates.days_since("posted_date_dt", as_of))
