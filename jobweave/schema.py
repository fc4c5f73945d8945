"""Fixed schemas and column lists of the bronze, silver and gold layers."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _B = T.StringType(), T.DoubleType(), T.BooleanType()

BRONZE_FIELDS = [
    ("job_id", _S), ("job_title", _S), ("company_name", _S), ("salary", _S),
    ("salary_min", _D), ("salary_max", _D), ("salary_currency", _S), ("location", _S),
    ("employment_type", _S), ("job_level", _S),
    # read as text: a JSON list, a JSON string and a comma string all arrive as text
    ("skills_required", _S),
    ("experience_years", _D), ("experience_level", _S), ("job_description", _S),
    ("benefits", _S), ("requirements", _S), ("posted_date", _S), ("expiry_date", _S),
    ("url", _S), ("source_website", _S), ("industry", _S), ("job_type", _S),
    ("data_completeness", _S), ("crawled_at", _S),
    ("is_active", _B), ("in_analysis_period", _B),
]
BRONZE = T.StructType([T.StructField(n, t) for n, t in BRONZE_FIELDS])

# fields every posting is expected to carry (fixed values)
POSTING_FIELDS = [
    "job_title", "company_name", "salary", "salary_min", "salary_max", "salary_currency",
    "location", "employment_type", "job_level", "skills_required", "experience_years",
    "experience_level", "job_description", "benefits", "posted_date", "expiry_date", "url",
    "source_website", "industry", "job_type",
]

# silver table (fixed values)
SILVER_COLUMNS = [
    "job_id", "job_hash", "job_title", "company_name", "company_name_normalized",
    "salary", "salary_min_usd", "salary_max_usd", "salary_midpoint_usd",
    "salary_currency_norm", "has_salary", "is_negotiable",
    "location", "location_normalized", "is_remote",
    "employment_type", "job_level",
    "skills_str", "skill_count",
    "experience_years_parsed", "experience_level_inferred",
    "job_description", "benefits",
    "posted_date", "posted_date_dt", "expiry_date", "expiry_date_dt",
    "days_since_posted",
    "url", "source_website", "industry", "job_type",
    "data_completeness", "crawled_at",
    "is_active", "in_analysis_period",
]

# columns of a report download (fixed values)
REPORT_COLUMNS = [
    "job_title", "company_name", "city", "role_category", "experience_level_inferred",
    "salary_midpoint_usd", "skills_str", "source_website", "posted_date_dt", "url",
]

# fields of the quality report (fixed values)
QUALITY_FIELDS = [
    "job_title", "company_name", "salary_min_usd", "location_normalized",
    "skills_str", "experience_years_parsed", "experience_level_inferred",
    "job_description", "benefits", "posted_date", "expiry_date",
]
