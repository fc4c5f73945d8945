"""Ingest jobs on posting tables: relevance, de-duplication, overlay, enrichment, funnel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave import rules
from jobweave import schema as S
from jobweave.functions.common import contains_any, let, text
from jobweave.functions.dates import time_flags
from jobweave.operators.cleaning import keep_first


def is_relevant(title="job_title", description="job_description", titles=None, keywords=None,
                chars: int | None = None) -> Column:
    """A known title in the title, or a keyword in the title or the description (its first ``chars``, if given)."""
    t = F.lower(text(title))
    d = F.lower(text(description))
    d = d if chars is None else F.substring(d, 1, chars)
    words = rules.VALID_JOB_KEYWORDS if keywords is None else keywords
    known = [x.lower() for x in (rules.VALID_JOB_TITLES if titles is None else titles)]
    return (let(t, lambda t: contains_any(t, known) | contains_any(t, words))
            | let(d, lambda d: contains_any(d, words)))


def with_time_flags(df: DataFrame, **window) -> DataFrame:
    for cols in time_flags(**window):
        df = df.withColumns(cols)
    return df.drop("_posted_status")


def drop_expired(df: DataFrame) -> DataFrame:
    return df.where(F.col("expiry_date_status") != "expired")


def first_seen(df: DataFrame, key: str = "job_id", order: Sequence[str] = ("crawled_at", "url")) -> DataFrame:
    return keep_first(df, [key], [c for c in order if c in df.columns])


def latest(df: DataFrame, key: str, time: str = "crawled_at") -> DataFrame:
    """One row per key: the latest by ``time`` where there is such a column."""
    return keep_first(df, [key], [F.col(time).desc()] if time in df.columns else [key])


def overlay(card: DataFrame, detail: DataFrame, key: str = "url") -> DataFrame:
    """Detail values win where they are not NULL; cards without a detail stay.

    Of several details of one key the latest crawled counts.
    """
    shared = [c for c in detail.columns if c != key]
    d = latest(detail, key).select(key, *[F.col(c).alias(f"_d_{c}") for c in shared])
    out = card.join(d, key, "left")
    mixed = {c: (F.coalesce(f"_d_{c}", c) if c in card.columns else F.col(f"_d_{c}")) for c in shared}
    return out.withColumns(mixed).drop(*[f"_d_{c}" for c in shared])


def completeness_tag(description="job_description") -> Column:
    return F.when(text(description) != "", "full").otherwise("partial")


def needs_enrichment(skills: str = "skills_required") -> Column:
    return (F.col("experience_years").isNull() | (text("experience_level") == "")
            | (F.coalesce(F.size(skills), F.lit(0)) < 4))


def merge_enrichment(jobs: DataFrame, extra: DataFrame, key: str = "job_id") -> DataFrame:
    """Fill gaps from an enrichment table.

    Years and salary only where missing (salary within bounds), a valid level
    replaces the old one, skill lists are joined without repeats.  Of several rows
    of one key the latest crawled counts.
    """
    e = latest(extra, key).select(key, *[F.col(c).alias(f"_e_{c}") for c in extra.columns if c != key])
    df = jobs.join(e, key, "left")
    hit = F.col("_e_found")
    years = F.when(F.col("_e_experience_years_min") >= 0, F.col("_e_experience_years_min"))
    lo, hi = F.col("_e_salary_min_usd"), F.col("_e_salary_max_usd")
    take = F.coalesce(F.col("salary_min").isNull() & lo.between(rules.ENRICH_FLOOR_USD, rules.ENRICH_CEIL_USD), F.lit(False))
    top = F.when(hi <= rules.ENRICH_CEIL_USD, hi).otherwise(lo)
    none = F.array().cast("array<string>")
    merged = F.array_distinct(F.concat(F.coalesce("skills_required", none), F.coalesce("_e_skills_required", none)))
    label = F.concat(F.floor(lo).cast("string"), F.lit(" - "), F.floor(top).cast("string"), F.lit(" USD"))
    return df.withColumn("_take", take).select(
        *[c for c in jobs.columns if c not in ("experience_years", "experience_level", "skills_required", "salary",
                                               "salary_min", "salary_max", "salary_currency")],
        F.coalesce("experience_years", years).alias("experience_years"),
        F.col("_e_experience_years_max").alias("experience_years_max"),
        F.when(F.col("_e_experience_level").isin(*rules.ENRICHED_LEVELS), F.col("_e_experience_level"))
         .otherwise(F.col("experience_level")).alias("experience_level"),
        F.when(hit, F.filter(merged, lambda s: s != ""))
         .otherwise(F.col("skills_required")).alias("skills_required"),
        F.when(F.col("_take"), lo).otherwise(F.col("salary_min")).alias("salary_min"),
        F.when(F.col("_take"), top).otherwise(F.col("salary_max")).alias("salary_max"),
        F.when(F.col("_take"), "USD").otherwise(F.col("salary_currency")).alias("salary_currency"),
        F.when(F.col("_take") & (text("salary") == ""), label).otherwise(F.col("salary")).alias("salary"),
        F.coalesce(hit, F.lit(False)).alias("enriched"))


def ingest_outcomes(df: DataFrame, key: str = "job_id", order: Sequence[str] = ("crawled_at", "url"), **window) -> DataFrame:
    """Outcome per record: duplicate, irrelevant, expired or saved.

    The first record of an id decides; later ones are duplicates even when the
    first was dropped.  A saved record outside the period stays saved;
    ``in_analysis_period`` tells.  Duplicates are found by comparing with the smallest
    order value of the id, which merges before the shuffle.
    """
    order = [c for c in order if c in df.columns]
    place = F.struct(*[F.col(c) for c in order], F.xxhash64(*[F.col(c) for c in df.columns]).alias("_h"))
    df = with_time_flags(df.withColumn("_place", place), **window)
    first = df.groupBy(key).agg(F.min("_place").alias("_first"))
    df = df.join(first, key)
    outcome = (F.when(F.col("_place") != F.col("_first"), "duplicate").when(~is_relevant(), "irrelevant")
                .when(F.col("expiry_date_status") == "expired", "expired")
                .otherwise("saved"))
    return df.withColumn("outcome", outcome).drop("_place", "_first")


def funnel(outcomes: DataFrame, source: str = "source_website") -> DataFrame:
    """Counters per source: fetched, each outcome, and the saved records that are out of the period."""
    late = F.when((F.col("outcome") == "saved") & ~F.col("in_analysis_period"), "out_of_period")
    kinds = F.array_compact(F.array(F.lit("fetched"), F.col("outcome"), late))
    return outcomes.select(source, F.explode(kinds).alias("outcome")).groupBy(source, "outcome").agg(F.count("*").alias("n"))


def validate_output(df: DataFrame, fields=S.POSTING_FIELDS) -> DataFrame:
    """(section, key, value): rows, missing fields, NULL shares, counts by source and flags."""
    missing = [c for c in fields if c not in df.columns]
    share = lambda c: (F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 1) if c in df.columns else F.lit(None)).cast("double")
    one = df.agg(F.count("*").cast("double").alias("rows"), share("job_title").alias("title"), share("salary_min").alias("salary"))
    cells = [("total_records", "", F.col("rows")), ("null_title_pct", "", F.col("title")), ("null_salary_pct", "", F.col("salary"))]
    cells += [("missing_field", c, F.lit(1.0)) for c in missing]
    out = one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), v.alias("value"))
                                        for s, k, v in cells])))
    for c in ("source_website", "posted_date_status", "expiry_date_status", "is_active", "in_analysis_period"):
        if c in df.columns:
            key = F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
            out = out.unionByName(df.groupBy(key.alias("key")).agg(F.count("*").cast("double").alias("value"))
                                  .select(F.lit(c).alias("section"), "key", "value"))
    return out
