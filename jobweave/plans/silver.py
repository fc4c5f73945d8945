"""Bronze to silver as one lazy plan, plus the tables it is written to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave import rules
from jobweave import schema as S
from jobweave.functions import dates
from jobweave.functions import text as tx
from jobweave.functions.common import text
from jobweave.operators import cleaning as C
from jobweave.operators import normalize as N
from jobweave.sources import writers


@dataclass(frozen=True)
class Options:
    as_of: str = rules.REFERENCE_DATE
    analysis_start: str = rules.ANALYSIS_START
    analysis_end: str = rules.ANALYSIS_END
    in_period_only: bool = False
    nan_as_lead: bool = False
    strict_iso: bool = False
    unique: str | None = "ingest_seq"      # position in the ingest order, where the input has it
    elect_by_id: bool = False              # see cleaning.remove_duplicates


def stages(bronze: DataFrame, opt: Options = Options()) -> list[tuple[str, DataFrame]]:
    """The named stages; each is a lazy DataFrame built on the one before.

    Cheap filters and the two text columns that decide what is a duplicate come
    first.  All other cleaning and normalising waits until after the two
    de-duplication shuffles, where there are fewer rows.
    """
    out = [("load", bronze)]
    add = lambda name, df: out.append((name, df)) or df
    df = add("valid", C.drop_invalid_urls(C.drop_missing_titles(bronze)))
    df = add("clean", C.with_job_hash(C.clean_text_columns(df, (), C.KEY_COLUMNS)))
    unique = opt.unique if opt.unique in df.columns else None
    df = add("dedup", C.remove_duplicates(df, unique=unique, elect_by_id=opt.elect_by_id and unique is not None))
    df = C.with_company_group(C.clean_text_columns(df, plain=C.OTHER_TEXT_COLUMNS))
    df = N.normalize_salary(df)
    df = N.normalize_location_columns(df)
    df = N.normalize_skills_columns(df)
    df = N.normalize_experience_columns(df, opt.nan_as_lead)
    df = N.normalize_dates(df, opt.as_of, opt.strict_iso)
    if not {"is_active", "in_analysis_period"} <= set(df.columns):
        for cols in dates.time_flags(as_of=opt.as_of, start=opt.analysis_start,
                                     end=opt.analysis_end):
            df = df.withColumns(cols)
    if "data_completeness" not in df.columns:
        df = df.withColumn("data_completeness",
                           F.when(text("job_description") != "", "full").otherwise("partial"))
    if opt.in_period_only:
        df = df.where(F.col("in_analysis_period"))
    add("normalize", df)
    return out


def step_statistics(bronze: DataFrame, opt: Options = Options()) -> DataFrame:
    """(step_no, step, rows) of the stages, in one pass over the input.

    Cleaning and normalising keep all rows, so three numbers tell the five steps.
    With ``in_period_only`` the last step drops rows and is counted from its own plan.
    """
    valid = C.has_title() & tx.has_http_prefix("url")
    unique = opt.unique if opt.unique in bronze.columns else None
    clean = C.clean_text_columns(bronze.withColumn("_valid", valid), (), C.KEY_COLUMNS)
    one = C.row_counts(clean, F.col("_valid"), unique=unique)
    last = F.col("kept")
    if opt.in_period_only:
        last = stages(bronze, opt)[-1][1].agg(F.count("*")).scalar()
    numbers = [("load", F.col("rows")), ("valid", F.col("valid")), ("clean", F.col("valid")), ("dedup", F.col("kept")), ("normalize", last)]
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), n.alias("rows"))
                                         for i, (name, n) in enumerate(numbers)])))


def to_silver(bronze: DataFrame, opt: Options = Options()) -> DataFrame:
    return export_columns(stages(bronze, opt)[-1][1])


def export_columns(df: DataFrame, columns=S.SILVER_COLUMNS) -> DataFrame:
    """Schema columns that exist, in schema order."""
    return df.select([c for c in columns if c in df.columns])


def cleaned_subset(df: DataFrame) -> DataFrame:
    """Title and company present, url not NULL."""
    return df.where((F.trim(text("job_title")) != "") & (F.trim(text("company_name")) != "")
                    & F.col("url").isNotNull())


def run(spark: SparkSession, bronze: DataFrame, processed_dir: str, cleaned_dir: str,
        opt: Options = Options(), csv: bool = True) -> dict[str, str]:
    """Write silver once, then derive everything else from the written table."""
    paths = {"processed_parquet": f"{processed_dir}/jobs_processed.parquet",
             "cleaned_parquet": f"{cleaned_dir}/jobs_cleaned.parquet"}
    planned = to_silver(bronze, opt)
    writers.write_parquet(planned, paths["processed_parquet"], ["source_website"])
    silver = export_columns(spark.read.schema(planned.schema).parquet(paths["processed_parquet"]))
    if not silver.take(1):
        raise ValueError("no valid postings in the input")
    cleaned = cleaned_subset(silver)
    writers.write_parquet(cleaned, paths["cleaned_parquet"], ["source_website"])
    if csv:
        paths["processed_csv"] = f"{processed_dir}/jobs_processed.csv"
        paths["cleaned_csv"] = f"{cleaned_dir}/jobs_cleaned.csv"
        writers.write_csv(silver, paths["processed_csv"])
        writers.write_csv(cleaned, paths["cleaned_csv"])
    return paths
