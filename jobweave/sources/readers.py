"""Sources: JSON lines, Parquet with CSV fallback, CSV, plain-text résumés."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from jobweave import schema as S
from jobweave.functions.common import as_col
from jobweave.functions.text import decode_text

CORRUPT = "_corrupt_record"
# {source}_jobs_{YYYY_MM_DD}.jsonl
DATED_FILE = r"^(.+)_jobs_(\d{4}_\d{2}_\d{2})"


def read_postings(spark: SparkSession, path, schema: T.StructType = S.BRONZE,
                  keep_rejected: bool = False) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are ignored.

    Lines that are not JSON are dropped, or all rows are returned with the bad
    text in ``_corrupt_record`` when ``keep_rejected`` is set.  Source and crawl
    date come from the file name.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.schema(with_corrupt)
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
          .json(path))
    df = df.withColumns(dated_file_columns(F.col("_metadata.file_name")))
    return df if keep_rejected else df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def dated_file_columns(name: str | Column) -> dict[str, Column]:
    """``file_source`` and ``crawl_date`` out of a dated file name."""
    name = as_col(name)
    part = lambda i: F.nullif(F.regexp_extract(name, DATED_FILE, i), F.lit(""))
    return {"file_source": part(1), "crawl_date": F.try_to_date(part(2), "yyyy_MM_dd")}


def raw_line_counts(spark: SparkSession, paths) -> DataFrame:
    """Non-blank lines per source over many dated files."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    src = dated_file_columns(F.col("_metadata.file_name"))["file_source"]
    return lines.groupBy(src.alias("source_website")).agg(F.count("*").alias("n"))


def read_table(spark: SparkSession, parquet_path: str, csv_path: str | None = None,
               schema: T.StructType | None = None) -> DataFrame:
    """Parquet when it can be opened, else the CSV copy."""
    try:
        return spark.read.parquet(parquet_path)
    except AnalysisException as e:
        if csv_path is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return read_csv(spark, csv_path, schema)


def read_csv(spark: SparkSession, path, schema: T.StructType | str | None = None, line_breaks: bool = True) -> DataFrame:
    """CSV with header, quoted commas and line breaks, doubled quotes, optional BOM.

    A file whose values may hold line breaks is read by one task; with
    ``line_breaks=False`` a large file is split over many.
    """
    reader = (spark.read.option("header", True).option("multiLine", line_breaks)
              .option("quote", '"').option("escape", '"').option("encoding", "UTF-8"))
    df = (reader.schema(schema) if schema else reader).csv(path)
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else df


def read_dated(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What `writers.write_dated` wrote, with ``file_source`` and ``crawl_date`` out of the folder names.

    A filter on ``file`` reads only the folders it names.
    """
    df = spark.read.schema(schema).json(path)
    return df.withColumns(dated_file_columns("file"))


def read_resumes(spark: SparkSession, path) -> DataFrame:
    """(resume_id, text): UTF-8 with or without BOM, else windows-1258, else Latin-1; a file of no bytes is no row."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.regexp_extract(F.col("path"), r"([^/]+)$", 1).alias("resume_id"),
                      decode_text("content").alias("text"))
