"""Sinks: Parquet, CSV and append-only-new-ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

MAX_RECORDS_PER_FILE = 5_000_000
#: Bytes of a stored table from which on reducing its keys first costs less than a shuffle of them.
LARGE_STORED = 128 * 2 ** 20


def write_parquet(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite") -> None:
    """No extra shuffle before the write: a source that holds a third of the rows is
    written by as many tasks as computed it."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def csv_ready(df: DataFrame, bom: bool = True) -> DataFrame:
    """Dates and arrays as text; the BOM goes before the first header name."""
    out = []
    for name, dtype in df.dtypes:
        col = F.col(f"`{name}`")
        if dtype.startswith("array"):
            col = F.array_join(col, ", ")
        elif dtype in ("date", "timestamp", "timestamp_ntz"):
            col = col.cast("string")
        out.append(col.alias("﻿" + name if bom and not out else name))
    return df.select(out)


def write_csv(df: DataFrame, path: str, bom: bool = True, mode: str = "overwrite") -> None:
    (csv_ready(df, bom).write.mode(mode).option("header", True).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
     .option("quote", '"').option("escape", '"').csv(path))


def append_new(spark: SparkSession, batch: DataFrame, path: str, key: str = "job_id") -> DataFrame:
    """Append only rows whose key is not stored yet; returns what was appended.

    Only the key column of the stored table is read.  The anti join is a hash join on an
    id, so a hot source does not matter.  Of a table larger than ``LARGE_STORED`` only the
    keys that the batch may hold are joined (``seen.met``); the batch is then held.
    """
    from jobweave.operators.cleaning import keep_first
    from jobweave.sources.seen import held, met

    def append(fresh: DataFrame) -> DataFrame:
        fresh.write.mode("append").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).parquet(path)
        return fresh

    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":      # a stored table that cannot be read is not an empty one
            raise
        return append(keep_first(batch, [key]))
    stored = table.select(key)
    if int(table._jdf.queryExecution().analyzed().stats().sizeInBytes()) <= LARGE_STORED:
        return append(keep_first(batch, [key]).join(stored, key, "left_anti"))
    with held(batch):
        unseen = batch.join(met(stored, batch, key, batch.count()), key, "left_anti").select(*batch.columns)
        return append(keep_first(unseen, [key]))


def write_dated(df: DataFrame, path: str, source: str = "source_website", date: str = "crawl_date", mode: str = "append") -> None:
    """JSON lines in one folder per source and day, ``file={source}_jobs_{YYYY_MM_DD}``.

    No shuffle before the write: every task adds a file of its own to a folder, so
    a hot source is written by all tasks.  Rows without a source or a date go to
    the folder Spark names for NULL.
    """
    name = F.concat(F.col(source), F.lit("_jobs_"), F.date_format(F.col(date), "yyyy_MM_dd"))
    (df.withColumn("file", name).drop(source, date).write.mode(mode)
     .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).partitionBy("file").json(path))


def dated_name(source: str, date: str, ext: str = "jsonl") -> str:
    """``{source}_jobs_{YYYY_MM_DD}.{ext}`` for an ISO date."""
    return f"{source}_jobs_{date.replace('-', '_')}.{ext}"
