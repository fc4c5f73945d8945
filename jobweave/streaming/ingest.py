"""Incremental ingest and live counts with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from jobweave import schema as S
from jobweave.sources.seen import SeenIds, append_unseen
from jobweave.sources.writers import append_new


def posting_stream(spark: SparkSession, path: str, schema: T.StructType = S.BRONZE, fmt: str = "json",
                   max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def dedup_within_watermark(stream: DataFrame, key: str = "job_id", time: str = "crawled_at",
                           delay: str = "30 days") -> DataFrame:
    """First record per id; an id is forgotten once the watermark has passed it,
    so the state is bounded by the ids of the last ``delay``."""
    stream = stream.withColumn(time, F.col(time).try_cast("timestamp"))
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def run_dedup(stream: DataFrame, out: str, checkpoint: str, **how) -> None:
    """Bounded-state form: watermark de-duplication into a Parquet table."""
    q = (dedup_within_watermark(stream, **how).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out))
    q.awaitTermination()


def run_append_new(stream: DataFrame, out: str, checkpoint: str, key: str = "job_id") -> None:
    """Unbounded-memory form: every micro batch is anti-joined with the stored ids.

    A batch that is retried after a failure finds its ids stored and adds nothing.
    """
    q = (stream.writeStream.foreachBatch(lambda df, _: append_new(df.sparkSession, df, out, key) and None)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def run_append_unseen(stream: DataFrame, out: str, checkpoint: str, store: SeenIds) -> None:
    """Unbounded-memory form for long histories: a micro batch reads the parts of the id store its ids fall into.

    A batch that is retried replaces its folder of ``out`` and its ids.
    """
    q = (stream.writeStream.foreachBatch(lambda df, number: append_unseen(df, out, store, number))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def live_counts(stream: DataFrame, ts: str, key: str, period: str = "7 days", delay: str = "1 day") -> DataFrame:
    return (stream.withWatermark(ts, delay).groupBy(F.window(ts, period).alias("w"), key)
            .agg(F.count("*").alias("n")).select(F.col("w.start").alias("period_start"), key, "n"))


def run_live_counts(stream: DataFrame, ts: str, key: str, out: str, checkpoint: str, **how) -> None:
    """Changed counts of each micro batch, tagged with the batch number."""
    def save(df: DataFrame, batch: int) -> None:
        # one folder per batch: a retried batch replaces what it wrote before
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = (live_counts(stream, ts, key, **how).writeStream.outputMode("update").foreachBatch(save)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_counts(spark: SparkSession, out: str, key: str) -> DataFrame:
    """Last written count per period and key."""
    try:
        log = spark.read.parquet(out)
    except AnalysisException:
        raise ValueError(f"no counts written to {out}") from None
    w = Window.partitionBy("period_start", key).orderBy(F.desc("batch"))
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("period_start", key, "n")
