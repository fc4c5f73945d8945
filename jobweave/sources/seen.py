"""Ids stored so far, cut by hash: a batch reads only the parts its own ids fall into.

    <path>/recent/batch=<number>/         ids of one batch, not cut
    <path>/parts/made=<k>/bucket=<b>/     ids of all earlier batches, cut by hash

`fresh` looks a batch up, `record` stores its ids, `merge` moves the recent ids to
the parts and joins small files there, `rewrite` writes all parts anew.  A batch is known by its number, and its
own ids are left out of its look-up, so that a batch that is repeated after a failure
finds the same rows fresh and replaces what it wrote.  All are sets of ids: an id that
is stored twice, by a merge that was broken off, changes nothing.
"""

from __future__ import annotations

import re
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobweave.operators.cleaning import keep_first

BUCKETS = 256
MERGE_AT = 16
#: Files of a bucket, on average, beyond which a merge joins the small ones.
FILES = 6
#: Rows of a batch whose hashes are sent to the stored ids, some 64 bytes each.
SENT_ROWS = 1_000_000


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, empty where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def held(batch: DataFrame):
    """The batch is kept while it is used more than once; one that is kept already stays so."""
    level = batch.storageLevel
    mine = not (level.useMemory or level.useDisk or level.useOffHeap)
    if mine:
        batch.persist()
    try:
        yield
    finally:
        if mine:
            batch.unpersist()


def met(stored: DataFrame, batch: DataFrame, key: str, rows: int) -> DataFrame:
    """Those of the stored ids that a batch of so many rows may hold: all it does hold, and any of an equal hash.

    The hashes of the batch go to the stored ids, at most ``SENT_ROWS`` of them, so that
    no stored id is shuffled or sorted.  A larger batch takes all stored ids, as it
    is joined with them once in any case.
    """
    if rows > SENT_ROWS or stored.schema[key].dataType != batch.schema[key].dataType:
        return stored
    hashed = F.xxhash64(F.col(f"`{key}`")).alias("_hash")
    sent = batch.where(F.col(f"`{key}`").isNotNull()).select(hashed)
    return stored.select(key, hashed).join(F.broadcast(sent), "_hash", "left_semi").select(key)


@dataclass(frozen=True)
class SeenIds:
    """The id store of one table.

    ``buckets`` must stay as it was when the store was made; ``merge_at`` batches are
    kept as recent before they move to the parts, so a look-up reads at most as many
    whole batches of ids, and of everything older only the batch's buckets.
    Rows without an id are never seen before.
    """

    path: str
    key: str = "job_id"
    dtype: str = "string"
    buckets: int = BUCKETS
    merge_at: int = MERGE_AT

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def recent_batches(self, spark: SparkSession) -> list[int]:
        """Numbers of the batches whose ids are stored whole (the writer marks a finished one)."""
        found = [int(m[1]) for n in _names(spark, f"{self.path}/recent") if (m := re.fullmatch(r"batch=(\d+)", n))]
        return sorted(b for b in found if _exists(spark, f"{self.path}/recent/batch={b}/_SUCCESS"))

    def parts(self, spark: SparkSession) -> str | None:
        """Folder of the newest complete set of parts."""
        made = [int(m[1]) for n in _names(spark, f"{self.path}/parts") if (m := re.fullmatch(r"made=(\d+)", n))]
        whole = [k for k in made if _exists(spark, f"{self.path}/parts/made={k}/_SUCCESS")]
        return f"{self.path}/parts/made={max(whole)}" if whole else None

    def _schema(self, bucket: bool) -> T.StructType:
        return T.StructType.fromDDL(f"`{self.key}` {self.dtype}" + (", bucket int" if bucket else ""))

    def _recent(self, spark: SparkSession, batches: list[int]) -> DataFrame:
        return spark.read.schema(self._schema(False)).parquet(*[f"{self.path}/recent/batch={b}" for b in batches])

    def stored(self, spark: SparkSession, touched: list[int] | None = None, before: int | None = None) -> DataFrame | None:
        """Stored ids (one column, may repeat): all, or those in the touched buckets and of batches below ``before``."""
        out = None
        if (parts := self.parts(spark)) is not None:
            out = spark.read.schema(self._schema(True)).parquet(parts)
            every = touched is None or len(touched) == self.buckets
            out = (out if every else out.where(F.col("bucket").isin(touched))).select(self.key)
        batches = [b for b in self.recent_batches(spark) if before is None or b < before]
        if batches:
            recent = self._recent(spark, batches)
            out = recent if out is None else out.unionByName(recent)
        return out

    def fresh(self, batch: DataFrame, number: int) -> DataFrame:
        """One row per id of the batch that no earlier batch had, rows without id as they are.

        To the driver come the buckets touched and their rows, at most ``buckets``.  The
        stored ids are reduced to those of the batch first (``met``).
        """
        spark = batch.sparkSession
        has_id = F.col(self.key).isNotNull()
        rows = batch.where(has_id)
        touched = {r.b: r.n for r in rows.groupBy(self.bucket().alias("b")).agg(F.count("*").alias("n")).collect()}
        stored = self.stored(spark, sorted(touched), number)
        if stored is not None:
            rows = rows.join(met(stored, rows, self.key, sum(touched.values())), self.key, "left_anti").select(*batch.columns)
        return keep_first(rows, [self.key]).unionByName(batch.where(~has_id))

    def record(self, rows: DataFrame, number: int) -> None:
        """Store the ids of the rows as those of one batch, in place of what the batch stored before."""
        ids = rows.select(F.col(self.key).cast(self.dtype)).where(F.col(self.key).isNotNull())
        ids.write.mode("overwrite").parquet(f"{self.path}/recent/batch={number}")

    def merge(self, spark: SparkSession, before: int) -> None:
        """Add the recent ids of batches below ``before`` to the parts, as one file a bucket, then remove them there.

        Of the stored parts only small files are read and written again; ``before`` is the
        batch about to run, all earlier ones are complete and never repeated.
        """
        batches = [b for b in self.recent_batches(spark) if b < before]
        if not batches:
            return
        self._write(self._recent(spark, batches), self.parts(spark) or f"{self.path}/parts/made=0", "append")
        for b in batches:
            _delete(spark, f"{self.path}/recent/batch={b}")
        self._join_small(spark)

    def _join_small(self, spark: SparkSession) -> None:
        """Where buckets have more than ``FILES`` files, join those of at most a quarter of a bucket's bytes.

        A joined file is larger, so an id is written again a number of times that grows with
        the logarithm of the merges.  Files go once their ids are written; broken
        off between the two, ids are stored twice.
        """
        path = self.parts(spark)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        whole = fs.getContentSummary(at)
        folders = max(whole.getDirectoryCount() - 1, 1)
        if whole.getFileCount() <= FILES * folders:
            return
        parts = spark.read.schema(self._schema(True)).parquet(path)
        small = parts.where(F.col("_metadata.file_size") <= whole.getLength() // folders // 4)
        joined = [r[0] for r in small.select("_metadata.file_path").distinct().collect()]
        self._write(small.select(self.key), path, "append")
        for f in joined:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)), False)

    def rewrite(self, spark: SparkSession) -> None:
        """Write all parts anew, each id once; not while another job uses the store.

        The new set counts once it is complete, and only then the older ones go.
        """
        old = self.parts(spark)
        if old is None:
            return
        number = int(old.rsplit("=", 1)[1])
        self._write(spark.read.schema(self._schema(True)).parquet(old).select(self.key).distinct(),
                    f"{self.path}/parts/made={number + 1}", "overwrite")
        for n in _names(spark, f"{self.path}/parts"):
            if (m := re.fullmatch(r"made=(\d+)", n)) and int(m[1]) <= number:
                _delete(spark, f"{self.path}/parts/{n}")

    def _write(self, ids: DataFrame, path: str, mode: str) -> None:
        cut = ids.withColumn("bucket", self.bucket()).repartition("bucket")
        cut.write.mode(mode).partitionBy("bucket").parquet(path)


def append_unseen(batch: DataFrame, out: str, store: SeenIds, number: int) -> None:
    """Write the batch's fresh rows to ``out/batch=<number>`` and their ids to the store.

    Rows go first: a run that is broken off between the two is repeated whole.  The
    batch is held in memory or on the executors' disks while it is used, with its
    lineage, so a lost executor costs time only.
    """
    spark = batch.sparkSession
    if len(store.recent_batches(spark)) >= store.merge_at:
        store.merge(spark, number)
    with held(batch):
        folder = f"{out}/batch={number}"
        store.fresh(batch, number).write.mode("overwrite").parquet(folder)
        store.record(spark.read.schema(batch.schema).parquet(folder), number)
