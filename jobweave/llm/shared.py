"""Helpers of the operators: staged tables, exact attachment under hot keys, connected components."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import jobweave
from jobweave.plans.warehouse import shared_dir

#: A key is heavy when it holds at least this share of all rows; so at most 1 / HEAVY_SHARE keys are heavy.
HEAVY_SHARE = 1 / 1000
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder all executors share and read it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/jobweave-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package's source, once per application (as --py-files does)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(jobweave.__path__[0]))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, names in os.walk(jobweave.__path__[0]):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    path = os.path.join(tempfile.mkdtemp(prefix="jobweave-"), "jobweave_source.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def map_arrow(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)


def attach(left: DataFrame, right: DataFrame, key: str, count: str, rows: int, filler: Column) -> DataFrame:
    """Left join on `key` where few keys may hold most rows of `left`.

    `right` has one row per key with the number `count` of left rows of that key.
    Keys of at least HEAVY_SHARE * rows left rows are at most 1 / HEAVY_SHARE many:
    their list filters the rows they match, which meet them in a broadcast join, and
    all other rows go through a shuffled join in which no key has more rows than
    that.  Null keys go under `filler`, values that are spread and match nothing.
    """
    names = [c for c in right.columns if c not in (key, count)]
    right = staged(right, "keys")
    is_heavy = F.col(count) >= max(2.0, rows * HEAVY_SHARE)
    heavy = [r[0] for r in right.where(is_heavy).select(key).collect()]
    light = right.where(~is_heavy).select(F.col(key).alias("__key"), *names)

    def shuffled(part: DataFrame) -> DataFrame:
        part = part.withColumn("__key", F.coalesce(F.col(key), filler))
        return part.join(light, "__key", "left").select(*left.columns, *names)
    if not heavy:
        return shuffled(left)
    hit = F.coalesce(F.col(key).isin([bytes(k) if isinstance(k, bytearray) else k for k in heavy]), F.lit(False))
    met = left.where(hit).join(F.broadcast(right.where(is_heavy).drop(count)), key, "left").select(*left.columns, *names)
    return shuffled(left.where(~hit)).union(met)


def star_rows(pairs: DataFrame, payload: DataFrame, block: int = 256) -> DataFrame:
    """Rows (centre, block, id, payload) of pairs (a, b) for one streaming pass over each centre b.

    `payload` has one row per `id`.  The pairs of a centre are cut into blocks of
    about `block`, or of HEAVY_SHARE of all pairs where that is more, and the
    centre's own row comes first in every block; a task holds one centre's row and
    streams the others, however many pairs the centre has.
    """
    total = pairs.count()
    size = max(block, int(total * HEAVY_SHARE))
    counts = pairs.groupBy("b").agg(F.count("*").alias("c"))
    counts = counts.withColumn("blocks", F.ceil(F.col("c") / size).cast("long"))
    cut = attach(pairs.select("a", "b"), counts, "b", "c", total, -1 - F.abs(F.xxhash64("a")))
    asked = cut.select(F.col("b").alias("centre"), F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"),
                       F.col("a").alias("id"))
    own = counts.select(F.col("b").alias("centre"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
                        F.col("b").alias("id"))
    rows = asked.union(own).join(payload, "id")
    rows = rows.select("centre", "block", "id", *[c for c in payload.columns if c != "id"])
    return rows.repartition("centre", "block").sortWithinPartitions("centre", "block", F.col("id") != F.col("centre"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable over `edges` (a, b).

    Star contraction: every round links each node's larger neighbours to its
    smallest one, then each node to the smallest of its smaller neighbours, until
    nothing changes.  Only minima per node are aggregated, so a node with very many
    edges is merged before the shuffle; every round is written to the shared folder.
    """
    def undirected(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    both = undirected(edges.where(F.col("a") != F.col("b")))
    e = staged(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large star: for every node the larger neighbours go to the smallest of node and neighbours
        rows = e.count()
        if not rows:
            break
        both = undirected(e)
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = attach(both, low, "a", "n", 2 * rows, -1 - F.abs(F.xxhash64("b"))).where(F.col("b") > F.col("a"))
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        # small star: the smaller neighbours and the node itself go to the smallest of them
        large = staged(large, "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = attach(large, down, "a", "n", rows, -1 - F.abs(F.xxhash64("b")))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        e = staged(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))

