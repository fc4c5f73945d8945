"""Balanced shards by vector bin packing.

Groups of equal texts are vectors (bytes, tokens, rows).  Groups are dealt to
cells by a hash; a cell streams its groups, largest first, into one bin per shard,
each into the bin whose residual capacity has the largest dot product with it.  The
bins of all cells, a number that does not depend on the data, are then packed into
the shards by the same rule, so that the imbalance of one cell offsets another's.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm import shared, textscan

DIMS = ("bytes", "tokens", "rows")


@dataclass(frozen=True)
class Settings:
    """cells: tasks that pack groups (cells * shards bins reach the driver: 1,024 here); slots: parts a shard is numbered in."""
    shards: int = 8
    cells: int = 128
    slots: int = 256


def measured(batches):
    """(id, text) to (id, size, crc, tokens, group): bytes plus 1, CRC-32, words, and the digest of the text."""
    for batch in batches:
        for part in textscan.slices(batch.column(1)):
            texts = [part.text(k) for k in range(part.count)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(part.row, part.count), pa.array(np.diff(part.offsets) + 1, pa.int64()),
                pa.array([zlib.crc32(t) for t in texts], pa.int64()), pa.array(np.diff(textscan.words(part).first), pa.int64()),
                pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())],
                names=["id", "size", "crc", "tokens", "group"])


class Bins:
    """Residual capacities of the bins, as shares of one bin's capacity in each dimension; bytes count most."""

    WEIGHTS = np.array([16.0, 1.0, 1.0])

    def __init__(self, n: int, total: np.ndarray):
        self.left = np.ones((n, len(total)))
        self.scale = n / np.maximum(total, 1)

    def place(self, item: np.ndarray) -> int:
        v = item * self.scale
        k = int(np.argmax(self.left @ (v * self.WEIGHTS)))
        self.left[k] -= v
        return k


def packer(n: int):
    """Groups (cell, total_bytes, total_tokens, total_rows, group, bytes, tokens, rows), a cell's largest first, to (group, cell, bin)."""
    def work(batches):
        at = bins = None
        for batch in batches:
            cell = batch.column(0).to_numpy()
            total = np.stack([batch.column(k).to_numpy() for k in (1, 2, 3)], 1)
            item = np.stack([batch.column(k).to_numpy() for k in (5, 6, 7)], 1).astype(float)
            found = np.zeros(len(cell), np.int32)
            for k in range(len(cell)):
                if cell[k] != at:
                    at, bins = cell[k], Bins(n, total[k])
                found[k] = bins.place(item[k])
            yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(0), pa.array(found)], names=["group", "cell", "bin"])
    return work


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(id, size, text_crc32, tokens, shard, slot) of every row.

    Equal texts go to one shard, unless they are over half a shard's share of bytes,
    tokens or rows: such a group (there can be 6 * shards of them) is first cut into
    pieces of about that by a hash of the id.  A null or empty text has size 1, no
    tokens and CRC 0; rows with null or repeated ids are each placed.  slot counts a
    shard's rows from 0 without gaps.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = shared.staged(shared.map_arrow(rows, measured, f"id {kind}, size long, crc long, tokens long, `group` binary"), "sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    total = np.array([total[d] or 0 for d in DIMS], float)
    share = [F.col(d) / float(max(t, 1)) for d, t in zip(DIMS, total)]
    large = rows.groupBy("group").agg(*sums).withColumn("share", F.greatest(*share)).where(F.col("share") > 0.5 / s.shards)
    large = large.select("group", F.ceil(F.col("share") * 2 * s.shards).alias("pieces"))
    rows = rows.join(F.broadcast(large), "group", "left")
    cut = F.unhex(F.md5(F.concat_ws("-", F.hex("group"), F.pmod(F.xxhash64("id"), F.col("pieces")).cast("string"))))
    rows = rows.withColumn("group", F.when(F.col("pieces") > 1, cut).otherwise(F.col("group"))).drop("pieces")
    groups = rows.groupBy("group").agg(*sums).withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(s.cells)))
    groups = shared.staged(groups, "groups")
    cells = groups.groupBy("cell").agg(*[F.sum(d).alias(f"all_{d}") for d in DIMS])
    dealt = groups.join(F.broadcast(cells), "cell").select("cell", *[f"all_{d}" for d in DIMS], "group", *DIMS)
    dealt = dealt.repartition("cell").sortWithinPartitions("cell", F.desc("bytes"), F.desc("rows"), "group")
    placed = shared.map_arrow(dealt, packer(s.shards), "`group` binary, cell long, bin int")
    placed = shared.staged(placed.join(groups.drop("cell"), "group"), "bins")
    loads = placed.groupBy("cell", "bin").agg(*[F.sum(d).alias(d) for d in DIMS]).collect()    # cells * shards rows at most
    loads.sort(key=lambda r: (-r.bytes, r.cell, r.bin))
    bins = Bins(s.shards, total)
    where = [(r.cell, r.bin, bins.place(np.array([r[d] for d in DIMS], float))) for r in loads]
    where = docs.sparkSession.createDataFrame(where, "cell long, bin int, shard int")
    placed = placed.join(F.broadcast(where), ["cell", "bin"]).select("group", F.col("rows").alias("c"), "shard")
    out = shared.attach(rows, placed, "group", "c", int(total[2]), F.unhex(F.md5(F.concat_ws("-", F.hex("group"), "id"))))
    out = shared.staged(out.withColumn("part", F.pmod(F.xxhash64("id", "crc"), F.lit(s.slots))), "shards")
    counts = out.groupBy("shard", "part").agg(F.count("*").alias("n"))                          # shards * slots rows at most
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "part", before.alias("base"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc"))
    out = out.withColumn("place", place).join(F.broadcast(counts), ["shard", "part"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "tokens", "shard",
                      (F.col("base") + F.col("place") - 1).alias("slot"))


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> None:
    """Write docs as one folder per shard (ids must be distinct and not null)."""
    where = assign(docs, id_col, text_col, s).select(F.col(id_col).alias("__id"), "shard", "slot")
    rows = docs.join(where, F.col(id_col) == F.col("__id")).drop("__id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
