"""Token sequences materialised in training order.

Sequences are numbered 0..N-1 as they are cut; a keyed Feistel network over the
smallest even number of bits that holds N, walked on while it leaves 0..N-1, is a
permutation of 0..N-1 and gives each its slot without a sort or a shuffle of keys.
Slots are dealt to tasks by ranges: slots are dense, so the bounds are known without
a sample, and every file holds one run of shards, in the order of its name.  Every
shard is one row whose payload is a fixed number of records of fixed stride: slot k
lies in shard k // records at byte k % records * stride.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobweave.llm import shared, tokens
from jobweave.llm.textscan import U64, mix, slices

HEADER = np.dtype([("id", "<i8"), ("start", "<u4"), ("length", "<u4")])


@dataclass(frozen=True)
class Settings:
    """length: tokens of a sequence; records: sequences of a shard; width: bytes of an id (2 or 4); key of the order."""
    length: int = 256
    records: int = 2048
    width: int = 2
    key: int = 20240521
    rounds: int = 6

    @property
    def stride(self) -> int:
        return HEADER.itemsize + self.length * self.width


class Feistel:
    """A keyed permutation of 0..n-1 and its inverse."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        r = np.arange(1, rounds + 1, dtype=U64)
        self.keys = mix(r * U64(0x9E3779B97F4A7C15) ^ U64(key & 0xFFFFFFFFFFFFFFFF))

    def _walk(self, x: np.ndarray, keys, forward: bool) -> np.ndarray:
        x = np.asarray(x, U64).copy()
        low, h = U64((1 << self.half) - 1), U64(self.half)
        todo = np.arange(len(x))
        while len(todo):
            a, b = x[todo] >> h, x[todo] & low
            for k in keys:
                if forward:
                    a, b = b, a ^ (mix(b ^ k) & low)
                else:
                    a, b = b ^ (mix(a ^ k) & low), a
            x[todo] = (a << h) | b
            todo = todo[x[todo] >= U64(self.n)]          # outside 0..n-1: walk on along the cycle
        return x.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, self.keys, True)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], False)


def cutter(vocabulary: str, final: int, s: Settings):
    """(id, text) to (part, place, id, start, length, ids): sequences, numbered within the task."""
    def work(batches):
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for piece in slices(batch.column(1)):
                flat, first = tokens.encoder(vocabulary).encode(piece)
                if s.width == 2 and len(flat) and int(flat.max()) >= 1 << 16:
                    raise OverflowError("ids need 4 bytes")
                rows = []
                for k in range(piece.count):
                    own = np.append(flat[first[k]:first[k + 1]], np.uint32(final)).astype(f"<u{s.width}")
                    rows += [(ids[piece.row + k], a, own[a:a + s.length]) for a in range(0, len(own), s.length)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), part), pa.int32()), pa.array(np.arange(place, place + len(rows)), pa.int64()),
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([len(r[2]) for r in rows], pa.int32()), pa.array([r[2].tobytes() for r in rows], pa.binary())],
                    names=["part", "place", "id", "start", "length", "ids"])
                place += len(rows)
    return work


def writer(s: Settings):
    """Rows (shard, slot, id, start, length, ids) sorted by slot to shards (shard, first_slot, records, payload)."""
    def shard(number: int, count: int, payload: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([number * s.records], pa.int64()),
                                           pa.array([count], pa.int32()), pa.array([payload[:count].tobytes()], pa.binary())],
                                          names=["shard", "first_slot", "records", "payload"])

    def work(batches):
        at, count, payload = None, 0, None
        for batch in batches:
            shards, slots, ids, starts, lengths, raw = (batch.column(k).to_pylist() for k in range(6))
            for k in range(batch.num_rows):
                if shards[k] != at:
                    if at is not None:
                        yield shard(at, count, payload)
                    at, count, payload = shards[k], 0, np.zeros((s.records, s.stride), np.uint8)
                row = payload[slots[k] - at * s.records]
                row[:HEADER.itemsize] = np.array([(ids[k], starts[k], lengths[k])], HEADER).view(np.uint8)
                row[HEADER.itemsize:HEADER.itemsize + len(raw[k])] = np.frombuffer(raw[k], np.uint8)
                count += 1
        if at is not None:
            yield shard(at, count, payload)
    return work


def materialise(docs: DataFrame, vocabulary: str, path: str, final: int = 49407, id_col: str = "doc_id", text_col: str = "text",
                s: Settings = Settings()) -> int:
    """Write all documents as shards under `path`; the number of sequences.

    A document is its ids and the id `final`, cut into sequences of s.length; the
    last of a document is padded with 0 and its header has its length.  A null or
    empty text is one sequence of `final`; repeated rows are each written; a row
    with a null id is left out (a record names its document).  An empty table
    writes no shard.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    cut = shared.map_arrow(rows, cutter(vocabulary, final, s), "part int, place long, id long, start long, length int, ids binary")
    cut = shared.staged(cut, "sequences")
    counts = cut.groupBy("part").agg(F.count("*").alias("n"))           # as many rows as the scan has tasks
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("part", F.coalesce(before, F.lit(0)).alias("base"), "n").collect()
    total = max((r.base + r.n for r in counts), default=0)
    base = np.zeros(max((r.part for r in counts), default=0) + 1, np.int64)
    for r in counts:
        base[r.part] = r.base
    order, offsets = Feistel(total, s.key, s.rounds), docs.sparkSession.sparkContext.broadcast(base)

    def slotted(batches):
        for batch in batches:
            number = offsets.value[batch.column(0).to_numpy()] + batch.column(1).to_numpy()
            slot = order.slot(number)
            yield pa.RecordBatch.from_arrays([pa.array(slot // s.records), pa.array(slot), *(batch.column(k) for k in range(2, 6))],
                                             names=["shard", "slot", "id", "start", "length", "ids"])
    rows = shared.map_arrow(cut, slotted, "shard long, slot long, id long, start long, length int, ids binary")
    shards = -(-total // s.records)
    parts = max(1, min(shards, -(-total * s.stride // (64 << 20)), 1 << 16), min(shards, int(
        docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if total:
        rows = rows.repartitionById(parts, F.floor(F.col("shard") * parts / shards).cast("int")).sortWithinPartitions("slot")
    rows = shared.map_arrow(rows, writer(s), "shard long, first_slot long, records int, payload binary")
    rows.write.option("compression", "zstd").parquet(path)
    return total


def read(spark: SparkSession, path: str, first: int = 0, s: Settings = Settings()) -> DataFrame:
    """(slot, shard, byte, id, start, length, ids_crc32) of the sequences from slot `first` on, out of their payloads.

    A reader that stopped before slot k goes on with first=k: earlier shards are not read.
    """
    def work(batches):
        for batch in batches:
            for shard, begin, records, raw in zip(*(batch.column(k).to_pylist() for k in range(4))):
                rows = np.frombuffer(raw, np.uint8).reshape(records, s.stride)
                head = np.ascontiguousarray(rows[:, :HEADER.itemsize]).view(HEADER).ravel()
                ids = np.ascontiguousarray(rows[:, HEADER.itemsize:]).view(f"<u{s.width}").astype("<u4")
                crc = [zlib.crc32(x[:n].tobytes()) for x, n in zip(ids, head["length"])]
                slot = begin + np.arange(records)
                yield pa.RecordBatch.from_arrays([
                    pa.array(slot), pa.array(np.full(records, shard)), pa.array(np.arange(records) * s.stride), pa.array(head["id"]),
                    pa.array(head["start"].astype(np.int64)), pa.array(head["length"].astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["slot", "shard", "byte", "id", "start", "length", "ids_crc32"]).filter(pa.array(slot >= first))
    table = spark.read.schema("shard long, first_slot long, records int, payload binary").parquet(path)
    return shared.map_arrow(table.where(F.col("shard") >= first // s.records), work,
                            "slot long, shard long, byte long, id long, start long, length long, ids_crc32 long")
