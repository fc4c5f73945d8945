"""Packing documents into token windows by deficit round-robin over source queues.

The tokens of each source over all documents are summed first and give the target
shares.  The documents of a source, in order of a hash, are one line of tokens that
is cut into as many even segments as there are buckets of a bounded size; so every
bucket holds every source in the corpus's proportions to within a quantum, however
long or rare its documents, and its deficits start at 0.  In a bucket every source is a
queue; each window adds the target share of its length to every queue's deficit
and queues are served in turn up to their deficits, cutting documents where the
window ends.  Deficits go on from window to window.  What does not fill a bucket's
last window goes, with the deficits, to a second round that packs the rests of
many buckets; only its last windows are padded.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm import shared, tokens

COLUMNS = [("kind", pa.int32()), ("source", pa.string()), ("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
           ("crc", pa.int64()), ("n", pa.int64()), ("sequence_id", pa.int64()), ("place", pa.int64()), ("ids", pa.binary()),
           ("deficit", pa.float64()), ("share", pa.float64())]
SCHEMA = ("kind int, source string, id long, start long, length long, crc long, n long, sequence_id long, place long, "
          "ids binary, deficit double, share double")
PIECE, REST, DEFICIT = 0, 1, 2
BASE = 0            # kind of the rows that say where a source's line of tokens begins in a hash bucket


@dataclass(frozen=True)
class Settings:
    """mixture: target share of each source (others share what is left evenly by tokens); None: as in the corpus,
    by the tokens of all documents.

    bucket_bytes: text a task holds at once; rests: buckets whose rests are packed
    together; quantum: fewest tokens a queue is served, where it has as many.
    """
    window: int = 4096
    mixture: tuple[tuple[str, float], ...] | None = None
    bucket_bytes: int = 8 << 20
    rests: int = 256
    quantum: int = 128


class Queues:
    """Source queues of (id, start, n, ids) segments, served by deficit round-robin."""

    def __init__(self, s: Settings):
        self.s = s
        self.queues: dict[str, deque] = {}
        self.left: dict[str, int] = {}
        self.deficit: dict[str, float] = {}
        self.share: dict[str, float] = {}

    def put(self, source: str, segment: tuple, share: float) -> None:
        self.queues.setdefault(source, deque()).append(segment)
        self.left[source] = self.left.get(source, 0) + len(segment[3])
        self.share[source] = share

    def _take(self, source: str, most: int):
        """Up to `most` tokens of the queue's first segment: (id, start, n, ids)."""
        q = self.queues[source]
        i, start, n, ids = q[0]
        part = ids[:most]
        if len(part) == len(ids):
            q.popleft()
        else:
            q[0] = (i, start + most, n, ids[most:])
        self.left[source] -= len(part)
        self.deficit[source] -= len(part)
        return source, i, start, n, part

    def windows(self, last: bool):
        """Lists of segments that fill a window each; the rest stays queued unless `last`."""
        total, s = sum(self.left.values()), self.s
        shares = self.share if total else {}
        order = sorted(shares)
        for k in order:
            self.deficit.setdefault(k, 0.0)
        turn = 0
        while total >= s.window or (last and total):
            space, out = min(s.window, total), []
            live = [k for k in order if self.left[k]]
            scale = sum(shares[k] for k in live) or 1.0
            for k in live:
                self.deficit[k] += (shares[k] / scale if sum(shares[k] for k in live) else 1 / len(live)) * space
            live = live[turn % len(live):] + live[:turn % len(live)]
            for k in live:
                due = min(space, max(int(self.deficit[k]), s.quantum)) if self.deficit[k] >= 1 else 0
                while due and self.left[k]:
                    out.append(self._take(k, due))
                    due -= len(out[-1][4])
                    space -= len(out[-1][4])
            while space:        # quanta and cut deficits leave some space: it goes to who has most to get
                k = max((k for k in live if self.left[k]), key=lambda k: (self.deficit[k], k))
                out.append(self._take(k, min(space, max(s.quantum, int(self.deficit[k])))))
                space -= len(out[-1][4])
            total = sum(self.left.values())
            turn += 1
            yield out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(cols, COLUMNS)], names=[n for n, _ in COLUMNS])


def _packed(q: Queues, base: int, last: bool):
    """Rows of the windows of q, numbered from `base`, then of what stays queued and of the deficits (sequence_id: base)."""
    rows = []
    for number, window in enumerate(q.windows(last)):
        place = 0
        merged: list[list] = []
        for source, i, start, n, ids in window:      # one source's turns may meet in one document
            if merged and merged[-1][1] == i and merged[-1][2] + len(merged[-1][4]) == start and merged[-1][0] == source:
                merged[-1][4] = np.concatenate([merged[-1][4], ids])
            else:
                merged.append([source, i, start, n, ids])
        for source, i, start, n, ids in merged:
            rows.append((PIECE, source, i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, base + number, place,
                         None, None, None))
            place += len(ids)
        if len(rows) >= 5000:
            yield _batch(rows)
            rows = []
    for source, queue in q.queues.items():
        for i, start, n, ids in queue:
            rows.append((REST, source, i, start, len(ids), None, n, base, None, bytes([4]) + ids.tobytes(), None, q.share[source]))
    for source, d in q.deficit.items():
        if d and not last:
            rows.append((DEFICIT, source, None, None, None, None, None, base, None, None, d, None))
    if rows:
        yield _batch(rows)


def _grouped(batches, s: Settings, base, last: bool):
    """Rows (group, kind, source, id, start, n, ids, deficit, share) sorted by group, packed group by group."""
    at, q = None, None
    for batch in batches:
        group, kind, source, ident, start, n, ids, deficit, share = (batch.column(k).to_pylist() for k in range(9))
        for k in range(batch.num_rows):
            if q is None or group[k] != at:
                if q is not None:
                    yield from _packed(q, base(at), last)
                at, q = group[k], Queues(s)
            name = source[k] or ""
            if kind[k] == DEFICIT:
                q.deficit[name] = q.deficit.get(name, 0.0) + deficit[k]
            else:
                q.put(name, (ident[k], start[k], n[k], tokens.unpacked(ids[k])), share[k])
    if q is not None:
        yield from _packed(q, base(at), last)


def targets(encoded: DataFrame, s: Settings):
    """Target share of a source by its name and its tokens."""
    given = dict(s.mixture or ())
    named = F.col("source").isin(list(given)) if given else F.lit(False)
    total, others = (x or 0 for x in encoded.agg(F.sum("n"), F.sum(F.when(~named, F.col("n")))).first())
    met = [r[0] for r in encoded.where(named).select("source").distinct().collect()]       # as many as `mixture` names
    rest = max(0.0, 1 - sum(given[k] for k in met)) if given else 1.0
    return lambda name, n: given[name] if name in given else rest * n / max(1, others if given else total)


def dealer(buckets: int, share, s: Settings):
    """Rows (bucket, source, kind, id, n, ids, base, total) in this order to segments (bucket, kind, source, id, start, n, ids, deficit, share, place).

    A source's line of `total` tokens is cut near total * k / buckets, at multiples of
    the quantum, and its segments go round the buckets from one that its name gives.
    """
    names = ["bucket", "kind", "source", "id", "start", "n", "ids", "deficit", "share", "place"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int64()]

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names=names)

    def work(batches):
        at, total, part, turn, rows, held = 0, 0, 0.0, 0, [], 0
        for batch in batches:
            _, source, kind, ident, n, ids, base, whole = (batch.column(k).to_pylist() for k in range(8))
            for k in range(batch.num_rows):
                if kind[k] == BASE:
                    at, total = base[k], whole[k]
                    part, turn = share(source[k], total), zlib.crc32(source[k].encode())
                    continue
                width, done = ids[k][0], 0
                while done < n[k] or not n[k]:
                    step = (at // s.quantum + 1) * s.quantum
                    place = min(buckets - 1, -(-step * buckets // max(1, total)) - 1)   # the last segment that begins by `at`
                    end = total if place == buckets - 1 else (total * (place + 1) // buckets) // s.quantum * s.quantum
                    size = min(n[k] - done, end - at)
                    rows.append(((place + turn) % buckets, REST, source[k], ident[k], done, n[k],
                                 ids[k][:1] + ids[k][1 + width * done:1 + width * (done + size)], None, part, at))
                    at, done, held = at + size, done + size, held + width * size
                    if len(rows) >= 5000 or held > 4 << 20:
                        yield emit(rows)
                        rows, held = [], 0
                    if not n[k]:
                        break
        yield emit(rows)
    return work


def pack(docs: DataFrame, vocabulary: str, final: int | None = 2, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", s: Settings = Settings()) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source): pieces of all documents.

    A document is its ids by `vocabulary` with the id `final` after them; every id is
    in one piece.  A null or empty text is that last id alone, a null source a queue
    of its own, and repeated rows are packed each.  Only the three named columns are
    read.  An empty table gives no pieces.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-(size[0] + 8 * size[1]) // s.bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(buckets)))
    encoded = shared.map_arrow(rows.select("text", "bucket", "id", "source"), tokens.packed(vocabulary, final, ["bucket", "id", "source"]),
                               "bucket long, id long, source string, n long, ids binary")
    encoded = shared.staged(encoded, "encoded")
    line = Window.partitionBy("source")
    before = F.sum("n").over(line.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = encoded.groupBy("source", "bucket").agg(F.sum("n").alias("n"))
    bases = bases.select("bucket", "source", F.lit(BASE).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("n"),
                         F.lit(None).cast("binary").alias("ids"), F.coalesce(before, F.lit(0)).alias("base"), F.sum("n").over(line).alias("total"))
    whole = encoded.select("bucket", "source", F.lit(REST).alias("kind"), "id", "n", "ids", F.lit(None).cast("long").alias("base"),
                           F.lit(None).cast("long").alias("total"))
    # all columns order the rows, so that a task run again deals alike
    dealt = whole.union(bases).repartition(_tasks(encoded, buckets), "bucket").sortWithinPartitions("bucket", "source", "kind", "id", "n", "ids")
    dealt = shared.map_arrow(dealt, dealer(buckets, targets(encoded, s), s), "bucket long, kind int, source string, id long, start long, "
                             "n long, ids binary, deficit double, share double, place long")
    first = dealt.repartition(_tasks(encoded, buckets), "bucket").sortWithinPartitions("bucket", "source", "place", "n").drop("place")
    first = shared.map_arrow(first, lambda b: _grouped(b, s, lambda g: g << 32, False), SCHEMA)
    first = shared.staged(first, "packed")
    rest = first.where(F.col("kind") != PIECE)
    group = F.floor(F.shiftright("sequence_id", 32) / s.rests)
    rest = rest.select(group.alias("bucket"), "kind", "source", "id", "start", "n", "ids", "deficit", "share")
    second = rest.repartition("bucket").sortWithinPartitions("bucket", "kind", "source", "id", "start")
    second = shared.map_arrow(second, lambda b: _grouped(b, s, lambda g: (1 << 62) + (g << 32), True), SCHEMA)
    out = first.where(F.col("kind") == PIECE).union(second.where(F.col("kind") == PIECE))
    return out.select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
                      "sequence_id", F.col("place").alias("offset"), "source")


def _tasks(df: DataFrame, groups: int) -> int:
    """Tasks for so many groups: no more than there are, and no fewer than the session's shuffle partitions if it can be."""
    return int(max(1, min(groups, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // 8))))
