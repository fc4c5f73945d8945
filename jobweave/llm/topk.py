"""Exact top-k inner products by ball-tree branch and bound.

Vectors are dealt into shards; each task builds a ball tree over its shard and
searches it for one bounded block of queries.  A node's inner products with a
query are at most q . centre + |q| * radius; nodes are taken in falling order of
that bound and a query leaves a node out once the bound is below its k-th score.
The k-th scores start from a first pass over a small sample of the vectors, which
every shard then shares, so most shards prune from their first node on.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm import shared


@dataclass(frozen=True)
class Settings:
    """k hits a query; components are floor(scale * x).

    shard_rows: vectors of a shard; query_block: queries that meet a shard at once
    (4,096 of 1,000 components are 32 MB); leaf: vectors compared at once;
    first_modulus: one vector in so many gives the first k-th scores; wide_rows: rows
    of each side that meet at once where whole numbers of any size are needed.
    """
    k: int = 5
    scale: int = 256
    shard_rows: int = 4096
    query_block: int = 4096
    leaf: int = 256
    first_modulus: int = 64
    wide_rows: int = 512


def finite(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) with components as doubles; rows with a null id, or a null or empty vector, or a null or non-finite component, are left out."""
    x = F.col(vector_col)
    good = (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: e.cast("double")).alias("x"))
    return rows.groupBy("id").agg(F.min("x").alias("x"))


def is_wide(scale: int):
    """May an inner product with such a vector need more than the 53 bits of a double?"""
    top = F.aggregate("x", F.lit(0.0), lambda a, e: F.greatest(a, F.abs(e)))
    return top >= F.sqrt(F.lit(2.0 ** 52) / F.size("x")) / float(scale) - 1


def whole(rows: DataFrame, scale: int) -> DataFrame:
    """(id, v): integer components of vectors that are not wide."""
    return rows.select("id", F.transform("x", lambda e: F.floor(F.lit(float(scale)) * e)).alias("v"))


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray | None
    parts: tuple


def ball_tree(x: np.ndarray, rows: np.ndarray, leaf: int) -> Node:
    """Halve at the median along the line between two far points until `leaf` vectors are left."""
    own = x[rows]
    centre = own.mean(axis=0)
    gaps = ((own - centre) ** 2).sum(axis=1)
    radius = float(np.sqrt(gaps.max())) if len(rows) else 0.0
    if len(rows) <= leaf or radius == 0.0:
        return Node(centre, radius, rows, ())
    one = own[gaps.argmax()]
    two = own[((own - one) ** 2).sum(axis=1).argmax()]
    order = np.argsort(own @ (two - one), kind="stable")
    half = len(rows) // 2
    return Node(centre, radius, None, tuple(ball_tree(x, rows[order[p]], leaf) for p in (slice(0, half), slice(half, None))))


def _better(best_s, best_i, scores, ids, k):
    """Merge candidates into the k best of each query: higher score, then smaller id."""
    s = np.concatenate([best_s, scores], axis=1)
    i = np.concatenate([best_i, np.broadcast_to(ids, scores.shape)], axis=1)
    if s.shape[1] > 4 * k:          # keep what reaches the k-th score, ties included
        bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        width = int((s >= bar[:, None]).sum(axis=1).max())
        keep = np.argsort(~(s >= bar[:, None]), axis=1, kind="stable")[:, :max(k, width)]
        s, i = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, bar: np.ndarray, s: Settings):
    """Best k (scores, ids) of each query in x (float64 holding integers), among scores of at least `bar`.

    Slots without a hit have score -inf.
    """
    best_s = np.full((len(q), s.k), -np.inf)
    best_i = np.full((len(q), s.k), np.iinfo(np.int64).max)
    if not len(x) or not len(q):
        return best_s, best_i
    norm = np.sqrt((q ** 2).sum(axis=1))
    kth = bar.astype(float).copy()
    slack = 1e-9

    def bounds(node, who):
        raw = q[who] @ node.centre
        return raw + norm[who] * node.radius + slack * (np.abs(raw) + norm[who] * (node.radius + 1)) + 1e-6
    root = ball_tree(x, np.arange(len(x)), s.leaf)
    everyone = np.arange(len(q))
    top = bounds(root, everyone)
    heap, n = [(-float(top.max()), 0, root, everyone, top)], 1
    while heap:
        _, _, node, who, bound = heapq.heappop(heap)
        live = bound >= kth[who]
        who = who[live]
        if not len(who):
            continue
        if node.rows is None:
            for part in node.parts:
                b = bounds(part, who)
                on = b >= kth[who]
                if on.any():
                    heapq.heappush(heap, (-float(b[on].max()), n, part, who[on], b[on]))
                    n += 1
            continue
        scores = q[who] @ x[node.rows].T
        own = ids[node.rows]
        scores[qids[who][:, None] == own[None, :]] = -np.inf
        scores[scores < kth[who][:, None]] = -np.inf
        best_s[who], best_i[who] = _better(best_s[who], best_i[who], scores, own, s.k)
        kth[who] = np.maximum(kth[who], best_s[who, -1])
    return best_s, best_i


def _found(rows: list[tuple], s: Settings):
    """One shard and block of queries, rows (side, id, v, bar), searched length by length."""
    for d in sorted({len(r[2]) for r in rows if r[0] == 0}):
        asked = [r for r in rows if r[0] == 0 and len(r[2]) == d]
        own = [r for r in rows if r[0] == 1 and len(r[2]) == d]
        if not own:
            continue
        x, q = (np.array([r[2] for r in side], float).reshape(len(side), d) for side in (own, asked))
        ids, qids = (np.array([r[1] for r in side], np.int64) for side in (own, asked))
        score, at = search(x, ids, q, qids, np.array([r[3] for r in asked], float), s)
        r, c = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(qids[r]), pa.array(at[r, c]), pa.array(score[r, c].astype(np.int64))],
                                         names=["query_id", "vec_id", "score"])


def searcher(s: Settings):
    """Rows (shard, block, side, id, v, bar) sorted by shard and block to (query_id, vec_id, score)."""
    def work(batches):
        at, rows = None, []
        for batch in batches:
            shard, block, *rest = (batch.column(k).to_pylist() for k in range(6))
            for key, row in zip(zip(shard, block), zip(*rest)):
                if key != at:
                    yield from _found(rows, s)
                    at, rows = key, []
                rows.append(row)
        yield from _found(rows, s)
    return work


def _candidates(vectors: DataFrame, queries: DataFrame, s: Settings, n: int, asked: int) -> DataFrame:
    """(query_id, vec_id, score): each shard's best for each query (id, v, bar)."""
    shards = max(1, -(-n // s.shard_rows))
    blocks = max(1, -(-asked // s.query_block))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    x = vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), each(blocks).alias("block"),
                       F.lit(1).alias("side"), "id", "v", F.lit(float("-inf")).alias("bar"))
    q = queries.select(each(shards).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
                       F.lit(0).alias("side"), "id", "v", "bar")
    rows = x.union(q).repartition("shard", "block").sortWithinPartitions("shard", "block", "side")
    return shared.map_arrow(rows, searcher(s), "query_id long, vec_id long, score long")


LONG = 1 << 63


def _large(n: int) -> str:
    """A text that sorts, among equal scores held within 64 bits, as the whole numbers do."""
    if -LONG <= n < LONG:
        return "~" if n == -LONG else ""
    digits = str(abs(n))
    if n > 0:
        return f"{len(digits):04d}{digits}"
    return f"{9999 - len(digits):04d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _integers(x: list[float], scale: int) -> list[int]:
    return [int(Fraction(e) * scale // 1) for e in x]


def scanner(s: Settings):
    """Rows (shard, block, side, id, x) to the best (query_id, vec_id, score, large) of each query, in whole numbers of any size.

    Doubles, with vectors scaled to length one, first tell which products can be among
    the best; only these are multiplied exactly.
    """
    def found(rows):
        for d in sorted({len(r[1]) for r in rows if r[0] == 0}):
            asked, own = ([r for r in rows if r[0] == side and len(r[1]) == d] for side in (0, 1))
            if not own:
                continue
            x = [_integers(r[1], s.scale) for r in own]
            size = [max(map(abs, v)) or 1 for v in x]
            unit = np.array([[float(Fraction(e, m)) for e in v] for v, m in zip(x, size)])
            # a product is unit . unit times powers of two, of which the largest is taken out: none overflows
            log = np.array([math.log2(m) for m in size])
            log -= log.max()
            for _, qx, qid in asked:
                q = _integers(qx, s.scale)
                m = max(map(abs, q)) or 1
                near = unit @ np.array([float(Fraction(e, m)) for e in q])
                error = np.exp2(log) * (4e-16 * d * d + 1e-9 * np.abs(near)) + 1e-300
                low, high = near * np.exp2(log) - error, near * np.exp2(log) + error
                others = np.array([r[2] != qid for r in own])
                bar = np.sort(low[others])[-s.k] if others.sum() >= s.k else -np.inf
                hits = [(sum(a * b for a, b in zip(q, x[k])), own[k][2]) for k in np.flatnonzero(others & (high >= bar))]
                for n, i in sorted(hits, key=lambda h: (-h[0], h[1]))[:s.k]:
                    yield qid, i, max(-LONG, min(LONG - 1, n)), _large(n)

    def work(batches):
        at, rows = None, []
        for batch in batches:
            shard, block, side, who, x = (batch.column(k).to_pylist() for k in range(5))
            for key, row in zip(zip(shard, block), zip(side, x, who)):
                if key != at:
                    yield from _scanned(found(rows))
                    at, rows = key, []
                rows.append(row)
        yield from _scanned(found(rows))
    return work


def _scanned(rows) -> Iterator[pa.RecordBatch]:
    cols = list(zip(*rows))
    if cols:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["query_id", "vec_id", "score", "large"])


def _scan(vectors: DataFrame, queries: DataFrame, s: Settings, n: int, asked: int) -> DataFrame:
    """(query_id, vec_id, score, large) of pairs of which one side is wide, in bounded blocks of both."""
    shards, blocks = max(1, -(-n // s.wide_rows)), max(1, -(-asked // s.wide_rows))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    x = vectors.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), each(blocks).alias("block"), F.lit(1).alias("side"), "id", "x")
    q = queries.select(each(shards).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), "id", "x")
    rows = x.union(q).repartition("shard", "block").sortWithinPartitions("shard", "block", "side")
    return shared.map_arrow(rows, scanner(s), "query_id long, vec_id long, score long, large string")


def _best(found: DataFrame, s: Settings) -> DataFrame:
    # among scores held within 64 bits `large` decides
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("large"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k)


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
          s: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with all other vectors.

    Ties go to the smaller id; a query with fewer than k other vectors gets all.
    Vectors that are null or empty or hold null or non-finite components take no part, nor do
    null ids; a repeated id counts once, by its smallest vector; vectors of different lengths are never
    compared.  Vectors whose products may not fit the 53 bits of a double are few in practice
    and go another way: their pairs are bounded with doubles block by block and the candidates
    multiplied as whole numbers.  They rank exactly; a score beyond 64 bits is reported as the
    nearest 64-bit number.
    """
    every = shared.staged(finite(vectors, id_col, vector_col).withColumn("wide", is_wide(s.scale)), "vectors")
    wanted = shared.staged(finite(queries, id_col, vector_col).withColumn("wide", is_wide(s.scale)), "queries")
    x, q = whole(every.where("not wide"), s.scale), whole(wanted.where("not wide"), s.scale)
    n, wide_n = _sizes(every)
    asked, wide_asked = _sizes(wanted)
    some = x.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(s.first_modulus)) == 0)
    none = F.lit("").alias("large")
    first = _best(_candidates(some, q.withColumn("bar", F.lit(float("-inf"))), s, -(-n // s.first_modulus), asked).withColumn("large", none), s)
    bars = first.where(F.col("rank") == s.k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("bar"))
    q = shared.staged(q.join(bars, "id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf")))), "bars")
    found = _candidates(x, q, s, n, asked).withColumn("large", none)
    if wide_n:
        found = found.unionByName(_scan(every.where("wide"), wanted, s, wide_n, asked + wide_asked))
    if wide_asked:
        found = found.unionByName(_scan(every.where("not wide"), wanted.where("wide"), s, n, wide_asked))
    return _best(found, s).select("query_id", "rank", "vec_id", "score")


def _sizes(rows: DataFrame) -> tuple[int, int]:
    """Rows that are not wide and rows that are."""
    got = rows.agg(F.count_if(~F.col("wide")), F.count_if(F.col("wide"))).first()
    return got[0], got[1]
