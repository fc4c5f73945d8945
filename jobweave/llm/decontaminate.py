"""Benchmark decontamination by spaced seeds.

A mask keeps some token positions of a window and ignores the others, so a window
hashes alike under substitutions at ignored positions.  Windows of training texts
are looked up among those of the benchmark, and every hit is verified on its
diagonal: benchmark item and text side by side, token by token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm import shared, textscan
from jobweave.llm.textscan import U64, mix


@dataclass(frozen=True)
class Settings:
    """masks: '1' keeps a token position, '0' ignores it.

    An overlap counts when a stretch of at least `least` tokens that begins and ends
    with a match, or the whole item, has `penalty` matches or more a substitution:
    an identity of penalty / (penalty + 1), so 0.8.  `block_bytes` bounds what of the
    benchmark is broadcast at once.
    """
    masks: tuple[str, ...] = ("11111111", "1101011011", "1110010111", "110100110101")
    least: int = 13
    penalty: int = 4
    block_bytes: int = 8 << 20
    table_bits: int = 22


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts of a column and where each text begins."""
    h, first, base = [], [np.zeros(1, np.int64)], 0
    for part in textscan.slices(column):
        w = textscan.words(part, gap=textscan.NOT_ALNUM)
        h.append(w.hash)
        first.append(w.first[1:] + base)
        base += len(w.hash)
    return (np.concatenate(h) if h else np.zeros(0, U64)), np.concatenate(first)


def _masked(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window of len(mask) tokens at its kept positions."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    x = np.full(n, sum(1 << k for k, c in enumerate(mask) if c == "1") + 1, U64)
    for k, c in enumerate(mask):
        if c == "1":
            x = x * U64(0x100000001B3) + h[k:k + n]
            x ^= x >> U64(29)
    return mix(x)


def longest(same: np.ndarray, penalty: int) -> tuple[int, int]:
    """The longest stretch between two matches with at least `penalty` matches a substitution, the first of equals."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -penalty))])
    low = np.minimum.accumulate(total[at])
    start = at[np.searchsorted(-low, -total[at + 1])]      # the first match from which on the sum is not negative
    k = int(np.argmax(at + 1 - start))
    return int(start[k]), int(at[k]) + 1


class Seeds:
    """Windows of one block of the benchmark: their hashes in order, with item and place."""

    def __init__(self, ids: list, texts: pa.Array, s: Settings):
        self.s, self.ids = s, np.array(ids, np.int64)
        self.tokens, self.first = _tokens(texts)
        sizes = np.diff(self.first)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        # items shorter than a mask are sought whole
        span = min(map(len, s.masks))
        self.masks = [*s.masks, *("1" * int(n) for n in np.unique(sizes[(sizes > 0) & (sizes < span)]))]
        parts = []
        for m, mask in enumerate(self.masks):
            x = _masked(self.tokens, mask)
            at = np.arange(len(x))
            fits = at + len(mask) <= self.first[owner[at] + 1]
            if m >= len(s.masks):
                fits &= sizes[owner[at]] == len(mask)
            parts.append((x[fits], at[fits]))
        self.hash = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, U64)
        at = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.at = self.hash[order], at[order]
        self.item = owner[self.at] if len(self.at) else self.at
        self.place = self.at - self.first[self.item] if len(self.at) else self.at
        self.bits = np.zeros(1 << s.table_bits, bool)
        self.bits[(self.hash & U64(len(self.bits) - 1)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (text, item, diagonal): the text's token minus the item's token at a hit."""
        out = []
        for mask in self.masks:
            x = _masked(h, mask)
            at = np.flatnonzero(self.bits[(x & U64(len(self.bits) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(self.hash, x[at], "left"), np.searchsorted(self.hash, x[at], "right")
            doc = np.searchsorted(first, at, "right") - 1
            ok = (hi > lo) & (at + len(mask) <= first[np.minimum(doc + 1, len(first) - 1)])
            at, lo, hi, doc = at[ok], lo[ok], hi[ok], doc[ok]
            n = hi - lo
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append(np.stack([np.repeat(doc, n), self.item[which], np.repeat(at - first[doc], n) - self.place[which]], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)

    def overlaps(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item id, start, stop, matches) of verified overlaps; start, stop in tokens of the text."""
        s = self.s
        for doc, item, diagonal in self.hits(h, first).tolist():
            mine, own = h[first[doc]:first[doc + 1]], self.tokens[self.first[item]:self.first[item + 1]]
            a, b = max(0, diagonal), min(len(mine), diagonal + len(own))
            same = mine[a:b] == own[a - diagonal:b - diagonal]
            start, stop = longest(same, s.penalty)
            if stop - start < s.least:
                if len(same) < len(own) or (s.penalty + 1) * int(same.sum()) < s.penalty * len(own):
                    continue
                start, stop = 0, len(own)
            yield doc, int(self.ids[item]), a + start, a + stop, int(same[start:stop].sum())


def blocks(benchmark: DataFrame, id_col: str, text_col: str, s: Settings) -> Iterator[Seeds]:
    """The benchmark as blocks of at most block_bytes (or one item), streamed through the driver one at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(id_col).isNotNull()).distinct()
    for i, text in rows.toLocalIterator():
        if ids and size + len(text or "") > s.block_bytes:
            yield Seeds(ids, pa.array(texts, pa.string()), s)
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(text)
        size += len(text or "")
    if ids:
        yield Seeds(ids, pa.array(texts, pa.string()), s)


HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("matches", pa.int32())]))
HITS_SQL = "array<struct<item_id:bigint,start:int,stop:int,matches:int>>"


def _found(column: pa.Array, seeds: Seeds) -> list[list[dict]]:
    out = []
    for part in textscan.slices(column):
        w = textscan.words(part, gap=textscan.NOT_ALNUM)
        rows: list[dict[int, dict]] = [{} for _ in range(part.count)]
        for doc, item, a, b, n in seeds.overlaps(w.hash, w.first):
            hit = {"item_id": item, "start": a, "stop": b, "matches": n}
            old = rows[doc].get(item)
            if old is None or (-n, a, b) < (-old["matches"], old["start"], old["stop"]):
                rows[doc][item] = hit          # one overlap an item: most matches, then earliest
        out += [[r[i] for i in sorted(r)] for r in rows]
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text", s: Settings = Settings()) -> DataFrame:
    """(id, hits) of every document: the benchmark items it overlaps, with token range and matches.

    Null and empty texts and items without a token overlap with nothing; a null
    item id is left out; an empty benchmark gives empty lists.  Repeated rows are
    each reported.  Texts are scanned whole and nothing is shuffled; a benchmark
    of several blocks takes one pass a block, with the hits so far written in between.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array().cast(HITS_SQL).alias("hits"))
    todo = blocks(benchmark, item_col, item_text, s)
    seeds = next(todo, None)
    while seeds:
        following = next(todo, None)
        shared_seeds = docs.sparkSession.sparkContext.broadcast(seeds)

        def work(batches, b=shared_seeds, more=following is not None):
            for batch in batches:
                before = batch.column(2).to_pylist()
                found = pa.array([x + y for x, y in zip(before, _found(batch.column(1), b.value))], HITS)
                yield pa.RecordBatch.from_arrays([batch.column(0), *([batch.column(1)] if more else []), found],
                                                 names=["id", *(["text"] if more else []), "hits"])
        rows = shared.map_arrow(rows, work, f"id {kind}, {'text string, ' if following else ''}hits {HITS_SQL}")
        if following:           # a task holds the seeds of one block
            rows = shared.staged(rows, "scanned")
        seeds = following
    return rows.select(F.col("id").alias(id_col), F.array_sort("hits").alias("hits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", s: Settings = Settings()) -> DataFrame:
    """docs without those that overlap a benchmark item; all columns and other rows stay as they are."""
    at = docs.columns.index(text_col)
    for n, seeds in enumerate(blocks(benchmark, item_col, item_text, s)):
        if n:           # a task holds the seeds of one block
            docs = shared.staged(docs, "scanned")
        shared_seeds = docs.sparkSession.sparkContext.broadcast(seeds)

        def work(batches, b=shared_seeds):
            for batch in batches:
                yield batch.filter(pa.array([not x for x in _found(batch.column(at), b.value)], pa.bool_()))
        docs = shared.map_arrow(docs, work, docs.schema)
    return docs
