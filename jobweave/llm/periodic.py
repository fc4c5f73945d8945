"""Maximal periodic runs of words, by seeds that are extended along diagonals.

A run of period q and length L agrees with itself at lag q on L - q words in a row,
which is at least max(least - q, (times - 1) * q) of them.  So it contains, twice
and q words apart, every k-gram with k up to that overlap.  Periods up to 16 are
sought by grams of 16 words, periods in (k / 2, k] by grams of k = 32, 64, ...:
each gram is at least as long as its period, and then the next occurrence of a
gram inside a run lies exactly one smallest period on.  Only neighbouring
occurrences have to be paired, never all, and the lag of a pair is the run's
smallest period.  A table of the furthest word covered on each lag keeps a
stretch from being extended again for its other pairs.

Grams are numbered exactly, by joining the numbers of their halves; places whose
gram occurs once in a document drop out before the next, longer length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm import shared, textscan


@dataclass(frozen=True)
class Settings:
    """A run has at least max(least, times * period) words; times is 3 or more, as the seeds rest on it."""
    least: int = 24
    times: int = 3

    def __post_init__(self):
        if self.times < 3:
            raise ValueError("a run holds its period at least three times")

    def seed(self) -> int:
        """The largest power of two that every run of a period up to it holds twice in a row."""
        k = 1
        while min(max(self.least - q, (self.times - 1) * q) for q in range(1, 2 * k + 1)) >= 2 * k:
            k *= 2
        return k


def _numbers(keys: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers, from 0."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _seeds(ids: np.ndarray, end: np.ndarray, s: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(k, lowest period, place, lag) of neighbouring equal k-grams; `end` is the end of each word's document.

    `ids` number the words, differently in different documents.
    """
    k, first = 1, s.seed()
    place, name = np.arange(len(ids)), ids
    while len(place):
        if k >= first:
            order = np.lexsort((place, name))
            p, same = place[order], name[order]
            lag = p[1:] - p[:-1]
            low = 1 if k == first else k // 2 + 1
            hit = (same[1:] == same[:-1]) & (lag >= low) & (lag <= k)
            yield k, low, p[:-1][hit], lag[hit]
        # only places whose gram occurs again can begin a longer one that does
        name = _numbers(name)
        often = np.bincount(name)[name] > 1
        place, name = place[often], name[often]
        full = np.full(len(ids) + 1, -1, np.int64)
        full[place] = name
        to = place + k
        on = place + 2 * k <= end[place]
        on[on] &= full[to[on]] >= 0
        place, name = place[on], name[on] * (len(ids) + 1) + full[to[on]]
        k *= 2


def _stretch(ids: np.ndarray, lag: int, left: int, right: int, lo: int, hi: int) -> tuple[int, int]:
    """Grow [left, right) to all words that equal the word `lag` on, within the document [lo, hi)."""
    step = 16
    while right < hi - lag:
        n = min(step, hi - lag - right)
        differ = np.flatnonzero(ids[right:right + n] != ids[right + lag:right + lag + n])
        if len(differ):
            right += int(differ[0])
            break
        right, step = right + n, 2 * step
    step = 16
    while left > lo:
        n = min(step, left - lo)
        differ = np.flatnonzero(ids[left - n:left] != ids[left - n + lag:left + lag])
        if len(differ):
            left += int(differ[-1]) + 1 - n
            break
        left, step = left - n, 2 * step
    return left, right


def runs(ids: np.ndarray, first: np.ndarray, s: Settings) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of all runs; words first[d]..first[d + 1] are those of document d."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = []
    for k, _, place, lag in _seeds(ids, first[1:][owner], s):
        order = np.lexsort((place, lag))
        covered: dict[int, int] = {}
        for p, q in zip(place[order].tolist(), lag[order].tolist()):
            if p < covered.get(q, -1):
                continue
            d = int(owner[p])
            a, b = _stretch(ids, q, p, p + k, int(first[d]), int(first[d + 1]))
            covered[q] = b
            if b - a + q >= max(s.least, s.times * q):
                found.append((d, a - int(first[d]), b - a + q, q))
    return sorted(found, key=lambda r: (r[0], r[1], r[3]))


Rewrite = Callable[[int, list[bytes]], list[bytes]]


def texts_runs(texts: list[list[bytes]], s: Settings) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """(words, runs as (start, length, period)) of each list of words."""
    every, ids, first = [], [], [0]
    for words in texts:
        own, base = {}, first[-1]
        ids.append(np.fromiter((own.setdefault(w, base + k) for k, w in enumerate(words)), np.int64, len(words)))
        every.append(words)
        first.append(base + len(words))
    out: list[list] = [[] for _ in texts]
    for d, *run in runs(np.concatenate(ids) if ids else np.zeros(0, np.int64), np.array(first), s):
        out[d].append(tuple(run))
    yield from zip(every, out)


def kept(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    stay = np.ones(len(words), bool)
    for start, length, period in found:
        stay[start + period:start + length] = False
    return [words[k] for k in np.flatnonzero(stay)]


def _work(s: Settings, rewrite: Rewrite | None, id_at: int):
    def words_of(part, k, ids):
        words = part.text(k).split()            # bytes split at the six blanks of ASCII
        i = ids[part.row + k].as_py() if rewrite is not None else None
        return words if i is None else rewrite(i, words)

    def work(batches):
        for batch in batches:
            for part in textscan.slices(batch.column(batch.num_columns - 1)):
                every, text = [], []
                for words, found in texts_runs([words_of(part, k, batch.column(id_at)) for k in range(part.count)], s):
                    every.append([{"start": a, "length": n, "period": q} for a, n, q in found])
                    text.append(b" ".join(kept(words, found)))
                own = [batch.column(k).slice(part.row, part.count) for k in range(batch.num_columns)]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays([*own[:-1], pa.array(every, kind), pa.array(text, pa.binary()).cast(pa.string())],
                                                 names=[*batch.schema.names[:-1], "__runs", "__collapsed"])
    return work


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings(),
         rewrite: Rewrite | None = None) -> DataFrame:
    """All columns but the text, with `__runs` (array of start, length, period in words, by start, then period)
    and `__collapsed`, the words that no run holds after its first period, joined by one blank.

    Words are what ASCII white space parts.  A null, empty or blank text has no words,
    no runs and an empty collapsed text; of runs that overlap all are reported.  Every
    row is read by itself: repeated rows, null ids and other columns pass through.
    `rewrite` changes the words of a row with an id before they are read.
    """
    rows = docs.select(*[c for c in docs.columns if c != text_col], text_col)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{fields}, __runs array<struct<start:bigint,length:bigint,period:bigint>>, __collapsed string"
    return shared.map_arrow(rows, _work(s, rewrite, rows.columns.index(id_col)), schema)


def planted(i: int, words: list[bytes]) -> list[bytes]:
    """Repeats a stretch of every tenth document up to its end: runs that can be found again."""
    h = zlib.crc32(str(i).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_runs, the run of the greatest exponent, digests of all runs and of the collapsed text) of `find`'s rows."""
    run = F.array_sort("__runs", lambda a, b: F.when(a["length"] * b["period"] != b["length"] * a["period"],
                       F.signum(b["length"] * a["period"] - a["length"] * b["period"]).cast("int"))
                       .when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int"))
                       .otherwise(F.signum(a["period"] - b["period"]).cast("int")))
    lines = F.array_join(F.transform("__runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("__runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    top = found.select(id_col, F.size("__runs").cast("long").alias("n_runs"), F.get(run, F.lit(0)).alias("__top"),
                       F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col("__collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return top.select(id_col, "n_runs", "__top.start", "__top.length", "__top.period",
                      F.expr("1000 * __top.length div __top.period").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")
