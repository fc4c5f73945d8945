"""Line de-duplication by pairwise alignment.

A *run* is the shortest sequence of non-blank lines from some line on, or up to
some line, that has `min_words` words: the runs inside a block of common lines
worth deleting cover all its lines.  A run hash that several documents share names
the earliest of them as partner of the others, so a line of a third of all
documents makes one pair a document, never all pairs.  The pairs are aligned with
patience diff; common runs that it leaves (repeated, moved or crossed ones) are
looked up one by one.  Common blocks are deleted from the later document, which so
loses exactly the lines in blocks that some earlier document has.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm import shared, textscan
from jobweave.llm.textscan import U64


@dataclass(frozen=True)
class Settings:
    """min_words: words a common block needs to be deleted (shared titles and greetings stay)."""
    min_words: int = 25
    block: int = 256


def _spans(w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and end of the runs from every line on and up to every line; w: words of the non-blank lines."""
    ends = np.concatenate([[0], np.cumsum(w, dtype=np.int64)])
    stop = np.searchsorted(ends, ends[:-1] + least)              # lines start..stop hold `least` words
    begin = np.searchsorted(ends, ends[1:] - least, "right") - 1
    on, up = np.flatnonzero(stop <= len(w)), np.flatnonzero(begin >= 0)
    runs = np.unique(np.stack([np.concatenate([on, begin[up]]), np.concatenate([stop[on], up + 1])], 1), axis=0)
    return runs[:, 0], runs[:, 1]


def _runs(h: np.ndarray, w: np.ndarray, least: int) -> np.ndarray:
    """Hashes of all runs; h, w: hashes and words of the non-blank lines."""
    start, stop = _spans(w, least)
    size = stop - start
    out = [textscan.combine(h, int(n))[start[size == n]] for n in np.unique(size)]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U64)


def held(own: np.ndarray, w: np.ndarray, other: np.ndarray, least: int) -> np.ndarray:
    """Which lines of `own` lie in blocks of `least` words that `other` has, wherever and however often."""
    start, stop = _spans(w, least)
    size, edge = stop - start, np.zeros(len(own) + 1, np.int64)
    for n in np.unique(size):
        a = start[size == n]
        a = a[np.isin(textscan.combine(own, int(n))[a], textscan.combine(other, int(n)))]
        np.add.at(edge, a, 1)
        np.add.at(edge, a + n, -1)
    return np.cumsum(edge[:-1]) > 0


def line_batches(s: Settings):
    """(id, text, hash) to (id, hash, lines, words, runs); lines and words as packed arrays."""
    def work(batches):
        for batch in batches:
            for part in textscan.slices(batch.column(1)):
                u = textscan.units(part)
                words = textscan.unit_words(part, u).astype(np.int32)
                lines, counts, runs = [], [], []
                for k in range(part.count):
                    h, w = u.hash[u.first[k]:u.first[k + 1]], words[u.first[k]:u.first[k + 1]]
                    lines.append(h.tobytes())
                    counts.append(w.tobytes())
                    runs.append(_runs(h[h != 0], w[h != 0], s.min_words).view(np.int64))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.row, part.count), batch.column(2).slice(part.row, part.count), pa.array(lines, pa.binary()),
                    pa.array(counts, pa.binary()), pa.array(runs, pa.list_(pa.int64()))], names=["id", "hash", "lines", "words", "runs"])
    return work


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions (i, j) of two sequences, rising in both: equal ends, then lines
    that are unique on both sides in their longest common order, then the gaps between."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            found.append((ie, je))
        if i == ie or j == je:
            continue
        here, there = Counter(a[i:ie]), Counter(b[j:je])
        at = {x: k for k, x in enumerate(b[j:je], j) if there[x] == 1}
        anchors = [(k, at[x]) for k, x in enumerate(a[i:ie], i) if here[x] == 1 and x in at]
        if not anchors:
            continue
        tails, tops, back = [], [], []               # longest rising sequence of positions in b
        for n, (_, q) in enumerate(anchors):
            k = bisect_left(tails, q)
            tails[k:k + 1], tops[k:k + 1] = [q], [n]
            back.append(tops[k - 1] if k else -1)
        n, chain = tops[-1], []
        while n >= 0:
            chain.append(anchors[n])
            n = back[n]
        x, y = i, j
        for p, q in reversed(chain):
            todo.append((x, p, y, q))
            x, y = p, q                              # the anchor opens the next gap and matches there
        todo.append((x, ie, y, je))
    return sorted(found)


def blocks(later: np.ndarray, words: np.ndarray, earlier: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Line ranges of `later` to delete: blocks common with `earlier` of `least` words or more.

    Blank lines (hash 0) neither match nor part a block.  Patience diff gives the
    blocks that follow each other in both texts.  Blocks that moved, cross or repeat
    are on no such path: the lines that `held` finds in them, which the diff did not
    take, follow as stretches of their own.  So what is deleted is all that `held`
    tells, and the diff says how it is cut into blocks; both take one pass.
    """
    mine = np.flatnonzero(later)
    common = held(later[mine], words[mine], earlier[earlier != 0], least)
    left = set(np.flatnonzero(common).tolist())
    out: list[tuple[int, int]] = []
    if not left:
        return out
    run, pairs = [], patience(later[mine].tolist(), earlier[earlier != 0].tolist())
    for k, (i, j) in enumerate(pairs):
        run.append(i)
        if k + 1 == len(pairs) or pairs[k + 1] != (i + 1, j + 1):
            if int(words[mine[run]].sum()) >= least:
                left.difference_update(run)
                out.append((int(mine[run[0]]), int(mine[run[-1]]) + 1))
            run = []
    rest = np.zeros(len(mine) + 2, np.int8)
    rest[[1 + k for k in left]] = 1
    edge = np.flatnonzero(np.diff(rest))
    return out + [(int(mine[a]), int(mine[b - 1]) + 1) for a, b in edge.reshape(-1, 2)]


def aligner(s: Settings):
    """Star rows (centre, block, id, hash, lines, words) to (id, hash, partner, start, stop) of blocks to delete.

    Several texts of the centre's id count as one, with a line between them that no text has.
    """
    between = np.array([0x5DEECE66D15C0FFE], U64)

    def work(batches):
        at = earlier = None
        for batch in batches:
            rows: list[tuple] = []
            centre, block, who, text, lines, words = (batch.column(k).to_pylist() for k in range(6))
            for k in range(batch.num_rows):
                h = np.frombuffer(lines[k], U64)
                if who[k] == centre[k]:
                    earlier = h if at != (centre[k], block[k]) else np.concatenate([earlier, between, h])
                    at = (centre[k], block[k])
                    continue
                if at != (centre[k], block[k]):
                    raise RuntimeError("a partner's lines are missing")
                rows += [(who[k], text[k], centre[k], x, y) for x, y in blocks(h, np.frombuffer(words[k], np.int32), earlier, s.min_words)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "hash", "partner", "start", "stop"])
    return work


def _text_hash(text_col: str):
    return F.xxhash64(F.col(text_col)).alias("hash")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(id, hash, partner, start, stop): lines start..stop (from 0) of the text with that id and hash which the earlier partner has."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), _text_hash(text_col)).where("id is not null")
    schema = "id long, hash long, lines binary, words binary, runs array<long>"
    recs = shared.staged(shared.map_arrow(texts, line_batches(s), schema), "lines")
    runs = recs.select("id", F.explode("runs").alias("run"))
    shared_runs = runs.groupBy("run").agg(F.min("id").alias("b"), F.count("*").alias("c")).where("c > 1")
    held = shared.attach(runs, shared_runs, "run", "c", runs.count(), F.xxhash64("id", "run"))
    pairs = shared.staged(held.where("b < id").select(F.col("id").alias("a"), "b").distinct(), "pairs")
    rows = shared.star_rows(pairs, recs.select("id", "hash", "lines", "words").distinct(), s.block)
    return shared.map_arrow(rows, aligner(s), "id long, hash long, partner long, start long, stop long")


def cutter(text_at: int, fields: list[str]):
    """Rows with a text and `__cuts` (line ranges) last to rows with the text so cut and the counts of lines."""
    def work(batches):
        for batch in batches:
            column, cuts = batch.column(text_at), batch.column(batch.num_columns - 1).to_pylist()
            texts, total, gone = [], [], []
            for part in textscan.slices(column):
                u = textscan.units(part)
                for k in range(part.count):
                    a, b = int(u.first[k]), int(u.first[k + 1])
                    row = part.row + k
                    drop = np.zeros(b - a, bool)
                    for c in cuts[row] or ():
                        drop[c["start"]:c["stop"]] = True
                    total.append(b - a)
                    gone.append(int(drop.sum()))
                    if not column[row].is_valid:
                        texts.append(None)
                    elif not gone[-1]:
                        texts.append(part.text(k).decode())
                    else:
                        texts.append("".join(part.data[u.start[a + x]:u.end[a + x]].tobytes().decode()
                                             for x in np.flatnonzero(~drop)))
            arrays = [batch.column(k) for k in range(batch.num_columns - 1)]
            arrays[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int32()), pa.array(gone, pa.int32())],
                                             names=[*fields, "__lines", "__removed"])
    return work


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """docs with common blocks deleted from later documents; `__lines`, `__removed` count lines, `__blocks` says which.

    Earlier means the smaller id.  No row is dropped: a document whose lines all
    go keeps an empty text.  Null and empty texts stay as they are, as do rows with
    a null id.  Rows that repeat an id and its text are cut alike; texts that share an
    id are not compared with each other, and each loses only what an earlier id has.
    Other columns pass through.
    """
    cuts = removals(docs, id_col, text_col, s)
    cuts = cuts.groupBy(F.col("id").alias("__id"), F.col("hash").alias("__hash")).agg(
        F.sort_array(F.collect_set(F.struct("start", "stop", "partner"))).alias("__blocks"))
    own = (F.col(id_col).cast("long") == F.col("__id")) & (_text_hash(text_col) == F.col("__hash"))
    rows = docs.join(cuts, own, "left").drop("__id", "__hash")
    fields = [*docs.columns, "__blocks"]
    rows = rows.select(*fields, F.col("__blocks").alias("__cuts"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return shared.map_arrow(rows, cutter(docs.columns.index(text_col), fields), f"{kinds}, `__lines` int, `__removed` int")
