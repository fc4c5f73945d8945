"""Substring de-duplication by hashing lines and their sentences.

Texts are cut into units, each digest keeps its earliest occurrence in the order
(id, offset), and later occurrences go where a run of neighbouring ones has
`min_words` words.  A passage spliced into a line is thus found by its sentences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm import shared, textscan


@dataclass(frozen=True)
class Settings:
    """min_words: words that neighbouring repeated units need together to be removed."""
    min_words: int = 25


def unit_batches(batches):
    """(id, text, hash) to one row per non-blank unit: (id, hash, unit, digest)."""
    for batch in batches:
        for part in textscan.slices(batch.column(1)):
            u = textscan.units(part, sentences=True)
            owner = u.owner()
            here = np.arange(len(owner)) - u.first[owner]
            some = np.flatnonzero(u.hash)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c).take(pa.array(part.row + owner[some])) for c in (0, 2)), pa.array(here[some].astype(np.int32)),
                pa.array(u.hash[some].view(np.int64))], names=["id", "hash", "unit", "digest"])


def remover(s: Settings, text_at: int, fields: list[str]):
    """Rows with a text and `__repeats` (unit numbers) last to rows with the text cut and the removed ranges.

    Ranges count characters of the original text.
    """
    def work(batches):
        for batch in batches:
            column, repeats = batch.column(text_at), batch.column(batch.num_columns - 1)
            texts, ranges, total = [], [], []
            for part in textscan.slices(column):
                u = textscan.units(part, sentences=True)
                words = None
                for k in range(part.count):
                    row, a, b = part.row + k, int(u.first[k]), int(u.first[k + 1])
                    total.append(b - a)
                    marked = repeats[row].as_py()
                    found = []
                    if marked:
                        if words is None:
                            words = textscan.unit_words(part, u)
                        again = u.hash[a:b] == 0          # blank units continue a run
                        blank = again.copy()
                        again[marked] = True
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]])))
                        for x, y in zip(edge[::2], edge[1::2]):
                            solid = np.flatnonzero(~blank[x:y])
                            if len(solid) and words[a + x:a + y].sum() >= s.min_words:
                                found.append((int(x + solid[0]), int(x + solid[-1]) + 1))
                    if not found:
                        texts.append(part.text(k).decode() if column[row].is_valid else None)
                        ranges.append([])
                        continue
                    chars = lambda p, q: len(part.data[p:q].tobytes().decode())
                    at, done, kept, cut = int(part.offsets[k]), 0, [], []
                    for x, y in found:
                        p, q = int(u.start[a + x]), int(u.end[a + y - 1])
                        kept.append(part.data[at:p].tobytes().decode())
                        start = done + len(kept[-1])
                        done = start + chars(p, q)
                        cut.append({"start": start, "stop": done})
                        at = q
                    kept.append(part.data[at:part.offsets[k + 1]].tobytes().decode())
                    texts.append("".join(kept))
                    ranges.append(cut)
            arrays = [batch.column(k) for k in range(batch.num_columns - 1)]
            arrays[text_at] = pa.array(texts, pa.string())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int32()), pa.array(ranges, kind)],
                                             names=[*fields, "__units", "__removed"])
    return work


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """docs with repeated passages removed; `__units` counts units, `__removed` has the removed ranges.

    Ranges are character offsets in the original text.  The earliest occurrence, by
    id and then place, stays.  No row is dropped; null and empty texts and rows with
    a null id stay as they are; other columns pass through.  Rows that repeat an id
    and its text are cut alike.  Texts that share an id are documents of their own, in
    the order of a hash of the text.
    """
    text_hash = F.xxhash64(F.col(text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_hash.alias("hash")).where("id is not null")
    units = shared.staged(shared.map_arrow(texts, unit_batches, "id long, hash long, unit int, digest long"), "units")
    firsts = units.groupBy("digest").agg(F.min(F.struct("id", "hash", "unit")).alias("f"), F.count("*").alias("c")).where("c > 1")
    held = shared.attach(units, firsts, "digest", "c", units.count(), F.xxhash64("id", "unit"))
    again = held.where("f is not null and (f.id < id or f.hash < hash or f.unit < unit)")
    again = again.groupBy(F.col("id").alias("__id"), F.col("hash").alias("__hash")).agg(F.collect_set("unit").alias("__repeats"))
    own = (F.col(id_col).cast("long") == F.col("__id")) & (text_hash == F.col("__hash"))
    rows = docs.join(again, own, "left").drop("__id", "__hash")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return shared.map_arrow(rows, remover(s, docs.columns.index(text_col), docs.columns),
                            f"{kinds}, `__units` int, `__removed` array<struct<start:int,stop:int>>")
