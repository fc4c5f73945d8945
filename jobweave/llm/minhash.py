"""Near-duplicate documents by SuperMinHash signatures, banding, verification and connected components.

SuperMinHash gives element d of a set a random permutation of the m slots, built
step by step, and slot p(j) the value j + u_j; a slot keeps its minimum over the
set.  Values of step j lie in [j, j + 1), so once every slot has a value from the
steps so far, no later step can lower one: all elements of a document take step j
together and the document stops at the first step that leaves no slot empty.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm import shared, textscan
from jobweave.llm.textscan import U64, mix

EMPTY = U64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Settings:
    """words: shingle length; link where den * intersection >= num * union.

    32 bands of 4 of 128 slots miss a pair of similarity s with probability about
    (1 - s**4)**32: 6e-11 at 0.85, 5e-8 at 0.8.  bits: size of the bitmaps that
    bound the intersection of two documents compared with the same centre.
    """
    words: int = 5
    num: int = 80
    den: int = 100
    slots: int = 128
    bands: int = 32
    bits: int = 2048
    block: int = 256           # documents compared with one centre in a task's run


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash of every set; an empty set keeps EMPTY in all slots."""
    out = np.full((len(sets), m), EMPTY, U64)
    sizes = np.array([len(x) for x in sets])
    x = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    flat, perm = out.reshape(-1), None
    for j in range(m):
        if not len(x):
            break
        z = mix(x + U64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = (j + (((z & U64(0xFFFFFFFF)) * U64(m - j)) >> U64(32)).astype(np.int64))
        if not j:
            slot = k
        else:
            rows = np.arange(len(x))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(flat, doc * m + slot, (U64(j) << U64(32)) | (z >> U64(32)))
        if j + 1 < m:
            stay = (out == EMPTY).any(axis=1)[doc]
            if not stay.all():
                x, doc = x[stay], doc[stay]
                k = k[stay]
                perm = None if perm is None else perm[stay]
            if not j:        # few elements get here; only they need their permutation written out
                perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(x), 1))
                perm[np.arange(len(x)), k] = 0
    return out


def sign_batches(s: Settings):
    """Arrow batches (id, text) to (id, n, digest, bands)."""
    per = s.slots // s.bands

    def work(batches):
        for batch in batches:
            for part in textscan.slices(batch.column(1)):
                sets = list(textscan.shingle_sets(part, s.words))
                sig = signatures(sets, s.slots)
                keys = np.full((part.count, s.bands), 0, U64)
                for r in range(per):
                    keys = mix(keys * U64(0x100000001B3) + sig[:, r::per][:, :s.bands])
                keys ^= np.arange(1, s.bands + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)
                keys = mix(keys)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.row, part.count),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets],
                             pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(part.count + 1) * s.bands, pa.int32()),
                                             pa.array(keys.view(np.int64).reshape(-1))),
                ], names=["id", "n", "digest", "bands"])
    return work


def bitmap(x: np.ndarray, bits: int) -> bytes:
    """Bit h % bits of every hash h of x."""
    out = np.zeros(bits, bool)
    out[(x % U64(bits)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def verifier(s: Settings):
    """Star rows (centre, block, id, text) to (a, b, na, nb, both, plus, minus).

    both: size of the intersection of a's and centre b's sets; plus, minus: bitmaps
    of what a has beyond the centre and lacks of it.
    """
    def work(batches):
        at = own = None
        for batch in batches:
            centre, block, who = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            rows = []
            for part in textscan.slices(batch.column(3)):
                for k, found in enumerate(textscan.shingle_sets(part, s.words), part.row):
                    if who[k] == centre[k]:
                        at, own = (centre[k], block[k]), found
                        continue
                    if at != (centre[k], block[k]):
                        raise RuntimeError("a centre's text is missing")
                    common = np.intersect1d(own, found, assume_unique=True)
                    rows.append((who[k], centre[k], len(found), len(own), len(common),
                                 bitmap(np.setdiff1d(found, common, True), s.bits),
                                 bitmap(np.setdiff1d(own, common, True), s.bits)))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.binary()) for c in cols[5:])],
                names=["a", "b", "na", "nb", "both", "plus", "minus"])
    return work


def _rows_by_key(batches, keys: int):
    """The rows of a sorted stream, one table for each run of equal values in the first `keys` columns."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)], 1)
        cut = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(k)]])
        for a, b in zip(cut[:-1], cut[1:]):
            if held and tuple(k[a]) != at:
                yield pa.Table.from_batches(held)
                held = []
            at = tuple(k[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def pruner(s: Settings):
    """Blocks (b, i, j, far, a, comp, na, nb, both, plus, minus) of a star to the pairs (a, b) that may be linked.

    For x, y compared with centre c, |x & y| is at most |c| less what either lacks of
    c, plus what both have beyond c.  Bitmaps bound both from the safe side, so no
    linked pair is left out, and copies with edits of their own hardly ever stay in.
    """
    def work(batches):
        for t in _rows_by_key(batches, 3):
            far = t.column("far").to_numpy()
            ids, comp, n, nb, both = (t.column(c).to_numpy() for c in ("a", "comp", "na", "nb", "both"))
            plus, minus = (np.frombuffer(b"".join(t.column(c).to_pylist()), U64).reshape(len(ids), -1) for c in ("plus", "minus"))
            spare = n - both - np.bitwise_count(plus).sum(axis=1)      # elements beyond c that share a bit
            x, y = np.flatnonzero(far), np.flatnonzero(~far)
            out = []
            for k in range(0, len(x), 32):
                u = x[k:k + 32]
                lack = np.bitwise_count(minus[u][:, None] | minus[y][None]).sum(axis=2, dtype=np.int64)
                more = np.bitwise_count(plus[u][:, None] & plus[y][None]).sum(axis=2, dtype=np.int64)
                top = nb[0] - lack + more + np.minimum(spare[u][:, None], spare[y][None])
                size = n[u][:, None] + n[y][None]
                top = np.minimum(top, np.minimum(n[u][:, None], n[y][None]))
                ok = (s.den * top >= s.num * (size - top)) & (comp[u][:, None] != comp[y][None])
                p, q = np.nonzero(ok)
                out.append(np.stack([ids[u[p]], ids[y[q]]], 1))
            found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.max(axis=1) if len(found) else found[:, 0]),
                                              pa.array(found.min(axis=1) if len(found) else found[:, 0])], names=["a", "b"])
    return work


STAR = "a long, b long, na long, nb long, both long, plus binary, minus binary"


def _compared(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    rows = shared.star_rows(pairs, texts, s.block)
    return shared.staged(shared.map_arrow(rows, verifier(s), STAR), "compared")


def _open_pairs(stars: DataFrame, comps: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of members of one star, in different components, that may still be linked.

    One of the two is then outside the centre's component ("far").  Far members
    meet all members of their star in blocks of at most 2 * `size` rows.
    """
    size = 512
    where = comps.select(F.col("node"), F.col("root"))
    v = stars.join(where.withColumnRenamed("node", "a").withColumnRenamed("root", "ra"), "a", "left")
    v = v.select(*stars.columns, F.coalesce("ra", "a").alias("comp"))
    per = v.groupBy("b").agg(F.count("*").alias("c"))
    per = per.join(where.withColumnRenamed("node", "b").withColumnRenamed("root", "rb"), "b", "left")
    per = per.select("b", "c", F.coalesce("rb", "b").alias("home"))
    total = stars.count()
    v = shared.attach(v, per, "b", "c", total, -1 - F.abs(F.xxhash64("a")))
    v = shared.staged(v.withColumn("far", F.col("comp") != F.col("home")).drop("home"), "stars")
    per = v.groupBy("b").agg(F.count("*").alias("c"), F.sum(F.col("far").cast("long")).alias("f")).where("f > 0 and c > 1")
    per = per.select("b", "c", F.ceil(F.col("f") / size).alias("fars"), F.ceil(F.col("c") / size).alias("alls"))
    v = shared.attach(v, per, "b", "c", total, -1 - F.abs(F.xxhash64("a"))).where("fars is not null")
    rest = ["a", "comp", "na", "nb", "both", "plus", "minus"]
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    x = v.where("far").select("b", F.pmod(F.xxhash64("a"), "fars").alias("i"), numbers("alls").alias("j"),
                              F.lit(True).alias("far"), *rest)
    y = v.select("b", numbers("fars").alias("i"), F.pmod(F.xxhash64("a"), "alls").alias("j"), F.lit(False).alias("far"), *rest)
    rows = x.union(y).repartition("b", "i", "j").sortWithinPartitions("b", "i", "j")
    return shared.map_arrow(rows, pruner(s), "a long, b long").distinct()


def _links(reps: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(node, root) of the components of reps (id, n, bands) that have a link.

    Each bucket compares its members with one centre, the member whose buckets are
    fullest.  Two members of a bucket thus meet in the star of its centre, and what
    the comparisons with the centre tell leaves few further pairs possible; those
    in different components are compared in full.  No link between components is
    lost, and no pair is made that could change nothing.
    """
    exploded = reps.select("id", F.explode("bands").alias("key"))
    full = exploded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").withColumn("size", F.col("c"))
    members = shared.attach(exploded, full, "key", "c", s.bands * reps.count(), F.xxhash64("id", "key"))
    members = shared.staged(members.where("size is not null"), "buckets")
    total = members.count()
    scored = members.join(members.groupBy("id").agg(F.sum("size").alias("score")), "id")
    best = F.max(F.struct("score", (-F.col("id")).alias("low")))
    centre = scored.groupBy("key").agg((-best["low"]).alias("b"), F.count("*").alias("c"))
    pairs = shared.attach(members, centre, "key", "c", total, F.xxhash64("id", "key"))
    pairs = shared.staged(pairs.select(F.col("id").alias("a"), "b").where("a != b").distinct(), "pairs")
    texts = shared.staged(texts.join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), "texts")
    stars = _compared(pairs, texts, s)
    linked = F.col("both") * s.den >= (F.col("na") + F.col("nb") - F.col("both")) * s.num
    edges = stars.where(linked).select("a", "b")
    comps = shared.components(edges)
    more = shared.staged(_open_pairs(stars, comps, s), "pairs")
    found = _compared(more, texts, s).where(linked).select("a", "b")
    return shared.components(comps.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    s: Settings = Settings()) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row with an id.

    Documents are linked where their shingle sets pass the threshold of `s`, tested
    on full sets; component_id is the smallest id reachable over links.  Equal sets
    are one class from the start, found by digest, so copies are never paired.
    Texts that are null, empty or all white space have no shingle and link with
    nothing.  Repeated rows fall into one class; a row with a null id is left out.
    Only the two named columns are read, so other columns cannot clash.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    schema = "id long, n long, digest binary, bands array<long>"
    sig = shared.staged(shared.map_arrow(texts, sign_batches(s), schema), "signatures")
    classes = sig.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("c"))
    classes = shared.staged(classes, "classes")
    reps = sig.where("n > 0").join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    reps = shared.staged(reps.drop("digest"), "representatives")
    comps = _links(reps, texts, s)
    roots = classes.join(comps, classes["rep"] == comps["node"], "left")
    roots = roots.select("digest", "c", F.coalesce("root", "rep").alias("root"))
    out = shared.attach(sig.select("id", "n", "digest"), roots, "digest", "c", sig.count(),
                        F.unhex(F.md5(F.col("id").cast("string"))))
    root = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), root.alias("component_id"),
                      (root == F.col("id")).alias("kept"))
