"""The operators against brute force, on whole small tables and on hard rows."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
import compare
from jobweave.llm import (
    decontaminate, linededup, minhash, ordering, packing, quality, queries, shared, sharding, textscan, tokens, topk, toxicity,
    unitdedup,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, kind string, `group` string, c long"
R = random.Random(11)
WORDS = ["w%03d" % k for k in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


def row(i, text, source="s"):
    return (i, text, "en", source, len(text or ""), 7, "k", "g", 1)


PASSAGE = prose(60)
LONG = "\n".join(prose(12) for _ in range(4000))
HARD = [
    row(1, None), row(2, ""), row(3, " \t\n"), row(4, "One"), row(5, PASSAGE), row(6, prose(30) + "\n" + PASSAGE + "\n" + prose(9)),
    row(7, "Füße naïve 日本語 <|endoftext|> it's"), row(8, LONG), row(9, LONG), row(10, "same same same same same same"),
    row(10, "same same same same same same"), row(None, "no id " + prose(20)), row(11, None, None), row(12, PASSAGE.upper()),
    row(13, prose(40) + " " + PASSAGE + " " + prose(40)),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return shared.table(spark, sf, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# shared helpers ---------------------------------------------------------------------------------

def test_hot_keys_attach_exactly(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("c"), F.max("id").alias("top")).where("k % 2 = 0")
    got = {r.id: r.top for r in shared.attach(left, right, "k", "c", 5000, -1 - F.col("id")).collect()}
    want = {r.id: r.top for r in left.join(right, "k", "left").select("id", "top").collect()}
    assert got == want


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    r = random.Random(3)
    pairs = {"chain": [(k, k + 1) for k in range(60)], "star": [(90, k) for k in range(40)],
             "random": [(r.randrange(120), r.randrange(120)) for _ in range(70)]}[shape]
    root = {k: k for p in pairs for k in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in shared.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}


def test_word_hashes_follow_text():
    s = next(textscan.slices(pa.array(["The cat", None, "the  CAT\n", "cat the"])))
    w = textscan.words(s)
    assert w.first.tolist() == [0, 2, 2, 4, 6]
    assert w.hash[0] == w.hash[2] == w.hash[5] and w.hash[1] == w.hash[3] == w.hash[4] != w.hash[0]


def test_units_join_to_the_text():
    for text in ["a b. c\n\nd! e?\tf", "", "\n", "x\n", "no end.", ". . .", "é. ü"]:
        s = next(textscan.slices(pa.array([text, "next"])))
        u = textscan.units(s, sentences=True)
        own = [s.data[a:b].tobytes().decode() for a, b in zip(u.start, u.end)][:u.first[1]]
        assert own == brute.units(text)


# 1 line dedup -----------------------------------------------------------------------------------

def test_line_dedup_equals_all_pairs(spark):
    r = random.Random(5)
    pool = [[prose(r.randint(3, 30), r) for _ in range(r.randint(1, 4))] for _ in range(12)]
    data = []
    for i in range(40):
        lines = [prose(10, r) for _ in range(3)]
        for block in r.sample(pool, 3):
            at = r.randint(0, len(lines))
            lines[at:at] = [*block, prose(8, r)]
        data.append((i, "\n".join(lines)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {x.doc_id: x.text for x in linededup.deduplicate(df).collect()}
    pieces = []
    for _, text in data:
        part = next(textscan.slices(pa.array([text])))
        u = textscan.units(part)
        pieces.append((u.hash, textscan.unit_words(part, u).astype(np.int32)))
    assert len(got) == 40
    removed = 0
    for i, text in data:
        gone = set()
        for j in range(i):
            for a, b in linededup.blocks(*pieces[i], pieces[j][0], 25):
                gone.update(range(a, b))
        lines = text.splitlines(keepends=True)
        assert got[i] == "".join(x for k, x in enumerate(lines) if k not in gone)
        removed += len(gone)
    assert removed > 50


def hashed(text):
    part = next(textscan.slices(pa.array([text])))
    u = textscan.units(part)
    return u.hash, textscan.unit_words(part, u).astype(np.int32)


def test_line_dedup_takes_repeated_and_crossed_blocks():
    p, x, y, z, u, v = prose(60), *(prose(5) for _ in range(5))
    for later, earlier, gone in (([u, p, v], [x, p, y, p, z], {1}), ([u, p, v, p, x], [y, p, z], {1, 3}),
                                 ([p, x, y], [x, y, p], {0}), ([x, y, p], [p, x, y], {2}), ([u, v], [u, x, v], set())):
        got = linededup.blocks(*hashed("\n".join(later)), hashed("\n".join(earlier))[0], 25)
        assert {k for a, b in got for k in range(a, b)} == gone


def test_line_dedup_equals_blocks_of_earlier_documents(spark):
    r = random.Random(8)
    pool = [prose(r.choice((3, 8, 14, 27, 60)), r) for _ in range(14)]
    data = [(i, "\n".join(r.choice(["", prose(6, r), *r.choices(pool, k=6)]) for _ in range(r.randint(1, 9)))) for i in range(60)]
    data += [(-1, "\n".join([pool[-1], PASSAGE, prose(7, r), PASSAGE])), (70, "a\n" + PASSAGE + "\nb\n" + PASSAGE)]
    data += [(71, PASSAGE + "\ntail of few words"), (72, PASSAGE + "\ntail of few words\nmore")]
    got = {x.doc_id: x.text for x in linededup.deduplicate(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    gone = brute.lines_held_before(data, 25)
    for i, text in data:
        assert got[i] == "".join(x for k, x in enumerate(text.splitlines(keepends=True)) if k not in gone[i])
    assert got[70] == "a\nb\n" and got[72] == "more"


def test_patience_matches_common_lines():
    assert linededup.patience(list("abcde"), list("abXde")) == [(0, 0), (1, 1), (3, 3), (4, 4)]
    assert linededup.patience([], [1]) == []
    assert linededup.patience([1, 1, 2, 1], [1, 2, 1, 1]) [0] == (0, 0)


def test_line_dedup_of_hard_rows(hard, none):
    got = linededup.deduplicate(hard).collect()
    assert len(got) == len(HARD)
    by = defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
    assert by[1][0].text is None and by[2][0].text == "" and by[3][0].text == " \t\n"
    assert by[5][0].text == PASSAGE and PASSAGE not in by[6][0].text and by[12][0].text == ""
    assert by[8][0].text == LONG and by[9][0].text == ""
    assert [x.text for x in by[10]] == ["same same same same same same"] * 2
    assert by[5][0].id == 7 and by[5][0].group == "g"
    assert linededup.deduplicate(none).count() == 0


# 2 near dedup -----------------------------------------------------------------------------------

def test_near_dedup_equals_brute_force(spark, sf, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op2_minhash_near_dedup"](spark, sf).collect()}
    want = brute.components(texts, 3, 85, 100)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) and r.n_shingles == len(brute.shingles(dict(texts)[i], 3)) for i, r in got.items())


def test_near_dedup_of_a_family_with_links_beside_the_centre(spark):
    """Copies around the threshold: many are linked with some copies and not with others."""
    r = random.Random(9)
    base = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(150)]
    data, at = [], 0
    for _ in range(160):
        copy = list(base)
        for k in r.sample(range(150), r.randint(0, 9)):
            copy[k] = "x%d" % r.randrange(40)
        data.append((at, " ".join(copy)))
        at += r.randint(1, 3)
    data += [(at + k, " ".join(base[:n])) for k, n in enumerate((150, 140, 130, 120, 110, 100))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for n, num in ((3, 85), (5, 80)):
        got = {x.doc_id: x.component_id for x in minhash.near_duplicates(df, s=minhash.Settings(words=n, num=num)).collect()}
        assert got == brute.components(data, n, num, 100)


def test_near_dedup_of_hard_rows(hard, none):
    got = minhash.near_duplicates(hard).collect()
    assert len(got) == len(HARD) - 1                      # all but the row without an id
    by = {x.doc_id: x for x in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[2].kept and by[11].kept
    assert by[9].component_id == 8 and by[12].component_id == 5 and not by[12].kept
    assert minhash.near_duplicates(none).count() == 0


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    near = []
    for _ in range(200):
        x = r.integers(1, 1 << 63, 500, dtype=np.uint64)
        a, b = minhash.signatures([np.sort(x[:450]), np.sort(x[50:])], 128)
        near.append((a == b).mean())
    assert abs(np.mean(near) - 0.8) < 0.01 and np.std(near) < 0.0354     # below independent permutations


# 3 sharding -------------------------------------------------------------------------------------

def test_shards_are_balanced_and_whole(spark, sf, texts):
    got = queries.QUERIES["op3_vector_bin_shards"](spark, sf).collect()
    text = dict(texts)
    assert len(got) == len(text) and {r.doc_id for r in got} == set(text)
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    size = Counter()
    shard = defaultdict(set)
    slots = defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        shard[text[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
    assert max(size.values()) <= 1.05 * min(size.values()) and len(size) == 8
    assert all(len(x) == 1 for x in shard.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_a_large_group_is_cut(spark):
    data = [(k, "copy of one text" if k % 3 == 0 else prose(5)) for k in range(900)]
    got = sharding.assign(spark.createDataFrame(data, "doc_id long, text string")).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert len(got) == 900 and max(size.values()) <= 1.1 * min(size.values())


def test_shards_of_hard_rows(hard, none):
    got = sharding.assign(hard).collect()
    assert len(got) == len(HARD)
    assert [(r.size, r.text_crc32, r.tokens) for r in got if r.doc_id in (1, 2)] == [(1, 0, 0)] * 2
    assert sharding.assign(none).count() == 0


# 4 unit dedup -----------------------------------------------------------------------------------

def test_unit_dedup_equals_brute_force(spark, sf, texts):
    want = brute.without_repeats(texts, 25)
    got = queries.QUERIES["op4_unit_dedup"](spark, sf).collect()
    text = dict(texts)
    assert {r.doc_id: r.text for r in got} == want
    for r in got:
        left, at = [], 0
        for x in r.removed:
            left.append(text[r.doc_id][at:x.start])
            at = x.stop
        assert "".join([*left, text[r.doc_id][at:]]) == r.text
    assert sum(bool(r.removed) for r in got) > 5


def test_unit_dedup_of_hard_rows(hard, none):
    got = unitdedup.deduplicate(hard).collect()
    by = defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
    assert len(got) == len(HARD) and by[1][0].text is None and by[2][0].text == ""
    assert by[5][0].text == PASSAGE and PASSAGE not in by[6][0].text and by[9][0].text == "" and by[12][0].text == ""
    assert unitdedup.deduplicate(none).count() == 0


# 5 decontamination ------------------------------------------------------------------------------

def test_overlaps_equal_brute_force(spark, sf, docs):
    bench = shared.table(spark, sf, "benchmark")
    some = docs.where("doc_id < 60")
    got = {r.doc_id: {h.item_id for h in r.hits} for r in decontaminate.overlaps(some, bench).collect()}
    items = {r.item_id: brute.tokens(r.text) for r in bench.collect()}
    want = {}
    for r in some.collect():
        mine = brute.tokens(r.text)
        held = set(mine)
        want[r.doc_id] = {i for i, t in items.items() if len(held & set(t)) >= 4
                          and (b := brute.best_overlap(mine, t, 4))[0] >= min(13, len(t))}
    assert got == want


def test_substitutions_are_tolerated_and_blocks_agree(spark):
    r = random.Random(2)
    items = [(k, prose(30, r)) for k in range(30)] + [(90, "tiny item"), (91, ""), (92, None), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    data = []
    for k in range(30):
        copy = items[k][1].split()
        for at in r.sample(range(30), 3):
            copy[at] = "zz"
        data.append((k, prose(20, r) + " " + " ".join(copy) + " " + prose(20, r)))
    data += [(100, prose(300, r)), (101, None), (102, ""), (103, "a Tiny, ITEM here")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {x.doc_id: [h.item_id for h in x.hits] for x in decontaminate.overlaps(df, bench).collect()}
    assert sum(k in got[k] for k in range(30)) >= 28
    assert got[100] == got[101] == got[102] == [] and got[103] == [90]
    small = decontaminate.Settings(block_bytes=600)
    again = {x.doc_id: sorted(h.item_id for h in x.hits) for x in decontaminate.overlaps(df, bench, s=small).collect()}
    assert again == {k: sorted(v) for k, v in got.items()}
    left = {x.doc_id for x in decontaminate.decontaminate(df, bench, s=small).collect()}
    assert left == {k for k, v in got.items() if not v}


def test_planted_items_with_substitutions_equal_brute_force(spark):
    """Items of 10 to 40 tokens copied with 10 to 20% of their tokens substituted, whole or in part."""
    r = random.Random(4)
    items = [(k, prose((10, 20, 30, 40)[k % 4], r)) for k in range(120)]
    data = []
    for k, text in items:
        copy = [w if r.random() >= (0.1, 0.15, 0.2)[k % 3] else "zz%d" % r.randrange(99) for w in text.split()]
        copy = copy[:r.choice((len(copy), len(copy), 14))]
        data.append((k, prose(r.randrange(9), r) + " " + " ".join(copy) + " " + prose(r.randrange(9), r)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    s = decontaminate.Settings()
    rows = decontaminate.overlaps(spark.createDataFrame(data, "doc_id long, text string"), bench).collect()
    got = {x.doc_id: {h.item_id for h in x.hits} for x in rows}
    want = {k: {i for i, t in items if brute.alike(brute.tokens(text), brute.tokens(t), 13, s.masks)} for k, text in data}
    assert got == want
    for x in rows:
        assert all(5 * h.matches >= 4 * (h.stop - h.start) and h.stop - h.start >= min(13, len(items[h.item_id][1].split())) for h in x.hits)
    # seeds are what may be missed: copies of this identity that no mask hits
    every = {k for k, text in data if brute.alike(brute.tokens(text), brute.tokens(items[k][1]), 13, ["1"])}
    assert sum(k in got[k] for k in every if len(items[k][1].split()) >= 13) >= 0.95 * sum(len(items[k][1].split()) >= 13 for k in every)


def test_decontamination_of_hard_rows(hard, none, spark):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    kept = decontaminate.decontaminate(hard, bench)
    assert kept.columns == hard.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 7, 8, 9, 10, 11, None}
    assert kept.count() == len(HARD) - 4
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.overlaps(hard, bench.limit(0)).count() == len(HARD)
    bench = spark.createDataFrame([(1, PASSAGE), (2, prose(50))], "item_id long, text string")
    small = decontaminate.Settings(block_bytes=100)          # two passes report repeated rows one by one too
    once, twice = (sorted(map(str, decontaminate.overlaps(hard, bench, s=s).collect())) for s in (decontaminate.Settings(), small))
    assert once == twice and len(twice) == len(HARD)


# 6 training order -------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_permutes(n):
    f = ordering.Feistel(n, 42)
    slots = f.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert f.number(slots).tolist() == list(range(n))
    if n > 100:
        assert not (slots == ordering.Feistel(n, 43).slot(np.arange(n))).all()


def test_sequences_are_read_back(spark, hard, none, tmp_path):
    path, s = str(tmp_path / "order"), ordering.Settings(length=64, records=16)
    total = ordering.materialise(hard, queries.vocabulary(), path, s=s)
    got = ordering.read(spark, path, s=s).collect()
    assert sorted(r.slot for r in got) == list(range(total)) and all(r.byte == r.slot % 16 * s.stride for r in got)
    have = Counter((r.id, r.start, r.length, r.ids_crc32) for r in got)
    tok = tokens.Encoder(queries.vocabulary()).tokenizer
    want = Counter()
    for i, text, *_ in HARD:
        if i is not None:
            ids = [*tok.encode(text or "", add_special_tokens=False).ids, 49407]
            for a in range(0, len(ids), 64):
                part = ids[a:a + 64]
                want[i, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert have == want
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min("shard").alias("low"), F.max("shard").alias("high"), F.count("*").alias("n")).orderBy("file").collect()
    assert len(files) == 8 and sum(f.n for f in files) == -(-total // s.records)
    assert all(f.high - f.low + 1 == f.n for f in files) and all(a.high + 1 == b.low for a, b in zip(files, files[1:]))
    again = ordering.read(spark, path, first=total - 20, s=s).collect()
    assert {r.slot for r in again} == set(range(total - 20, total))
    assert ordering.materialise(none, queries.vocabulary(), str(tmp_path / "none"), s=s) == 0


# 7 packing --------------------------------------------------------------------------------------

def check_packing(rows, data, window):
    tok = tokens.Encoder(queries.vocabulary()).tokenizer
    want = defaultdict(list)
    for i, text in data:
        want[i].append([*tok.encode(text or "", add_special_tokens=False).ids, 2])
    seq, by = defaultdict(list), defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id].append(r)
    for pieces in seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
    assert set(by) == set(want)
    for i, pieces in by.items():
        if len(want[i]) > 1:
            continue
        ids, at = want[i][0], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in rows) == sum(len(x) for v in want.values() for x in v)
    return seq


def test_packing_round_trip(spark, sf, texts):
    got = queries.QUERIES["op7_mixture_packing"](spark, sf).collect()
    seq = check_packing(got, texts, 4096)
    total = sum(r.length for r in got)
    assert len(seq) == -(-total // 4096)                  # only the last window is padded


def test_packing_keeps_the_mixture(spark):
    data = [(k, prose(r), "abc"[k % 3]) for k, r in enumerate([400] * 60)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    s = packing.Settings(window=512, mixture=(("a", 0.5), ("b", 0.3), ("c", 0.2)), quantum=32)
    got = packing.pack(df, queries.vocabulary(), s=s).collect()
    check_packing(got, [(i, t) for i, t, _ in data], 512)
    share = defaultdict(Counter)
    for r in got:
        share[r.sequence_id][r.source] += r.length
    first = [share[k] for k in sorted(share)][:40]
    for k, x in enumerate(first):
        assert abs(x["a"] - 256) <= 64 and abs(x["b"] - 154) <= 64 and abs(x["c"] - 102) <= 64
    total = sum(first, Counter())
    assert abs(total["a"] / sum(total.values()) - 0.5) < 0.01


def test_packing_keeps_the_corpus_mixture_in_every_window(spark):
    """Buckets of a few documents, a source of one long document and one of few."""
    r = random.Random(6)
    data = [(k, prose(100, r), "many") for k in range(300)] + [(900, prose(12_000, r), "one")]
    data += [(1000 + k, prose(2_000, r), "few") for k in range(4)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    s = packing.Settings(window=512, bucket_bytes=20_000, rests=4, quantum=32)
    got = packing.pack(df, queries.vocabulary(), s=s).collect()
    check_packing(got, [(i, t) for i, t, _ in data], 512)
    share, total = defaultdict(Counter), Counter()
    for x in got:
        share[x.sequence_id][x.source] += x.length
        total[x.source] += x.length
    full = [x for x in share.values() if sum(x.values()) == 512]
    assert len({k >> 32 for k in share if k < 1 << 62}) > 8 and len(full) > 200
    for name in total:
        want = 512 * total[name] / sum(total.values())
        assert sum(abs(x[name] - want) <= 96 for x in full) >= 0.98 * len(full)
        assert abs(sum(x[name] for x in full) / len(full) - want) < 8
    again = packing.pack(df.repartition(5), queries.vocabulary(), s=s).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_packing_of_many_buckets_and_hard_rows(hard, none):
    s = packing.Settings(bucket_bytes=50_000, rests=4)
    got = packing.pack(hard, queries.vocabulary(), s=s).collect()
    check_packing(got, [(i, t) for i, t, *_ in HARD], 4096)
    assert {r.source for r in got} == {"s", ""} and packing.pack(none, queries.vocabulary()).count() == 0


def test_memo_equals_the_tokenizer():
    r = random.Random(1)
    texts = ["", "it's '' don''t I'll you'RE 'street 'x", "a1b22 3½²", "É ÀÉ ß µ ª", "日本語", "<|endoftext|> <| b", "Σας İ é",
             "x y so­ft", "''s x's's o'clock'd're", "a\x0bb\x00c\x85d ɐɏ"]
    texts += ["".join(r.choice("ab's ltdmrev1½é'. !\n") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    e = tokens.Encoder(queries.vocabulary(), limit=64)     # so small that it is emptied over and over
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for part in textscan.slices(pa.array(texts), 300):
        ids, first = e.encode(part)
        for k in range(part.count):
            assert ids[first[k]:first[k + 1]].tolist() == want[part.row + k]


# 8, 9 classifiers -------------------------------------------------------------------------------

@pytest.mark.parametrize("name, label, least", [("op8_attention_quality", "quality", 0.95), ("op9_pu_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    big = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, big).join(shared.table(spark, big, "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r[label] for r in held) / len(held) >= least


def test_classifiers_of_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(5, 1, 1), (6, 0, 0), (8, 1, 0), (4, None, None), (None, 1, 1), (77, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        model = module.fit(hard, labels)
        got = module.score(hard, model).collect()
        assert len(got) == len(HARD) and all(0 <= r.score <= 1 for r in got)
        assert module.score(none, model).count() == 0
        assert module.score(hard, module.fit(none, labels.limit(0))).count() == len(HARD)
    kept = toxicity.reject(hard, toxicity.fit(hard, labels), threshold=1.1)
    assert kept.columns == hard.columns and kept.count() == len(HARD)


def test_attention_gradient():
    s = quality.Settings(code=5, gate=3)
    m = quality.Model(s, 4)
    r = np.random.default_rng(0)
    x, first = r.normal(size=(7, 4)), np.array([0, 3, 4, 7])
    y = np.array([1.0, 0, 1])
    loss = lambda: float(np.logaddexp(0, z := m.forward(x, first)[0]).sum() - (y * z).sum())
    logit, kept = m.forward(x, first)
    grad = m.gradient(first, kept, 1 / (1 + np.exp(-logit)) - y)
    for name, p in m.p.items():
        at = tuple(0 for _ in p.shape)
        old = p[at]
        p[at] = old + 1e-6
        up = loss()
        p[at] = old - 1e-6
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-6 - grad[name][at]) < 1e-4


# 10 top-k ---------------------------------------------------------------------------------------

def test_top_k_equals_sql(spark, sf):
    got = queries.QUERIES["op10_ball_tree_top_k"](spark, sf)
    assert compare.difference(got, compare.connect(sf), queries.ORACLE["op10_ball_tree_top_k"]) is None


def test_top_k_of_hard_vectors(spark):
    r = random.Random(4)
    data = [(k, [float(r.randint(-2, 2)) for _ in range(3)]) for k in range(200)]
    data += [(200, None), (201, [1.0, None, 1.0]), (202, [1.0, float("nan"), 0.0]), (203, [float("inf"), 0.0, 0.0]),
             (204, [1.0, 2.0]), (206, [3.0, 1.0]), (None, [1.0, 1.0, 1.0]), (208, []), data[4], data[6]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    s = topk.Settings(shard_rows=40, query_block=30, leaf=4, first_modulus=4)
    got = defaultdict(list)
    for x in topk.top_k(df, df.where("vec_id % 2 = 0"), s=s).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.score, x.vec_id))
    good = {i: [int(np.floor(256 * e)) for e in v] for i, v in data[:200]}
    for q in range(0, 200, 2):
        all_ = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:5]
        assert got[q] == [(-a, i) for a, i in all_]
    assert got[204] == [(256 * 256 * 5, 206)] and got[206] == [(256 * 256 * 5, 204)] and not got[202] and not got[208]
    empty = df.limit(0)
    assert topk.top_k(empty, empty).count() == 0


def test_top_k_of_large_components(spark):
    """Finite components of any size take part and rank by exact whole numbers."""
    from fractions import Fraction
    r = random.Random(14)
    data = [(k, [float(r.randint(-3, 3)) for _ in range(3)]) for k in range(60)]
    data += [(60, [1e7, 1.0, -1e7]), (61, [1e30, 0.0, 1.0]), (62, [1e30, 0.5, 1.0]), (63, [-1e30, 1.0, 1.0]), (64, [1e308, -1e308, 1.0]),
             (65, [1.5e308, 1.0, 0.0]), (66, [1e-308, 0.0, 0.0]), (67, [3e9, 3e9, 3e9]), (68, [3e9, 3e9, 3e9 + 1]), (69, [1e30, 0.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    s = topk.Settings(shard_rows=40, query_block=30, leaf=4, first_modulus=4, wide_rows=7)
    for x in topk.top_k(df, df.where("vec_id % 2 = 0 or vec_id > 59"), s=s).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.score, x.vec_id))
    good = {i: [int(Fraction(e) * 256 // 1) for e in v] for i, v in data}
    held = lambda n: max(-2 ** 63, min(2 ** 63 - 1, n))
    for q in [*range(0, 60, 2), *range(60, 70)]:
        best = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:5]
        assert got[q] == [(held(-n), i) for n, i in best], q


# one id with several texts -----------------------------------------------------------------------

def test_texts_that_share_an_id_lose_nothing_of_their_own(spark):
    r = random.Random(21)
    passage, tail, unique = prose(60, r), prose(30, r), prose(30, r)
    rows = [row(1, passage), row(2, passage + "\n" + tail), row(2, unique + "\n" + tail), row(2, unique + "\n" + tail)]
    df = spark.createDataFrame(rows, DOCS)
    lines = sorted(x.text for x in linededup.deduplicate(df).collect())
    assert lines == sorted([passage, tail, unique + "\n" + tail, unique + "\n" + tail])
    units = [x.text for x in unitdedup.deduplicate(df).collect()]
    assert sum(unique in t for t in units) == 2 and sum(passage in t for t in units) == 1 and any(tail in t for t in units)
    # an earlier id with two texts is a partner with both
    more = spark.createDataFrame([row(1, passage), row(1, unique), row(3, unique + "\n" + passage + "\n" + tail)], DOCS)
    assert sorted(x.text for x in linededup.deduplicate(more).collect()) == sorted([passage, unique, tail])


def test_moved_blocks_take_one_pass():
    r = random.Random(22)
    n = 100_000
    lines = np.array(r.sample(range(1, 1 << 60), n), np.uint64)
    words = np.full(n, 30, np.int32)
    import time
    start = time.time()
    found = linededup.blocks(lines[::-1].copy(), words, lines, 25)
    gone = np.zeros(n, bool)
    for a, b in found:
        gone[a:b] = True
    assert gone.all() and time.time() - start < 30
