"""Spelling variants, periodic runs and byte-level BPE against brute force and the tokenizer library."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobweave.llm import bpe, periodic, queries, shared, variants

DOCS = "doc_id long, text string, lang string, n long, word string, `key` string, start long, __n long"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1, "w", "k", 2, 3) for i, t in texts], DOCS)


# spelling variants -----------------------------------------------------------------------------

def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(texts, planted, letters=6, occurrences=5, ratio=5):
    seen = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if planted and i is not None and h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    n = {w: k for w, k in seen.items() if len(w) >= letters and k >= occurrences}
    near = {w: [x for x in n if x != w and is_near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def misspelt(r, words=60, texts=150):
    stock = ["".join(r.choice("abcdefÉéüß") for _ in range(r.randrange(5, 10))) for _ in range(words)]
    wrong = {}
    for w in stock:
        k = r.randrange(len(w))
        wrong[w] = [w[:k] + w[k + 1:], w[:k] + r.choice("abÉü") + w[k:], w[:k] + r.choice("abÉü") + w[k + 1:]]
    out = []
    for i in range(texts):
        line = []
        for _ in range(r.randrange(60)):
            w = stock[int(len(stock) * r.random() ** 2)]
            if r.random() < 0.2:
                w = r.choice(wrong[w])
            line.append(w.upper() if r.random() < 0.1 else w)
        out.append((i, r.choice([" ", "-", "1", "Ā"]).join(line)))
    return out


@pytest.mark.parametrize("group", [4096, 2])
def test_variants_brute_force(spark, group):
    texts = misspelt(random.Random(group)) + [(None, "abcdef " * 6), (7, None), (8, ""), (9, " 1 2\n"), (9, "abcdef " * 6),
                                              (10, "x" * 200_000), (11, "×÷" * 4 + " ") ] + [(20, "Abcdef " * 40)] * 2
    got = rows_of(variants.group(table(spark, texts), s=variants.Settings(group=group, block=8), rewrite=variants.planted()))
    want = brute_variants(texts, True)
    assert got == want and sum(x[0] is not None for x in want.values()) > 20


def test_variant_groups_of_one_prefix(spark):
    """A third of the words share their first letters: the groups are split and lose no pair."""
    r = random.Random(4)
    words = {"commonprefix" + "".join(r.choice("abcd") for _ in range(5)) for _ in range(400)}
    words |= {"".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(800)}
    df = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long")
    s = variants.Settings(group=40, block=64)
    sizes = variants.grouped(df, s).groupBy("key").count().agg(F.max("count")).first()[0]
    got = {(x.word, x.near) for x in variants.near_pairs(df, s).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and is_near(a, b)}
    assert sizes <= 64                               # two letters of four, and words one letter longer


def test_bit_sliced_index():
    r = random.Random(2)
    for _ in range(40):
        words = list({"".join(r.choice("abé") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 150))})
        want = {(a, b) for a in words for b in words if a != b and is_near(a, b)}
        for step in (4, 1024):                       # groups larger than a block meet block by block
            got = [p for b in variants._pairs(words, [1] * len(words), step) for p in zip(*(b.column(k).to_pylist() for k in (0, 1)))]
            assert len(got) == len(set(got)) and set(got) == want


def test_chains_reach_the_last_form(spark):
    n = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125}
    texts = [(1, " ".join(w for w, k in n.items() for _ in range(k)))]
    got = rows_of(variants.group(table(spark, texts)))
    assert {w: x[1] for w, x in got.items()} == dict.fromkeys(n, "aabbbb") and got["aabbbb"][0] is None


def test_variants_of_no_rows(spark):
    assert variants.group(table(spark, [])).collect() == []
    assert variants.group(table(spark, [(1, None), (2, "")])).collect() == []


# periodic runs ---------------------------------------------------------------------------------

def brute_runs(w, least=24, times=3):
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            part = w[i:j + q]
            if j > i and len(part) >= max(least, times * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def brute_digest(i, text, planted=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if planted and i is not None and w:
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = brute_runs(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    top = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def repetitive(r):
    w = []
    letters = r.choice([1, 2, 3, 5, 50])
    for _ in range(r.randrange(1, 8)):
        p = [str(r.randrange(letters)) for _ in range(r.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 30, 33, 64, 65, 90]))]
        w += (p * 6)[:r.randrange(1, 5 * len(p))] if r.random() < 0.6 else [str(r.randrange(letters)) for _ in range(r.randrange(30))]
    return w


def test_runs_brute_force():
    r = random.Random(1)
    morse = [str(k.bit_count() % 2) for k in range(1024)]
    fib = ["a"], ["a", "b"]
    for _ in range(12):
        fib = fib[1], fib[1] + fib[0]
    texts = [repetitive(r) for _ in range(400)] + [morse, fib[1], ["x"] * 2000, [], ["x"] * 24, ["x"] * 23, ["a", "b"] * 12, morse * 3]
    got = list(periodic.texts_runs([[x.encode() for x in w] for w in texts], periodic.Settings()))
    want = [brute_runs(w) for w in texts]
    assert [x for _, x in got] == want and sum(map(len, want)) > 200


@pytest.mark.parametrize("least,times", [(3, 3), (10, 4), (50, 3)])
def test_runs_of_other_settings(least, times):
    r = random.Random(least)
    texts = [repetitive(r) for _ in range(120)]
    got = periodic.texts_runs([[x.encode() for x in w] for w in texts], periodic.Settings(least, times))
    assert [x for _, x in got] == [brute_runs(w, least, times) for w in texts]
    with pytest.raises(ValueError):
        periodic.Settings(times=2)


def test_long_run_is_extended_once():
    """A million equal words and as many others take about as long as reading them."""
    r = random.Random(3)
    words = [b"%d" % r.randrange(1000) for _ in range(300_000)] + [b"a", b"b"] * 150_000
    (_, found), = periodic.texts_runs([words], periodic.Settings())
    assert found[-1][1:] == (300_000, 2) and len(found) == 1


def test_runs_query(spark, sf):
    docs = shared.table(spark, sf, "documents")
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_periodic_runs"](spark, sf).collect()}
    want = {r.doc_id: brute_digest(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    assert got == want and any(x[0] for x in want.values())


def test_runs_of_hard_rows(spark):
    r = random.Random(9)
    texts = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 30), (4, "a b " * 30), (4, "a b " * 30), (5, " x " * 40),
             (6, " ".join(map(str, r.choices(range(9), k=50_000)))), *((k, " ".join(repetitive(r))) for k in range(100, 160))]
    found = periodic.find(table(spark, texts), rewrite=periodic.planted)
    assert {"lang", "start", "__n"} <= set(found.columns)
    small = [x for x in texts if len(x[1] or "") < 10_000]
    got = Counter(tuple(x) for x in periodic.digest(found).where("doc_id is null or doc_id <> 6").collect())
    assert got == Counter((i, *brute_digest(i, t)) for i, t in small)
    assert periodic.digest(periodic.find(table(spark, []))).collect() == []


# byte-level BPE --------------------------------------------------------------------------------

def hard_texts():
    r = random.Random(5)
    pieces = ["<|endoftext|>", " the", "  ", "\n\n", "it's", "'LL", "日本", "ﬁ", "٣", "\U0001f600", "՘", "꟝",
              "é", "é", "1", "_", "’", "\x1f", "\x85", "　"]
    out = ["", "a" * 500, "ab" * 400, "\n" * 300, " " * 500 + "x", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endof", "A" * 900 + "1" * 700]
    for _ in range(400):
        out.append("".join(r.choice([r.choice(pieces), chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x600), r.randrange(0x2000, 0x3100)]))])
                           for _ in range(r.randrange(1, 40))))
    return out


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def library_row(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_bpe_equals_library(library, monkeypatch):
    c = bpe.Codec(BYTE_BPE)
    for stretch in (1 << 16, 20):
        monkeypatch.setattr(bpe, "STRETCH", stretch)
        for text in hard_texts():
            ids = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(c.encode(text), "<u4").tolist() == ids, text
            assert c.decode(c.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_heap_takes_the_same_merges():
    c, r = bpe.Codec(BYTE_BPE), random.Random(8)
    for _ in range(300):
        ids = [c.first[r.choice(b"aehinrst oe\xc3\xa9")] for _ in range(r.randrange(1, 120))]
        assert c._scan(list(ids)) == c._heap(list(ids))
    assert b"".join(c.bytes[i] for i in c.merge(b"q" * 100_000)[0]) == b"q" * 100_000


def test_decode_of_any_ids(library):
    c, r = bpe.Codec(BYTE_BPE), random.Random(6)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(r.randrange(30))]
        assert c.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, sf, library):
    docs = shared.table(spark, sf, "documents")
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op13_byte_bpe"](spark, sf).collect()}
    assert got == {r.doc_id: library_row(library, r.text) for r in docs.select("doc_id", "text").collect()}


def test_bpe_of_hard_rows(spark, library):
    texts = [(1, None), (1, None), (None, "no id"), *enumerate(hard_texts(), 2), (3, "x" * 300_000 + " y" * 300_000)]
    encoded = bpe.encode(table(spark, texts).drop("__n"), BYTE_BPE)
    assert {"lang", "word", "__n", "__ids"} <= set(encoded.columns)
    got = Counter(tuple(r) for r in bpe.round_trip(table(spark, texts), BYTE_BPE).collect())
    assert got == Counter((i, *library_row(library, t)) for i, t in texts)
    assert bpe.round_trip(table(spark, []), BYTE_BPE).collect() == []
