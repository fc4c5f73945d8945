"""Byte-level BPE by contiguous rank arrays, and its inverse.

A text is cut at special tokens and then into words by the vocabulary's pattern.
A short word is held as two contiguous arrays, the boundaries of its parts and the
rank of the merge between each part and the next.  The smallest rank is found by a
scan (the leftmost of equals), the boundary between its two parts is deleted, and
the ranks on both sides are looked up again, until no rank is left.  Scanning costs
the square of a word's length, so words over `SHORT` bytes take the same merges
from a heap.  Words come back from a bounded memo of their Python worker.

Long texts are worked through in stretches that end where a word surely ends, so
memory beside a text and its ids does not follow its length.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm import shared, textscan

#: Fixed value of the format: the pattern that byte-level vocabularies cut words by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more bytes than this are merged from a heap.
SHORT = 128
#: Characters of one stretch of a text, and words a worker remembers.
STRETCH, MEMO = 1 << 16, 1 << 18
NONE = 1 << 60

_WORDS = regex.compile(PATTERN)
#: A word ends before white space, and between a letter and a digit.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
#: Letters and digits outside these ranges are still being added to Unicode, and libraries differ in what they know.
_YOUNG = regex.compile(r"[^\u0000-ԯ -⁯₠-₿　-〩ぁ-ゖァ-ヺ一-龥가-힣]")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(other)}}


class Codec:
    """Encoder and decoder of a vocabulary file with byte-level merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        self.vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*self.vocab.values(), *added.values()])
        self.first = [0] * 256
        for letter, byte in letters.items():
            self.first[byte] = self.vocab[letter]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[self.vocab[a] * self.size + self.vocab[b]] = k
            self.merged.append(self.vocab[a + b])
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in {**self.vocab, **added}.items():
            known = all(c in letters for c in token)
            self.bytes[i] = bytes(letters[c] for c in token) if known else token.encode()
        self.added = added
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.path, self.library = path, None
        self.memo: dict[str, bytes] = {}

    # words ------------------------------------------------------------------------------------

    def merge(self, word: bytes) -> tuple[list[int], list[int]]:
        """(ids, boundaries) of a word's parts."""
        ids = [self.first[b] for b in word]
        return self._scan(ids) if len(ids) <= SHORT else self._heap(ids)

    def _scan(self, ids: list[int]) -> tuple[list[int], list[int]]:
        rank, size = self.rank.get, self.size
        cuts = list(range(len(ids) + 1))
        ranks = [rank(a * size + b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            k = ranks.index(low)
            ids[k] = self.merged[low]
            del ids[k + 1], cuts[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank(ids[k - 1] * size + ids[k], NONE)
            if k < len(ranks):
                ranks[k] = rank(ids[k] * size + ids[k + 1], NONE)
        return ids, cuts

    def _heap(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """The same merges for a long word: pairs in a heap, parts in a linked list."""
        rank, size, n = self.rank.get, self.size, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank(ids[k] * size + ids[k + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            low, k = heapq.heappop(heap)
            right = after[k] if ids[k] >= 0 else n
            if right >= n or rank(ids[k] * size + ids[right], NONE) != low:
                continue                                    # one of its parts has been merged since
            ids[k], ids[right] = self.merged[low], -1
            after[k] = beyond = after[right]
            if beyond < n:
                before[beyond] = k
                if (r := rank(ids[k] * size + ids[beyond], NONE)) != NONE:
                    heapq.heappush(heap, (r, k))
            if before[k] >= 0 and (r := rank(ids[before[k]] * size + ids[k], NONE)) != NONE:
                heapq.heappush(heap, (r, before[k]))
        left = [k for k in range(n) if ids[k] >= 0]
        return [ids[k] for k in left], [*left, n]

    def _word(self, word: str) -> bytes:
        got = self.memo.get(word)
        if got is None:
            got = np.array(self.merge(word.encode())[0], "<u4").tobytes()
            if len(word) <= SHORT:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = got
        return got

    # texts ------------------------------------------------------------------------------------

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text without special tokens, a stretch at a time."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > STRETCH and (cut := _SAFE.search(text, at + STRETCH)):
                end = cut.start()
            part = text[at:end]
            if _YOUNG.search(part):
                # the library's own reading of these letters; only the cuts are taken from it
                yield [part[a:b] for _, (a, b) in self._pre().pre_tokenize_str(part)]
            else:
                yield _WORDS.findall(part)
            at = end

    def _pre(self):
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_file(self.path)
        return self.library.pre_tokenizer

    def parts(self, text: str) -> Iterator[str | int]:
        """The text between special tokens, and the ids of these."""
        at = 0
        for hit in self.special.finditer(text) if self.special else ():
            yield text[at:hit.start()]
            yield self.added[hit.group()]
            at = hit.end()
        yield text[at:]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.parts(text):
            if isinstance(part, int):
                out.append(part.to_bytes(4, "little"))
            else:
                out.extend(b"".join(map(self._word, words)) for words in self.words(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD, ids beyond the vocabulary nothing."""
        numbers = np.frombuffer(ids, "<u4")
        numbers = numbers[numbers < self.size]
        out = [b"".join(map(self.bytes.__getitem__, numbers[k:k + STRETCH].tolist())) for k in range(0, len(numbers), STRETCH)]
        return b"".join(out).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of this Python worker for a vocabulary file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _encoder(path: str):
    def work(batches):
        c = codec(path)
        for batch in batches:
            for part in textscan.slices(batch.column(batch.num_columns - 1)):
                rows = [c.encode(part.text(k).decode()) for k in range(part.count)]
                own = [batch.column(k).slice(part.row, part.count) for k in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*own[:-1], pa.array([len(r) // 4 for r in rows], pa.int64()),
                                                  pa.array(rows, pa.binary())], names=[*batch.schema.names[:-1], "__n", "__ids"])
    return work


def _decoder(path: str):
    def work(batches):
        c = codec(path)
        for batch in batches:
            for part in textscan.slices(batch.column(batch.num_columns - 1)):
                rows = [c.decode(part.text(k)) for k in range(part.count)]
                own = [batch.column(k).slice(part.row, part.count) for k in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(rows, pa.string())], names=[*batch.schema.names, "__text"])
    return work


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All columns but the text, with `__n` (tokens) and `__ids` (little-endian unsigned 32-bit ids as bytes).

    Equal to the library's ids for the vocabulary file at `path`, which must be at the
    same place on every executor.  Strings of special tokens in a text become their
    ids.  A null text counts as empty and an empty text has no ids; every row is
    encoded by itself, so repeated rows, null ids and any other columns pass through.
    """
    rows = docs.select(*[c for c in docs.columns if c != text_col], text_col)
    return shared.map_arrow(rows, _encoder(path), _fields(rows.drop(text_col)) + ", __n long, __ids binary")


def decode(rows: DataFrame, path: str, ids_col: str = "__ids") -> DataFrame:
    """All columns with `__text`, the text of the ids; null or empty ids give an empty text."""
    rows = rows.select(*[c for c in rows.columns if c != ids_col], ids_col)
    return shared.map_arrow(rows, _decoder(path), _fields(rows) + ", __text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    out = decode(encode(docs.select(id_col, text_col), path, text_col), path)
    return out.select(id_col, F.col("__n").alias("n_tokens"), F.sha2("__ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("__text").cast("binary"), 256).alias("decoded_sha256"))
