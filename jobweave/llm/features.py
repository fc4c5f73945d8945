"""Numeric features of texts for the classifiers, a slice of texts at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from jobweave.llm import textscan
from jobweave.llm.textscan import U64, mix

#: Byte classes: white space, line feed, lower, upper, digit, then marks one by one, other marks, bytes of other characters.
_MARKS = ".,!?;:|<>{}[]()@#/\\_-=+*\"'$%&"
_CLASSES = 6 + len(_MARKS) + 1
_CLASS = np.full(256, 5, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
for _k, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 6 + _k
_CLASS[128:] = _CLASSES - 1


@dataclass(frozen=True)
class Passages:
    """Passages of `words` words; `buckets` hashed word frequencies each."""
    words: int = 64
    buckets: int = 64

    @property
    def width(self) -> int:
        return _CLASSES + 8 + self.buckets

    def of(self, s: textscan.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(features, first): float32 rows of all passages; those of text k are first[k]..first[k + 1].

        Every text has one passage at least; that of a text without words is all zero.
        """
        w = textscan.words(s)
        counts = np.diff(w.first)
        per = np.maximum(1, -(-counts // self.words))
        first = np.concatenate([[0], np.cumsum(per)])
        total = int(first[-1])
        out = np.zeros((total, self.width), np.float32)
        if not len(w.hash):
            return out, first
        doc = w.owner()
        place = np.arange(len(w.hash)) - w.first[doc]
        at = first[doc] + place // self.words
        n = np.bincount(at, minlength=total).astype(float)
        some = np.maximum(n, 1)
        # bytes from a passage's first word to the next passage's, or to the end of the text
        begin = np.full(total + 1, -1, np.int64)
        opens = np.flatnonzero(place % self.words == 0)
        begin[at[opens]] = w.start[opens]
        begin[first[:-1]] = s.offsets[:-1]
        begin[-1] = len(s.data)
        byte_at = np.repeat(np.arange(total), np.diff(begin))
        cls = np.bincount(byte_at * _CLASSES + _CLASS[s.data], minlength=total * _CLASSES).reshape(total, -1)
        size = np.maximum(1, cls.sum(axis=1))
        out[:, :_CLASSES] = np.sqrt(cls / size[:, None])
        length = (w.end - w.start).astype(float)
        mean = np.bincount(at, length, total) / some
        k = _CLASSES
        out[:, k] = mean / 10
        out[:, k + 1] = np.sqrt(np.maximum(0, np.bincount(at, length ** 2, total) / some - mean ** 2)) / 10
        out[:, k + 2] = np.bincount(at, length > 20, total) / some
        key = mix(w.hash ^ mix(at.astype(U64)))
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        out[:, k + 3] = np.bincount(at[order][fresh], minlength=total) / some          # distinct words here
        key = mix(w.hash ^ mix(doc.astype(U64)))
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        out[:, k + 4] = np.bincount(at[order][fresh], minlength=total) / some          # words new to the text
        out[:, k + 5] = np.log1p(n) / 5
        out[:, k + 6] = np.repeat(np.log1p(counts), per) / 10
        same = np.zeros(len(w.hash))
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
        out[:, k + 7] = np.bincount(at, same, total) / some
        bucket = (w.hash % U64(self.buckets)).astype(np.int64)
        hashed = np.bincount(at * self.buckets + bucket, minlength=total * self.buckets).reshape(total, -1)
        out[:, k + 8:] = np.sqrt(hashed / some[:, None])
        out[n == 0] = 0
        return out, first


def word_sets(s: textscan.Slice) -> list[np.ndarray]:
    """Sorted hashes of what each text's words show, punctuation left out.

    A feature is a word, or a longer word's first 4 or 6 bytes, with how often the
    text has it: once or more, twice or more, four times or more.
    """
    w = textscan.words(s, gap=textscan.NOT_ALNUM)
    prefix = s.prefix(True)
    kinds = [(w.hash, np.ones(len(w.hash), bool))]
    for size in (4, 6):
        long = w.end - w.start > size
        h = textscan.span_hashes(prefix, w.start, np.minimum(w.end, w.start + size))
        kinds.append((mix(h + U64(size)), long))
    out = []
    for k in range(s.count):
        of = slice(w.first[k], w.first[k + 1])
        u, n = np.unique(np.concatenate([h[of][keep[of]] for h, keep in kinds]), return_counts=True)
        out.append(np.sort(np.concatenate([u, mix(u[n >= 2] ^ U64(0x2222)), mix(u[n >= 4] ^ U64(0x4444))])))
    return out


def packed_passages(p: Passages):
    """(id, text) to (id, passages): float32 rows of the whole text, packed."""
    def work(batches):
        for batch in batches:
            for part in textscan.slices(batch.column(1)):
                x, first = p.of(part)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.row, part.count),
                    pa.array([x[first[k]:first[k + 1]].tobytes() for k in range(part.count)], pa.binary())],
                    names=["id", "passages"])
    return work


def packed_words(batches):
    """(id, text) to (id, words): hashes of the text's distinct words, packed."""
    for batch in batches:
        for part in textscan.slices(batch.column(1)):
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(part.row, part.count),
                pa.array([x.tobytes() for x in word_sets(part)], pa.binary())], names=["id", "words"])
