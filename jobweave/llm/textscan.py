"""Words, lines and shingles of Arrow text columns as numpy arrays, a slice of texts at a time.

Every hash is a 64-bit polynomial over bytes, read off one prefix sum per slice,
so the work is a few vector operations per byte and memory follows the slice
(half a megabyte of text, or one text where that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=U64)
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]          # A-Z hash as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space and punctuation: what is left are ASCII letters and digits and all bytes of other characters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
_powers = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of each."""
    if len(_powers[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(size, base, U64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


@dataclass
class Slice:
    """Texts row..row + count of a batch: their bytes and where each begins."""
    row: int
    count: int
    data: np.ndarray          # uint8
    offsets: np.ndarray       # int64, count + 1

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k]:self.offsets[k + 1]].tobytes()

    def prefix(self, folded: bool, keep: np.ndarray | None = None) -> np.ndarray:
        powers, _ = _grown(len(self.data))
        terms = (_FOLDED if folded else _TABLE)[self.data]
        terms *= powers[:len(terms)]
        if keep is not None:
            terms[~keep] = 0
        out = np.zeros(len(terms) + 1, U64)
        np.cumsum(terms, out=out[1:])
        return out


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield Slice(a, b - a, data[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
        a = b


@dataclass
class Spans:
    """Units of a slice in order; those of text k are first[k]..first[k + 1]."""
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _grown(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start])


def words(s: Slice, folded: bool = True, gap: np.ndarray = _SPACE) -> Spans:
    """Runs of bytes outside `gap` (ASCII white space); `folded` hashes A-Z as a-z."""
    if not len(s.data):
        none = np.zeros(0, np.int64)
        return Spans(none, none, np.zeros(s.count + 1, np.int64), np.zeros(0, U64))
    space = gap[s.data]
    cut = np.zeros(len(space) + 1, bool)      # a text begins here
    cut[s.offsets] = True
    opens = ~space
    opens[1:] &= space[:-1] | cut[1:-1]
    closes = ~space
    closes[:-1] &= space[1:] | cut[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Spans(start, end, np.searchsorted(start, s.offsets), span_hashes(s.prefix(folded), start, end))


def units(s: Slice, sentences: bool = False) -> Spans:
    """Cut every text into lines, or into sentences too; the units of a text join to the whole text.

    A line ends with its line feed; a sentence ends with a full stop, exclamation
    or question mark before a blank or tab.  The hash folds A-Z and leaves white
    space out, so units that differ only in these are equal; a unit of white space
    alone hashes to 0.
    """
    d = s.data
    mark = np.zeros(len(d) + 1, bool)
    mark[1:] = d == 10
    if sentences and len(d):
        mark[1:-1] |= ((d[:-1] == 46) | (d[:-1] == 33) | (d[:-1] == 63)) & ((d[1:] == 32) | (d[1:] == 9))
    mark[s.offsets] = True
    start = np.flatnonzero(mark[:-1])
    end = np.append(start[1:], len(d))
    solid = ~_SPACE[d]
    filled = np.zeros(len(d) + 1, np.int64)
    np.cumsum(solid, out=filled[1:])
    powers, inverse = _grown(len(d) + 1)
    terms = _FOLDED[d]
    terms *= powers[filled[:-1]]              # positions count solid bytes only
    terms[~solid] = 0
    prefix = np.zeros(len(d) + 1, U64)
    np.cumsum(terms, out=prefix[1:])
    h = mix((prefix[end] - prefix[start]) * inverse[filled[start]])
    h[filled[end] == filled[start]] = 0
    return Spans(start, end, np.searchsorted(start, s.offsets), h)


def unit_words(s: Slice, u: Spans) -> np.ndarray:
    """Words that begin in each unit."""
    w = words(s)
    return np.searchsorted(w.start, u.end) - np.searchsorted(w.start, u.start)


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n neighbours of h (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    x = h[:m].copy()
    for k in range(1, n):
        x *= U64(0x100000001B3)
        x += h[k:k + m]
        x ^= x >> U64(29)
    return mix(x)


def shingle_sets(s: Slice, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's n-word runs; a shorter text is one run, none if it has no word."""
    w = words(s)
    runs = combine(w.hash, n)
    for k in range(s.count):
        a, b = int(w.first[k]), int(w.first[k + 1])
        if b - a >= n:
            yield np.unique(runs[a:b - n + 1])
        elif b > a:
            yield combine(w.hash[a:b], b - a) ^ U64(b - a)
        else:
            yield np.zeros(0, U64)
