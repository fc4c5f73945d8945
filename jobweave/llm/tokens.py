"""Token ids of texts by a public vocabulary, with a bounded memo of words.

The vocabulary lower-cases, drops white space and cuts texts into letter runs,
single digits, mark runs and the English contractions before it merges, so a
text's ids are those of its pieces in order.  Pieces are found with byte classes;
each distinct piece goes through the tokenizer once while it stays in the memo of
its Python worker.  Texts with other characters than ASCII and Latin letters, or
with the strings of special tokens, go through the tokenizer whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

from jobweave.llm import textscan
from jobweave.llm.textscan import U64

#: Code points U+00A0..U+024F: two bytes in UTF-8, stable under NFC.
_LOW, _HIGH = 0xA0, 0x24F
LETTER, DIGIT, MARK, GAP, ODD = 1, 2, 3, 0, 4
_BYTE = np.full(256, ODD, np.uint8)
_BYTE[33:127] = MARK
_BYTE[[9, 10, 13, 32]] = GAP
_BYTE[48:58] = DIGIT
_BYTE[65:91] = _BYTE[97:123] = LETTER
_TWO = np.full(0x800, ODD, np.uint8)
for _c in range(_LOW, _HIGH + 1):
    _kind = unicodedata.category(chr(_c))
    _TWO[_c] = {"L": LETTER, "N": DIGIT}.get(_kind[0], GAP if _kind == "Zs" else MARK)


class Memo:
    """Piece hash to ids: an open-addressing table of at most `limit` pieces, emptied when full."""

    def __init__(self, limit: int = 1 << 20):
        self.limit = limit
        self.mask = 2 * limit - 1
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(2 * self.limit, U64)        # 0: free
        self.slot = np.zeros(2 * self.limit, np.int32)
        self.first, self.ids, self.n, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32), 0, 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash's entry, -1 if it has none."""
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        at = (h & U64(self.mask)).astype(np.int64)
        while len(todo):
            key = self.keys[at]
            hit = key == h[todo]
            out[todo[hit]] = self.slot[at[hit]]
            on = ~hit & (key != 0)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New distinct hashes with their ids, laid end to end."""
        need = self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(need, np.uint32)])
        self.ids[self.used:need] = ids
        self.first = np.concatenate([self.first, self.used + np.cumsum(counts)])
        number = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        self.used = need
        todo, at = np.arange(len(h)), (h & U64(self.mask)).astype(np.int64)
        while len(todo):
            free = self.keys[at] == 0
            p, k = at[free], todo[free]
            self.keys[p] = h[k]                          # of several for one place the last stays
            own = self.keys[p] == h[k]
            self.slot[p[own]] = number[k[own]]
            on = ~free
            on[free] = ~own
            todo, at = todo[on], at[on]
            at = np.where(self.keys[at] != 0, (at + 1) & self.mask, at)


class Encoder:
    def __init__(self, path: str, limit: int = 1 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Memo(limit)

    def encode(self, s: textscan.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): uint32 ids of all texts of a slice; those of text k are first[k]..first[k + 1]."""
        start, end, first, odd = pieces(s)
        h = textscan.span_hashes(s.prefix(True), start, end)
        h[h == 0] = 1
        found = self.memo.find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            u, where = np.unique(h[new], return_index=True)
            if self.memo.n + len(u) > self.memo.limit:
                self.memo.clear()
                u, new = np.unique(h, return_index=True)
            else:
                new = new[where]
            self._learn(s, u, start[new], end[new])
            found = self.memo.find(h)
        m = self.memo
        n = (m.first[found + 1] - m.first[found]) if len(found) else np.zeros(0, np.int64)
        to = np.concatenate([[0], np.cumsum(n)])
        ids = m.ids[np.repeat(m.first[found] - to[:-1], n) + np.arange(to[-1])] if len(found) else np.zeros(0, np.uint32)
        first = to[first]
        if not len(odd):
            return ids, first
        rest = self.tokenizer.encode_batch([s.text(k).decode() for k in odd], add_special_tokens=False)
        whole = dict(zip(odd.tolist(), rest))
        parts = [np.array(whole[k].ids, np.uint32) if k in whole else ids[first[k]:first[k + 1]] for k in range(s.count)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _learn(self, s: textscan.Slice, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        step = min(self.memo.limit, 1 << 15)
        for k in range(0, len(h), step):
            texts = [s.data[a:b].tobytes().decode() for a, b in zip(start[k:k + step], end[k:k + step])]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts = np.array([len(g) for g in got], np.int64)
            self.memo.add(h[k:k + step], np.array([i for g in got for i in g], np.uint32), counts)


def pieces(s: textscan.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first, odd): byte ranges of the pieces of all texts but the `odd` ones, which have none here."""
    d = s.data
    none = np.zeros(0, np.int64)
    if not len(d):
        return none, none, np.zeros(s.count + 1, np.int64), none
    cls = _BYTE[d]
    lead = np.flatnonzero((d >= 0xC2) & (d <= 0xC9))
    inner = lead + 1
    tail = d[np.minimum(inner, len(d) - 1)]
    kind = _TWO[((d[lead].astype(np.int64) & 31) << 6) | (tail & 63)]
    cls[lead] = kind
    cls[inner[inner < len(d)]] = kind[inner < len(d)]
    special = np.zeros(len(d), bool)
    special[:-1] = (d[:-1] == 60) & (d[1:] == 124)           # "<|" opens a special token's string
    bad = np.concatenate([[0], np.cumsum((cls == ODD) | special)])
    odd = np.flatnonzero(bad[s.offsets[1:]] > bad[s.offsets[:-1]])
    if len(odd):
        out = np.repeat(np.isin(np.arange(s.count), odd), np.diff(s.offsets))
        cls[out] = GAP
    is_inner = np.zeros(len(d), bool)
    is_inner[inner[inner < len(d)]] = True
    fresh = np.zeros(len(d) + 1, bool)                       # a text begins here
    fresh[s.offsets] = True
    turn = np.ones(len(d), bool)
    turn[1:] = (cls[1:] != cls[:-1]) | fresh[1:-1]
    opens = (cls != GAP) & (turn | (cls == DIGIT)) & ~is_inner
    # contractions: an apostrophe alone in its run, then s t m d or re ve ll
    low = d | 32
    at = np.flatnonzero((d == 39) & opens)
    if len(at):
        pad = np.concatenate([low, np.zeros(3, np.uint8)])
        edge = np.concatenate([fresh, np.ones(3, bool)])
        letter = np.concatenate([cls == LETTER, np.zeros(3, bool)])
        one = letter[at + 1] & ~edge[at + 1] & np.isin(pad[at + 1], [ord(c) for c in "stmd"])
        two = letter[at + 1] & letter[at + 2] & ~edge[at + 1] & ~edge[at + 2] & (
            ((pad[at + 1] == 114) & (pad[at + 2] == 101)) | ((pad[at + 1] == 118) & (pad[at + 2] == 101))
            | ((pad[at + 1] == 108) & (pad[at + 2] == 108)))
        for which, size in ((one, 2), (two, 3)):
            begin = at[which]
            opens[begin + 1] = False
            after = begin + size
            after = after[after < len(d)]
            after = after[(cls[after] == LETTER) & ~fresh[after]]
            opens[after] = True
    start = np.flatnonzero(opens)
    stop = np.flatnonzero(turn & (cls == GAP) | fresh[:-1])  # a gap or a text's begin ends a piece
    marks = np.sort(np.concatenate([start, stop, [len(d)]]))
    end = marks[np.searchsorted(marks, start, "right")] if len(start) else none
    return start, end, np.searchsorted(start, s.offsets), odd


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a vocabulary file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def packed(path: str, final: int | None, keep: list[str]):
    """Rows (text, keep...) to (keep..., n, ids): uint32 ids of the whole text, `final` added, as bytes."""
    def work(batches):
        for batch in batches:
            for part in textscan.slices(batch.column(0)):
                ids, first = encoder(path).encode(part)
                end = np.array([] if final is None else [final], np.uint32)
                rows = [np.concatenate([ids[first[k]:first[k + 1]], end]) for k in range(part.count)]
                small = max((int(r.max()) for r in rows if len(r)), default=0) < 1 << 16
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(1 + k).slice(part.row, part.count) for k in range(len(keep))),
                     pa.array([len(r) for r in rows], pa.int64()),
                     pa.array([bytes([2 if small else 4]) + r.astype(np.uint16 if small else np.uint32).tobytes() for r in rows],
                              pa.binary())], names=[*keep, "n", "ids"])
    return work


def unpacked(raw: bytes) -> np.ndarray:
    """The uint32 ids that `packed` wrote; the first byte is the width."""
    return np.frombuffer(raw, np.uint16 if raw[0] == 2 else np.uint32, offset=1).astype(np.uint32)
