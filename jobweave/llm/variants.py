"""Spelling variants: words one insertion, deletion or replacement apart, by bit-sliced position indexes.

The vocabulary is counted over all texts.  Two words one edit apart agree before the
edit and after it, so they agree either in the first half of the shorter word or in
the rest; every word joins the groups of both halves, for its own length and for that
of a word one letter shorter.  A group over `group` words is split by halving once
more the part that may differ, until that part is two letters or the group is small
enough: a pair always meets in one of the two finer groups.

Whole groups are laid end to end into blocks.  A block has a bitset for every
(position, letter) of the words that have it there.  Each word of the block is read
letter by letter against all words at once: the set that agrees so far, and the sets
one replaced, one added or one missing letter away, whose bitsets come from the same,
the next or the previous position.  What is left at the end and has the right length
is near.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm import shared, textscan

U64 = np.uint64
#: Distinct words a task counts before it hands them on.
HELD = 1 << 18


@dataclass(frozen=True)
class Settings:
    """letters: words' code points at least; occurrences: over all texts at least;
    ratio: a form occurs so many times as often as the word at least;
    group: words that meet in one group before it is split; block: words of one index, at least."""
    letters: int = 6
    occurrences: int = 5
    ratio: int = 5
    group: int = 4096
    block: int = 1024


_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LETTERS = {c: c + 32 for c in range(65, 91)}

Rewrite = Callable[[int, str], str]


def _counter(rewrite: Rewrite | None, letters: int):
    def flush(seen: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                          names=["word", "n"])

    def work(batches):
        seen: Counter = Counter()
        for batch in batches:
            ids = batch.column(0)
            for part in textscan.slices(batch.column(1)):
                for k in range(part.count):
                    own = Counter(_RUN.findall(part.text(k).decode().translate(_LETTERS)))
                    if rewrite is not None:
                        i = ids[part.row + k].as_py()
                        if i is not None:
                            changed: Counter = Counter()
                            for w, n in own.items():
                                changed[rewrite(i, w)] += n
                            own = changed
                    for w, n in own.items():
                        if len(w) >= letters:
                            seen[w] += n
                    if len(seen) >= HELD:
                        yield flush(seen)
                        seen.clear()
        yield flush(seen)
    return work


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings(),
               rewrite: Rewrite | None = None) -> DataFrame:
    """(word, n): runs of Latin letters, A-Z lower-cased, that are long and frequent enough.

    `rewrite` changes the runs of a document before they are counted; it is given the
    id and the run and must depend on nothing else.  Runs of rows without an id stay as they are.
    """
    rows = shared.map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")),
                            _counter(rewrite, s.letters), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= s.occurrences)


# groups -----------------------------------------------------------------------------------------

def _halves(rows: DataFrame) -> DataFrame:
    """Split the part [lo, size - tail) of words that may differ: either its second or its first half agrees."""
    wide = F.col("size") - F.col("tail") - F.col("lo")
    mid = F.col("lo") + F.floor(wide / 2).cast("int")
    both = F.array(F.struct(mid.alias("lo"), F.col("tail").alias("tail")),
                   F.struct(F.col("lo").alias("lo"), (F.col("size") - mid).alias("tail")))
    return rows.select("word", "n", "size", F.inline(both))


def _keyed(rows: DataFrame) -> DataFrame:
    whole = F.xxhash64("size", "lo", "tail", F.expr("left(word, lo)"), F.expr("right(word, tail)"))
    return rows.select("word", "n", "size", "lo", "tail", whole.alias("key"))


def grouped(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(key, word, n): every pair of near words of `letters` or more shares a key; keys of one word are left out."""
    size = F.explode(F.array(F.char_length("word"), F.char_length("word") - 1)).alias("size")
    start = words.select("word", "n", size, F.lit(0).alias("lo"), F.lit(0).alias("tail")).where(F.col("size") >= s.letters)
    rows, done = shared.staged(_keyed(_halves(start)), "halves"), []
    while True:
        counts = rows.groupBy("key").agg(F.count("*").alias("c"), F.max(F.col("size") - F.col("tail") - F.col("lo")).alias("wide"))
        met = counts.where(F.col("c") > 1).select("key", ((F.col("c") > s.group) & (F.col("wide") > 2)).alias("hot"))
        cut = met.where("hot").select("key")
        # keys of more than `group` rows are at most rows / group many
        if not cut.limit(1).count():
            done.append(rows.join(met.select("key"), "key", "left_semi"))
            break
        cut = shared.staged(cut, "hot")
        done.append(rows.join(met.where("not hot").select("key"), "key", "left_semi"))
        rows = shared.staged(_keyed(_halves(rows.join(cut, "key", "left_semi"))), "halves")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("key", "word", "n")


# index ------------------------------------------------------------------------------------------

class Index:
    """Bitsets by (position, letter) over a block of words."""

    def __init__(self, words: list[str]):
        self.count = len(words)
        self.size = np.array([len(w) for w in words], np.int64)
        self.long = int(self.size.max(initial=0))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.letters, code = np.unique(flat, return_inverse=True)
        self.chars = np.full((self.count, self.long), -1, np.int64)
        self.chars[np.arange(self.long) < self.size[:, None]] = code
        self.width = -(-self.count // 64)
        #: row p * letters + c: the words with letter c at position p; the last row is empty
        cells = self.long * len(self.letters)
        bits = np.zeros((cells + 1, 64 * self.width), bool)
        w, p = np.nonzero(self.chars >= 0)
        bits[p * len(self.letters) + self.chars[w, p], w] = True
        self.slices = self._pack(bits)
        lengths = np.zeros((self.long + 2, 64 * self.width), bool)
        lengths[self.size, np.arange(self.count)] = True
        self.lengths = self._pack(lengths)

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view(U64)

    def at(self, position: int, letter: np.ndarray) -> np.ndarray:
        """The words that have each query's letter at a position."""
        if not 0 <= position < self.long:
            return self.slices[np.full(len(letter), -1)]
        return self.slices[np.where(letter >= 0, position * len(self.letters) + letter, len(self.slices) - 1)]

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) positions in the block that are exactly one edit apart; all queries read in step."""
        # the longest first, so that those still being read are a prefix
        queries = queries[np.argsort(-self.size[queries], kind="stable")]
        size, chars = self.size[queries], self.chars[queries]
        same = np.full((len(queries), self.width), ~U64(0))
        replaced, added, missing = (np.zeros_like(same) for _ in range(3))
        for j in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -j, "left"))      # queries longer than j
            c = chars[:live, j]
            here, on, back = self.at(j, c), self.at(j + 1, c), self.at(j - 1, c)
            was = same[:live]
            missing[:live] = missing[:live] & back | was        # the query's letter is left out
            added[:live] = (added[:live] | was) & on            # the word's letter at j is left out
            replaced[:live] = replaced[:live] & here | was & ~here
            same[:live] = was & here
        added |= same                                           # a letter after the last
        hit = (replaced & self.lengths[size]) | (added & self.lengths[size + 1]) | (missing & self.lengths[np.maximum(size - 1, 0)])
        q, w = np.nonzero(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little")[:, :self.count])
        return queries[q], w


def _pairs(words: list[str], n: list[int], step: int) -> Iterator[pa.RecordBatch]:
    """Near pairs among the words of whole groups, each met once."""
    count = dict(zip(words, n))
    own = sorted(count, key=lambda w: (len(w), w))
    for base in range(0, len(own), 4 * step):
        # words of a very large group that could not be split meet block by block, lengths that fit only
        index = Index(own[base:base + 4 * step])
        low, high = int(index.size.min()) - 1, int(index.size.max()) + 1
        for k in range(0, len(own), step):
            asked = own[k:k + step]
            if base <= k < base + 4 * step:
                q, w = index.near(np.arange(k - base, min(k - base + step, index.count)))
                left, right = [own[base + x] for x in q.tolist()], [own[base + x] for x in w.tolist()]
            elif len(asked[-1]) < low or len(asked[0]) > high:
                continue
            else:
                left, right = _foreign(index, own[base:base + 4 * step], asked)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()),
                                              pa.array([count[x] for x in left], pa.int64()),
                                              pa.array([count[x] for x in right], pa.int64())], names=["word", "near", "n", "near_n"])


def _foreign(index: Index, block: list[str], asked: list[str]) -> tuple[list[str], list[str]]:
    both = Index(block + asked)
    q, w = both.near(np.arange(len(block), both.count))
    keep = w < len(block)
    return [asked[x - len(block)] for x in q[keep].tolist()], [block[x] for x in w[keep].tolist()]


def _finder(block: int):
    """Rows (key, word, n) sorted by key to (word, near, n, near_n)."""
    def work(batches):
        words, n, last = [], [], None
        for batch in batches:
            for key, w, k in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if key != last and len(words) >= block:
                    yield from _pairs(words, n, block)
                    words, n = [], []
                last = key
                words.append(w)
                n.append(k)
        if words:
            yield from _pairs(words, n, block)
    return work


def near_pairs(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(word, near, n, near_n) of all ordered pairs one edit apart, each once."""
    rows = grouped(words, s).repartition("key").sortWithinPartitions("key")
    found = shared.map_arrow(rows, _finder(s.block), "word string, near string, n long, near_n long")
    return found.dropDuplicates(["word", "near"])


# forms ------------------------------------------------------------------------------------------

def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word of each chain of forms (word, form), by doubling the steps."""
    at = shared.staged(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while at.where("moved").limit(1).count():
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = shared.staged(at.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return at.select("word", "root")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings(),
          rewrite: Rewrite | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    n: occurrences; n_near: words one edit away; form: the near word of largest n
    (ties: the smallest in code-point order) if it occurs `ratio` times as often, else
    null; root: the end of the chain of forms, the word itself without one.  Null and
    empty texts have no words; repeated rows count each time; other columns are not read.
    Counts rise along a chain, so it has no cycle.
    """
    words = shared.staged(vocabulary(docs, id_col, text_col, s, rewrite), "vocabulary")
    found = near_pairs(words, s).groupBy("word").agg(
        F.count("*").alias("n_near"), F.max("n").alias("own"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    best_n = -F.col("best.col1")
    fits = best_n >= s.ratio * F.col("own")
    found = shared.staged(found.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"),
                                       F.when(fits, best_n).alias("form_n")), "near")
    roots = _roots(found.where(F.col("form").isNotNull()))
    out = words.join(found, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                      F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def planted(modulus: int = 199) -> Rewrite:
    """Deletes a letter of a run where `modulus` divides the crc32 of "id:run": misspellings to be found again."""
    def rewrite(i: int, word: str) -> str:
        h = zlib.crc32(f"{i}:{word}".encode())
        if h % modulus:
            return word
        k = h % len(word)
        return word[:k] + word[k + 1:]
    return rewrite
