"""Toxic documents by non-negative positive-unlabelled learning.

A linear classifier on the words and word beginnings of a text learns from confirmed toxic
documents and unlabelled ones.  With class prior p, the risk is
p * R+(positive) + max(0, R-(unlabelled) - p * R-(positive)): what the unlabelled
texts cost as negatives, less the part that toxic ones among them cause, and never
below zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm import shared, textscan
from jobweave.llm.features import packed_words, word_sets
from jobweave.llm.textscan import U64


@dataclass(frozen=True)
class Settings:
    """positives, unlabelled: documents used for training at most; words: vocabulary of the model."""
    positives: int = 2000
    unlabelled: int = 6000
    words: int = 400
    least: float = 5.0         # standard errors by which a word must prefer positive texts, or the contrary
    steps: int = 1000
    rate: float = 0.1
    decay: float = 1e-3
    threshold: float = 0.7


class Model:
    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, bias: float):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias

    def logits(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(sets), self.bias)
        for k, x in enumerate(sets):
            at = np.searchsorted(self.vocabulary, x)
            at[at == len(self.vocabulary)] = 0
            if len(self.vocabulary):
                out[k] += self.weights[at[self.vocabulary[at] == x]].sum()
        return out

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(sets), -40, 40)))


def _vocabulary(positive: list[np.ndarray], unlabelled: list[np.ndarray], s: Settings) -> np.ndarray:
    """The words whose share of positive texts differs most, in standard errors, from that of unlabelled texts."""
    p, pn = np.unique(np.concatenate(positive), return_counts=True)
    u, un = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.minimum(np.searchsorted(u, p), len(u) - 1)
    n = np.where(u[at] == p, un[at], 0) if len(u) else np.zeros(len(p))
    a, b = len(positive), len(unlabelled)
    share = (pn + n + 1) / (a + b + 2)
    z = (pn / a - n / b) / np.sqrt(share * (1 - share) * (1 / a + 1 / b))
    keep = np.flatnonzero((np.abs(z) >= s.least) & (pn + n >= 3))
    keep = keep[np.argsort(-np.abs(z[keep]), kind="stable")[:s.words]]
    return np.sort(p[keep])


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, s: Settings) -> Model:
    """Adam on the non-negative risk with the logistic loss; on a negative part the step goes back against it."""
    if not positive or not unlabelled:
        return Model(np.zeros(0, U64), np.zeros(0), float(np.log(prior / (1 - prior))))
    v = _vocabulary(positive, unlabelled, s)
    rows = [*positive, *unlabelled]
    found = [np.flatnonzero(np.isin(v, x, assume_unique=True)) for x in rows]
    row, col = np.repeat(np.arange(len(rows)), [len(x) for x in found]), np.concatenate(found).astype(np.int64)
    is_p = np.arange(len(rows)) < len(positive)
    w, m, q = np.zeros(len(v) + 1), np.zeros(len(v) + 1), np.zeros(len(v) + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, s.steps + 1):
        f = np.bincount(row, w[col], len(rows)) + w[-1]
        sig = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
        as_negative = np.logaddexp(0, f)                         # loss of calling a text toxic when it is not
        rest = as_negative[~is_p].mean() - prior * as_negative[is_p].mean()
        plus = np.where(is_p, prior * (sig - 1) / len(positive), 0)
        minus = np.where(is_p, -prior * sig / len(positive), sig / len(unlabelled))
        g = plus + minus if rest >= 0 else -minus
        grad = np.append(np.bincount(col, g[row], len(v)), g.sum())
        grad[:-1] += s.decay * w[:-1] / 10
        m, q = 0.9 * m + 0.1 * grad, 0.999 * q + 0.001 * grad ** 2
        w -= s.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(q / (1 - 0.999 ** step)) + 1e-8)
    return Model(v, w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", prior: float | None = None) -> Model:
    """A model from `labels` (id_col, label_col) and the texts of docs.

    Positives are documents labelled 1; the unlabelled side is drawn from all
    documents, whatever their label.  The class prior is the labels' share of 1
    unless given.  Samples are drawn by a hash of the id.  Without a positive, every
    score is the smoothed prior.
    """
    y = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    y = y.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    if prior is None:
        n, ones = y.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
        prior = (ones + 1) / (n + 2)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    by_hash = (F.xxhash64("id"), "id")
    toxic = y.where("y = 1").select("id").orderBy(*by_hash).limit(s.positives)
    others = texts.select("id").orderBy(*by_hash).limit(s.unlabelled).distinct()
    draw = toxic.withColumn("side", F.lit(1)).union(others.withColumn("side", F.lit(0)))
    draw = draw.groupBy("id").agg(F.max("side").alias("positive"), (F.min("side") == 0).alias("open"))
    rows = shared.map_arrow(texts.join(F.broadcast(draw.select("id")), "id"), packed_words, "id long, words binary")
    rows = rows.join(F.broadcast(draw), "id")
    rows = sorted((r.id, r.words, r.positive, r.open) for r in rows.toLocalIterator())
    sets = [np.frombuffer(r[1], U64) for r in rows]
    return train([x for x, r in zip(sets, rows) if r[2]], [x for x, r in zip(sets, rows) if r[3]], prior, s)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, from its whole text; a null or empty text has the score of no words."""
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            for part in textscan.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.row, part.count),
                                                  pa.array(shared_model.value.scores(word_sets(part)), pa.float64())],
                                                 names=["id", "score"])
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return shared.map_arrow(rows, work, f"id {kind}, score double").withColumnRenamed("id", id_col)


def reject(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs without rows scored `threshold` or more; columns and other rows stay as they are."""
    shared_model = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            keep = [shared_model.value.scores(word_sets(part)) < threshold for part in textscan.slices(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))
    return shared.map_arrow(docs, work, docs.schema)
