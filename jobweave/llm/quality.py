"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded, a gated attention unit
weighs it, and the weighted mean of the codes is scored; encoder, attention and
scorer are learned together from document labels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm import shared, textscan
from jobweave.llm.features import Passages, packed_passages


@dataclass(frozen=True)
class Settings:
    """sample: labelled documents used for training at most (the others are only scored)."""
    passages: Passages = field(default_factory=Passages)
    sample: int = 6000
    code: int = 24
    gate: int = 12
    epochs: int = 60
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Gated-attention scorer of bags; `constant` replaces it where labels have one class only."""

    def __init__(self, s: Settings, width: int):
        r = np.random.default_rng(s.seed)
        draw = lambda *n: r.normal(0, 1 / np.sqrt(n[0]), n)
        self.p = {"W": draw(width, s.code), "b": np.zeros(s.code), "V": draw(s.code, s.gate), "U": draw(s.code, s.gate),
                  "a": draw(s.gate), "c": draw(s.code), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.constant: float | None = None

    def forward(self, x, first):
        """Score logits of bags and what the gradient needs."""
        p = self.p
        z = ((x - self.mean) / self.scale).clip(-8, 8)
        h = np.tanh(z @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["a"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        weight = e / np.add.reduceat(e, first[:-1])[bag]
        code = np.add.reduceat(weight[:, None] * h, first[:-1], axis=0)
        return code @ p["c"] + p["d"][0], (z, h, t, g, weight, code, bag)

    def gradient(self, first, kept, miss):
        """miss: derivative of the loss by each bag's logit."""
        p = self.p
        z, h, t, g, weight, code, bag = kept
        d_code = miss[:, None] * p["c"]
        d_h = weight[:, None] * d_code[bag]
        d_w = (h * d_code[bag]).sum(axis=1)
        d_e = weight * (d_w - np.add.reduceat(weight * d_w, first[:-1])[bag])
        d_t = d_e[:, None] * p["a"] * g * (1 - t * t)
        d_g = d_e[:, None] * p["a"] * t * g * (1 - g)
        d_h += d_t @ p["V"].T + d_g @ p["U"].T
        d_z = d_h * (1 - h * h)
        return {"W": z.T @ d_z, "b": d_z.sum(axis=0), "V": h.T @ d_t, "U": h.T @ d_g, "a": (t * g).T @ d_e,
                "c": code.T @ miss, "d": np.array([miss.sum()])}

    def scores(self, x, first) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return _sigmoid(self.forward(x, first)[0])


def train(bags: list[np.ndarray], labels: np.ndarray, s: Settings) -> Model:
    """Adam on the log loss, both classes weighing alike."""
    m = Model(s, s.passages.width)
    if len(bags) == 0 or labels.min() == labels.max():
        m.constant = (float(labels.sum()) + 1) / (len(bags) + 2)
        return m
    every = np.concatenate(bags)
    m.mean, m.scale = every.mean(axis=0), every.std(axis=0) + 0.02
    share = labels.mean()
    cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    r = np.random.default_rng(s.seed)
    mean = {k: np.zeros_like(v) for k, v in m.p.items()}
    square = {k: np.zeros_like(v) for k, v in m.p.items()}
    step = 0
    epochs = max(s.epochs, -(-2000 * s.batch // max(1, len(bags)))) if len(bags) < 2000 else s.epochs
    for _ in range(epochs):
        order = r.permutation(len(bags))
        for k in range(0, len(order), s.batch):
            of = order[k:k + s.batch]
            x = np.concatenate([bags[i] for i in of])
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in of])])
            logit, kept = m.forward(x, first)
            miss = cost[of] * (_sigmoid(logit) - labels[of]) / len(of)
            step += 1
            for name, grad in m.gradient(first, kept, miss).items():
                grad = grad + s.decay * m.p[name]
                mean[name] = 0.9 * mean[name] + 0.1 * grad
                square[name] = 0.999 * square[name] + 0.001 * grad ** 2
                hat = mean[name] / (1 - 0.9 ** step)
                m.p[name] -= s.rate * hat / (np.sqrt(square[name] / (1 - 0.999 ** step)) + 1e-8)
    return m


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model:
    """A model from labelled documents: `labels` has id_col and label_col (0 or 1; null rows are left out).

    At most `s.sample` labels, drawn by a hash of the id, are used; a repeated id
    counts once, by its largest label.  Without labels of both classes every score
    is the smoothed share of label 1.
    """
    y = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    y = y.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("id"), "id").limit(s.sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(y.select("id")), "id")
    rows = shared.map_arrow(texts, packed_passages(s.passages), "id long, passages binary").join(F.broadcast(y), "id")
    rows = sorted((r.id, r.passages, r.y) for r in rows.toLocalIterator())
    bags = [np.frombuffer(b, np.float32).reshape(-1, s.passages.width) for _, b, _ in rows]
    return train(bags, np.array([r[2] for r in rows], float), s)


def scorer(model, s: Settings):
    def work(batches):
        for batch in batches:
            for part in textscan.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.row, part.count),
                    pa.array(model.value.scores(*s.passages.of(part)), pa.float64())], names=["id", "score"])
    return work


def score(docs: DataFrame, model: Model, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, from its whole text; null and empty texts are one passage of zeros."""
    shared_model = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return shared.map_arrow(rows, scorer(shared_model, s), f"id {kind}, score double").withColumnRenamed("id", id_col)
