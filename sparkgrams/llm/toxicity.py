"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and
skip-grams.

A text's features are its distinct hashed words, pairs of neighbouring words and
pairs with one word between. Training goes through the sample's texts one by one,
with a learning rate for each weight and an L1 penalty that leaves most weights at
exactly zero: the model is a short list of (feature, weight) pairs whose size the
sample bounds, small enough to go to every task.

Words are compared in lower case (A-Z); a word is a run of letters a-z, digits
and non-ASCII characters.

Defined results: a null or empty text, or one without words, gets the score of
the intercept alone; repeated rows are scored each; of rows that repeat a labelled
id the first text and the largest label count; an empty table gives an empty
result, and without labels of both kinds all scores are the share of toxic labels
(0.5 without any label); rows with null labels are not learned from; texts of any
length are scored whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .licenses import SCAN
from .runtime import as_bytes, pick, session_of, slices
from .words import hashes

#: Labelled texts that a model learns from, at most, and their bytes.
TRAIN_ROWS = 8_000
TRAIN_BYTES = 64 << 20
BITS = 22


@dataclass
class FtrlModel:
    """Weights, by hashed feature, that differ from zero."""

    bits: int = BITS
    bias: float = 0.0
    features: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.float64))
    scale: float = 1.0
    shift: float = 0.0
    _dense: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None}

    def logits(self, texts: list[bytes]) -> np.ndarray:
        if self._dense is None:  # once for each worker
            self._dense = np.zeros(1 << self.bits, dtype=np.float32)
            self._dense[self.features] = self.weights
        return np.array([self.bias + _once(hashed(t, self.bits), self._dense) for t in texts])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(texts) + self.shift, -35, 35)))


def hashed(text: bytes, bits: int) -> np.ndarray:
    """Hashed words, neighbouring pairs and pairs with a gap of one; repeats
    included."""
    h = hashes(text.translate(SCAN).split())
    near = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    skip = h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[2:] ^ np.uint64(0x165667B19E3779F9))
    keys = np.concatenate([h, near, skip])
    keys ^= keys >> np.uint64(31)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _once(keys: np.ndarray, dense: np.ndarray) -> float:
    """Sum of the weights of a text's features, each counted once."""
    met = dense[keys] != 0
    return float(dense[np.unique(keys[met])].sum())


def train_ftrl(
    texts: list[bytes],
    labels: list[int],
    *,
    bits: int = BITS,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float | None = None,
    l2: float = 1.0,
    epochs: int = 2,
    decision: float | None = None,
) -> FtrlModel:
    """Learn from texts and 0/1 labels; a fifth of them is held back to
    calibrate the scores. With ``decision``, the curve is moved so that scores
    from there on are the best cut (by F1) of the texts held back."""
    y = np.asarray(labels, dtype=np.float64)
    rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    if not 0 < y.sum() < len(y):
        return FtrlModel(bits, bias=math.log(rate / (1 - rate)))
    if l1 is None:  # few texts can't pull a weight past a strong penalty
        l1 = min(6.0, 0.04 * y.sum())
    features = [np.unique(hashed(t, bits)) for t in texts]
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias, bias_n = 0.0, 0.0
    rng = np.random.default_rng(7)
    order = rng.permutation(len(y))
    order = order[np.argsort(-y[order], kind="stable")]  # both kinds in both parts
    held, learn = order[::5], rng.permutation(np.delete(order, np.s_[::5]))

    def weights(keys: np.ndarray) -> np.ndarray:
        zk = z[keys]
        w = -(zk - np.sign(zk) * l1) / ((beta + np.sqrt(n[keys])) / alpha + l2)
        return np.where(np.abs(zk) <= l1, 0.0, w)

    for _ in range(epochs):
        for row in learn:
            keys = features[row]
            w = weights(keys)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + w.sum()))))
            g = p - y[row]
            step = (np.sqrt(n[keys] + g * g) - np.sqrt(n[keys])) / alpha
            z[keys] += g - step * w
            n[keys] += g * g
            bias_n += g * g
            bias -= alpha * g / (beta + math.sqrt(bias_n))
    every = np.flatnonzero(np.abs(z) > l1)
    model = FtrlModel(bits, bias, every, weights(every))
    model.scale, model.shift = calibrate(model.logits([texts[i] for i in held]), y[held], decision)
    return model


def calibrate(x: np.ndarray, y: np.ndarray, decision: float | None) -> tuple[float, float]:
    """Scale and shift of the logistic curve for held-out outputs; with
    ``decision``, moved so that the cut of best F1, among those of a precision
    of 0.8 or more, has that score."""
    scale, shift = platt(x, y)
    if decision is None or not 0 < y.sum() < len(y):
        return scale, shift
    order = np.argsort(-x, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.append(np.diff(x[order]) != 0, True)  # equal outputs aren't cut apart
    sure = hits / np.arange(1, len(y) + 1) >= 0.8
    if not (ends & sure).any():
        return scale, shift
    best = int(np.argmax(np.where(ends & sure, f1, -1)))
    after = x[order[best + 1]] if best + 1 < len(y) else x[order[best]] - 1 / scale
    cut = (x[order[best]] + after) / 2
    return scale, float(math.log(decision / (1 - decision)) - scale * cut)


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through held-out outputs (Newton's
    steps on smoothed targets); (1, 0) where there is nothing to fit."""
    if not 0 < y.sum() < len(y) or np.ptp(x) == 0:
        return 1.0, 0.0
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mid, spread = x.mean(), x.std()
    u = (x - mid) / spread
    a, b = 1.0, math.log((pos + 1) / (neg + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -35, 35)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * u).sum() + 1e-3 * a, (p - t).sum()])
        h = np.array([[(w * u * u).sum() + 1e-3, (w * u).sum()], [(w * u).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    if a <= 0:
        return 1.0, 0.0
    return float(a / spread), float(b - a * mid / spread)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, id_col: str, text_col: str) -> tuple[list[bytes], list[int]]:
    """At most ``rows`` labelled texts of at most ``TRAIN_BYTES`` in all, the
    first by a hash of their ids. The ids chosen are bounded, so they may be
    broadcast."""
    marked = pick(labels, id_col, label).filter(learn & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    by_hash = [F.xxhash64(id_col), F.col(id_col)]
    chosen = marked.groupBy(id_col).agg(F.max(label).cast("int").alias("y")).orderBy(*by_hash).limit(rows)
    found = pick(docs, id_col, text_col).join(F.broadcast(chosen), id_col)
    found = found.groupBy(id_col).agg(F.min(F.coalesce(text_col, F.lit(""))).alias("t"), F.max("y").alias("y"))
    size = F.sum(F.octet_length("t")).over(Window.orderBy(*by_hash))
    table = found.withColumn("size", size).filter(F.col("size") <= TRAIN_BYTES).select(id_col, "t", "y").toArrow().sort_by(id_col)
    return [t.encode() for t in table.column("t").to_pylist()], table.column("y").to_pylist()


def score_texts(docs: DataFrame, scorer, *, id_col: str, text_col: str) -> DataFrame:
    """``id_col, score``: the scorer's ``scores`` of every whole text."""
    session_of(docs)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            scores = shared.value.scores(as_bytes(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(scores, pa.float64())], [id_col, "score"])

    return pick(docs, id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, score double")


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, rows: int = TRAIN_ROWS, decision: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FtrlModel:
    """A model from at most ``rows`` labelled texts, of those whose ids meet
    ``learn``."""
    texts, marks = training_rows(docs, labels, label_col, F.lit(True) if learn is None else learn, rows, id_col, text_col)
    return train_ftrl(texts, marks, decision=decision)


def score_toxicity(docs: DataFrame, model: FtrlModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score``, 0 to 1, higher for likelier toxic."""
    return score_texts(docs, model, id_col=id_col, text_col=text_col)
