"""A quality classifier from positive and unlabelled documents.

Trusted positives and unlabelled web text train a small network on counts of a text's
characters, words and lines. The loss is the non-negative unbiased risk: with the class
prior p, p times the risk of calling positives negative is taken off the risk of calling
unlabelled text negative, and what remains is not allowed to fall below zero. The prior is
estimated by the best bin: a first classifier of positives against unlabelled text ranks
both, and the smallest ratio of their shares above a threshold, with an allowance for the
sample size, bounds the share of positives.

Fitting takes bounded samples (at most MOST_POSITIVE and MOST_UNLABELLED rows of FEATURES
numbers reach the driver); scoring runs over all texts in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import byte_pieces, other_columns, small_batches
from helixframe.llm.wordhash import hashed_words

MOST_POSITIVE, MOST_UNLABELLED = 8_000, 16_000
HIDDEN, STEPS, RATE, DECAY = 8, 300, 0.02, 1e-2
#: Classes of bytes that are counted.
BYTE_CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>", "stop": b".?", "pause": b",;:", "shout": b"!", "bracket": b"()[]{}\"'_=+/\\~^@`", "line": b"\n", "space": b" \t"}
_CLASS = np.full(256, len(BYTE_CLASSES), np.uint8)
for _k, _members in enumerate(BYTE_CLASSES.values()):
    _CLASS[list(_members)] = _k
FEATURES = len(BYTE_CLASSES) + 8


def features(column: pa.Array) -> np.ndarray:
    """[rows, FEATURES] of a text column; an empty text has zeros."""
    made = []
    for _, data, offsets in byte_pieces(column):
        kinds = _CLASS[data]
        counts = np.stack([np.diff(np.concatenate([[0], np.cumsum(kinds == k)])[offsets]) for k in range(len(BYTE_CLASSES) + 1)], 1).astype(float)
        words, bounds = hashed_words(data, offsets)
        breaks = [b.tolist() for b in (bounds, offsets)]
        for row, (lo, hi, at, end) in enumerate(zip(breaks[0][:-1], breaks[0][1:], breaks[1][:-1], breaks[1][1:], strict=True)):
            n = hi - lo
            own = words[lo:hi]
            chars = counts[row].sum() - counts[row, -1] * 0.5
            distinct = len(np.unique(own)) / n if n else 0.0
            pairs = (own[:-1] * np.uint64(31)) ^ own[1:] if n > 1 else own[:0]
            fresh = len(np.unique(pairs)) / len(pairs) if len(pairs) else 0.0
            lines = data[at:end].tobytes().split(b"\n")
            copied = 1 - len(set(lines)) / len(lines)
            per_word = counts[row] / max(1, n)
            letters = counts[row, 0] + counts[row, 1] + counts[row, -1] * 0.5
            made.append([*np.log1p(8 * per_word), np.log1p(n), np.log1p(chars / max(1, n)), distinct, fresh, copied, counts[row, 1] / max(1.0, letters), letters / max(1.0, chars)])
    return np.array(made, float).reshape(-1, FEATURES)


@dataclass
class Model:
    """A network with one hidden layer over standardised features; prior is the class prior it was fitted with."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[0] + self.weights[1])
        return hidden @ self.weights[2] + self.weights[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _trained(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 7) -> Model:
    """Full-batch Adam on the non-negative risk, or, where prior is None, on positives against unlabelled text."""
    random = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), np.where(unlabelled.std(0) > 1e-9, unlabelled.std(0), 1.0)
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    weights = [random.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), random.normal(0, 0.1, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def gradient(x: np.ndarray, slope) -> list[np.ndarray]:
        hidden = np.tanh(x @ weights[0] + weights[1])
        z = hidden @ weights[2] + weights[3][0]
        back = slope(z) / max(1, len(x))
        inner = np.outer(back, weights[2]) * (1 - hidden**2)
        return [x.T @ inner, inner.sum(0), hidden.T @ back, np.array([back.sum()])]

    for step in range(1, STEPS + 1):
        if prior is None:
            parts = [(p, lambda z: -_sigmoid(-z), 0.5), (u, _sigmoid, 0.5)]
        else:
            zp, zu = (np.tanh(x @ weights[0] + weights[1]) @ weights[2] + weights[3][0] for x in (p, u))
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negative >= 0:
                parts = [(p, lambda z: -prior * _sigmoid(-z) - prior * _sigmoid(z), 1.0), (u, _sigmoid, 1.0)]
            else:  # step back from the over-fitted part
                parts = [(u, _sigmoid, -1.0), (p, lambda z: -prior * _sigmoid(z), -1.0)]
        grads = [np.zeros_like(w) for w in weights]
        for x, slope, share in parts:
            for g, own in zip(grads, gradient(x, slope), strict=True):
                g += share * own
        for k, (w, g) in enumerate(zip(weights, grads, strict=True)):
            g = g + DECAY * w
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] = w - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, weights, 1.0 if prior is None else prior)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The class prior by the best bin, from scores of positives that were not trained on and of unlabelled rows."""
    cuts = np.unique(np.quantile(positive, np.linspace(0.01, 0.9, 60)))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = int(np.argmin((u + slack) / p))
    return float(np.clip(u[best] / p[best], 0.05, 0.98))


def fitted(positive: np.ndarray, unlabelled: np.ndarray) -> Model | None:
    """The model, or None without positives or unlabelled rows."""
    if len(positive) < 2 or not len(unlabelled):
        return None
    first = _trained(positive[::2], unlabelled[::2], None)
    prior = best_bin(first.logits(positive[1::2]), first.logits(unlabelled[1::2] if len(unlabelled) > 1 else unlabelled))
    return _trained(positive, unlabelled, prior)


def _sampled(docs: DataFrame, source: DataFrame, most: int) -> np.ndarray:
    """Features of docs with the smallest hashed ids of source, one row an id in order of id; at most so many ids are broadcast. Of texts of one id the first in order counts."""
    ids = source.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = texts.mapInArrow(measure, T.StructType([docs.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType()))])).collect()  # at most so many ids
    return np.array([r["x"] for r in sorted(rows, key=lambda r: r["doc_id"])], float).reshape(-1, FEATURES)


def learned(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from docs (unlabelled; doc_id, text) and labels (doc_id, quality), of which only quality 1 is trusted.

    Labels of null or of other values, and labels without a document, teach nothing."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    return fitted(_sampled(texts, labels.where("quality = 1"), MOST_POSITIVE), _sampled(texts, texts, MOST_UNLABELLED))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with quality_score, 0 to 1, from text alone.

    A null text counts as an empty one, which has a score like any other. Without a model every
    score is 0.5. Other columns and repeated rows are kept as they are; a column named
    quality_score is replaced."""
    small_batches(docs.sparkSession)
    own = [docs.schema[c] for c in other_columns(docs, "quality_score")]
    at = [f.name for f in own].index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = model.scores(features(batch.column(at))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, "quality_score"])

    return docs.select([f.name for f in own]).mapInArrow(score, T.StructType([*own, T.StructField("quality_score", T.DoubleType())]))
