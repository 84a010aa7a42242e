"""Hashed word and character n-grams, and linear models over them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.arrow import Block, mix

BITS = 18
CHAR_N = (3, 4, 5)
#: Weight of the mean over a document's n-grams: a score does not depend on a text's length.
SCALE = 30.0


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _char_grams(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and bucket of each n-byte gram; a document's last n - 1 bytes start none."""
    size = len(block.data) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(size, np.uint64)
    for j in range(n):
        h = (h << np.uint64(8)) | block.data[j : j + size]
    doc_end = np.repeat(block.ends, block.ends - block.begins)[:size]
    at = np.flatnonzero(np.arange(size) + n <= doc_end)
    h = (h[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    return at, _bucket((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))


def groups(block: Block, extra: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature, (document, bucket) of every occurrence.  ``extra``: small integers, one per document each."""
    doc_of = np.repeat(np.arange(block.n), block.ends - block.begins)
    for n in CHAR_N:
        at, bucket = _char_grams(block, n)
        yield doc_of[at], bucket
    words = block.word_hashes()
    yield block.word_doc(), _bucket(mix(words + np.uint64(1)))
    if len(words) > 1:
        doc = block.word_doc()
        same = np.flatnonzero(doc[1:] == doc[:-1])
        yield doc[same], _bucket(mix(words[same] * np.uint64(0xC2B2AE3D27D4EB4F) + words[same + 1]))
    for k, values in enumerate(extra or []):
        yield np.arange(block.n), _bucket(mix(np.full(block.n, (k + 1) << 32, np.uint64) + values.astype(np.uint64)))


def linear(block: Block, weights: np.ndarray, extra: list[np.ndarray] | None = None) -> np.ndarray:
    """Sum over the kinds of features of the mean weight of a document's features; 0 for a text without any."""
    out = np.zeros(block.n)
    for doc, bucket in groups(block, extra):
        n = np.bincount(doc, minlength=block.n)
        out += np.bincount(doc, weights[bucket], minlength=block.n) / np.maximum(n, 1)
    return SCALE * out


def sparse(block: Block, extra: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each document, so that linear() is SCALE times their product with the weights."""
    parts = [[] for _ in range(block.n)]
    for doc, bucket in groups(block, extra):
        key, n = np.unique(doc << BITS | bucket, return_counts=True)
        owner = key >> BITS
        total = np.bincount(owner, n, minlength=block.n)
        cuts = np.searchsorted(owner, np.arange(block.n + 1))
        for d in range(block.n):
            lo, hi = cuts[d], cuts[d + 1]
            if lo < hi:
                parts[d].append(((key[lo:hi] & ((1 << BITS) - 1)).astype(np.int32), (n[lo:hi] / total[d]).astype(np.float32)))
    return [(np.concatenate([k for k, _ in p]), np.concatenate([v for _, v in p])) if p else (np.zeros(0, np.int32), np.zeros(0, np.float32)) for p in parts]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that make sigmoid(slope z + intercept) a probability of y; targets are smoothed by counts."""
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y > 0.5, high, low)
    x = np.column_stack((z, np.ones(len(z))))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - t) + 1e-6 * w)
        w -= np.clip(step, -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    slope: float
    intercept: float

    def probability(self, block: Block, extra: list[np.ndarray] | None = None) -> np.ndarray:
        return sigmoid(self.slope * (linear(block, self.weights, extra) + self.bias) + self.intercept)


def fit_rows(rows: list[tuple[tuple[np.ndarray, np.ndarray], float, float]], epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Linear:
    """Logistic regression by adaptive gradient steps on (features, target, weight); one row in five calibrates it."""
    rng = np.random.default_rng(seed)
    w, seen, bias = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3), 0.0
    order = rng.permutation(len(rows))
    held, used = order[: len(rows) // 5], order[len(rows) // 5 :]
    for _ in range(epochs):
        for i in rng.permutation(used):
            (bucket, value), y, weight = rows[i]
            p = float(sigmoid(np.array(SCALE * float(value @ w[bucket]) + bias)))
            g = weight * (p - y)
            if abs(g) < 1e-4:
                continue
            step = g * value
            seen[bucket] += step * step
            w[bucket] -= rate * step / np.sqrt(seen[bucket])
            bias -= 0.05 * g
    z = np.array([SCALE * float(v @ w[b]) + bias for (b, v), _, _ in (rows[i] for i in held)])
    y = np.array([rows[i][1] for i in held])
    slope, intercept = platt(z, np.round(y)) if len(held) >= 20 and 0 < np.round(y).sum() < len(y) else (1.0, 0.0)
    return Linear(w.astype(np.float32), bias, slope, intercept)


def fit(sample: DataFrame, extra: Callable[[Block], list[np.ndarray]] | None = None, **options) -> Linear:
    """Fit on a bounded sample (text, target in [0, 1], weight) in one task; only the weights come back.

    Rows are put in the order of a hash of their content, so the model does not depend on how they were read.
    An empty sample gives a model of probability one half.
    """
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            block = Block(batch.column("text"))
            rows += zip(sparse(block, extra(block) if extra else None), batch.column("target").to_pylist(), batch.column("weight").to_pylist(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_rows(rows, **options))], pa.binary())], names=["model"])

    ordered = sample.select("text", F.col("target").cast("double"), F.col("weight").cast("double")).repartition(1).sortWithinPartitions(F.xxhash64("text"), "target")
    got = ordered.mapInArrow(train, "model binary").first()
    return pickle.loads(got[0]) if got else Linear(np.zeros(1 << BITS, np.float32), 0.0, 1.0, 0.0)
