"""Gradient boosting of histogram trees with a softmax loss, fitted by Spark.

Features are binned once. Each level of the trees of an iteration, one tree per class, is one job: a task sums gradients
and curvatures of its rows per (class, node, feature, bin), sums of tasks are added by executors in two levels, and the
driver sees one table of sums, whose size depends on classes, nodes, features and bins, never on the rows. Sums are
integers, so a split does not depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Bins of a feature, and rows whose values place the borders between them.
BINS, EDGE_ROWS = 32, 20_000
#: Gradients are counted in steps of this size.
STEP = 1 << 20
#: Partial sums that one task adds.
ADDED = 64
#: Rows that are routed at a time.
BLOCK = 4096


@dataclass
class Tree:
    """Nodes in heap order; a node without a feature is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node each row has reached."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(len(self.value).bit_length()):
            split = self.feature[at] >= 0
            if not split.any():
                break
            rows = np.flatnonzero(split)
            here = at[rows]
            at[rows] = 2 * here + 1 + (bins[rows, self.feature[here]] > self.cut[here])
        return at


@dataclass
class BoostedModel:
    classes: list[str]
    edges: np.ndarray
    rate: float
    start: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for f in range(x.shape[1]):
            out[:, f] = np.searchsorted(self.edges[f], x[:, f], side="left")
        return out

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.repeat(self.start[None], len(bins), axis=0)
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += self.rate * tree.value[tree.nodes(bins)]
        return out

    def probabilities(self, bins: np.ndarray) -> np.ndarray:
        s = self.scores(bins)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Feature lists as rows; nulls and values that are no number read 0."""
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.where(np.isfinite(values), values, 0.0).reshape(-1, width)


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Borders of each feature between bins of about equal counts; a feature with few values has a bin for each."""
    out = np.full((x.shape[1], bins - 1), np.inf)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > bins:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
            out[f, : len(values)] = values
        elif len(values) > 1:
            out[f, : len(values) - 1] = values[:-1]
    return out


def _sums(model: BoostedModel, trees: list[Tree], depth: int, bins: int):
    """Of a task: integer gradient and curvature sums of this level, one row per class."""
    classes, features, first, width = len(model.classes), len(model.edges), 2**depth - 1, 2**depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, 2, width * features * bins), np.int64)
        seen = False
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x = np.frombuffer(b"".join(part.column("bins").to_pylist()), np.uint8).reshape(-1, features)
                y = part.column("y").to_numpy()
                p = model.probabilities(x)
                gradient = p.copy()
                gradient[np.arange(len(y)), y] -= 1.0
                curve = p * (1.0 - p)
                for k in range(classes):
                    node = trees[k].nodes(x) - first
                    live = np.flatnonzero(node >= 0)
                    if not len(live):
                        continue
                    slot = ((node[live, None] * features + np.arange(features)) * bins + x[live]).ravel()
                    for j, value in enumerate((gradient, curve)):
                        whole = np.repeat(np.rint(value[live, k] * STEP), features)
                        total[k, j] += np.bincount(slot, weights=whole, minlength=total.shape[2]).astype(np.int64)
                seen = True
        if seen:
            for k in range(classes):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k].tobytes()], pa.binary())], names=["class", "sums"])

    return run


def _add(table: pa.Table) -> pa.Table:
    out = 0
    for raw in table.column("sums").to_pylist():
        out = out + np.frombuffer(raw, np.int64)
    return pa.table({"class": table.column("class").slice(0, 1), "sums": pa.array([out.tobytes()], pa.binary())})


def _level(binned: DataFrame, model: BoostedModel, trees: list[Tree], depth: int, bins: int) -> np.ndarray:
    """(class, gradient or curvature, node, feature, bin) sums over all rows."""
    parts = binned.mapInArrow(_sums(model, trees, depth, bins), "class int, sums binary")
    # every task hands on one row per class; ADDED tasks are added at a time
    slots = max(1, binned.rdd.getNumPartitions() // ADDED)
    if slots > 1:
        slot = F.pmod(F.spark_partition_id(), F.lit(slots)).alias("_slot")
        parts = parts.select("class", "sums", slot).groupBy("class", "_slot").applyInArrow(_add, "class int, sums binary")
    shape = (2, 2**depth, len(model.edges), bins)
    out = np.zeros((len(model.classes), *shape), np.int64)
    for row in parts.groupBy("class").applyInArrow(_add, "class int, sums binary").collect():
        out[row["class"]] = np.frombuffer(row["sums"], np.int64).reshape(shape)
    return out


def _split(trees: list[Tree], sums: np.ndarray, depth: int, last: bool, l2: float, least: float) -> bool:
    """Grow every node of a level by its best split, the first of equal ones; True while any node was split."""
    grown = False
    for tree, (gradient, curve) in zip(trees, sums / STEP, strict=True):
        for k in range(2**depth):
            node = 2**depth - 1 + k
            if depth and tree.feature[(node - 1) // 2] < 0:
                continue
            g, h = gradient[k].cumsum(axis=1), curve[k].cumsum(axis=1)
            whole_g, whole_h = g[0, -1], h[0, -1]
            tree.value[node] = -whole_g / (whole_h + l2)
            if last:
                continue
            left_g, left_h = g[:, :-1], h[:, :-1]
            right_g, right_h = whole_g - left_g, whole_h - left_h
            gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - whole_g**2 / (whole_h + l2)
            gain[(left_h < least) | (right_h < least)] = 0.0
            best = int(gain.argmax())
            if gain.flat[best] > 1e-6:
                tree.feature[node], tree.cut[node] = divmod(best, gain.shape[1])
                grown = True
    return grown


def fit(rows: DataFrame, label: str = "label", features: str = "features", iterations: int = 20, depth: int = 3, rate: float = 0.3, bins: int = BINS, l2: float = 1.0,
        least: float = 1e-2, edge_rows: int = EDGE_ROWS, seed: int = 42) -> BoostedModel:
    """Boosted trees over rows of a label and a list of numbers; rows without either take no part.

    Bin borders come from at most ``edge_rows`` rows of lowest seeded hash; all rows count in every split.
    """
    data = materialise(rows.select(F.col(label).cast("string").alias("label"), F.col(features).alias("x")).where("label IS NOT NULL AND x IS NOT NULL"), "boosting-rows")
    shares = {r["label"]: r["count"] for r in data.groupBy("label").count().orderBy("label").collect()}
    if not shares:
        raise ValueError("no labelled rows")
    classes = sorted(shares)
    # only hashes are ordered; the wide rows of the lowest ones are read after that
    hashed = data.withColumn("_h", F.xxhash64("x", F.lit(seed)))
    lowest = hashed.select("_h").orderBy("_h").limit(edge_rows).agg(F.max("_h").alias("h")).first()["h"]
    sample = hashed.where(F.col("_h") <= lowest).orderBy("_h").limit(edge_rows).select("x").toArrow()
    width = len(sample.column("x")[0])
    prior = np.log(np.array([shares[c] for c in classes]) / sum(shares.values()))
    model = BoostedModel(classes, _edges(_matrix(sample.column("x").combine_chunks(), width), bins), rate, prior)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {c: k for k, c in enumerate(classes)}
        for batch in batches:
            x = model.bins(_matrix(batch.column("x"), width))
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x], pa.binary()), pa.array([place[c] for c in batch.column("label").to_pylist()], pa.int32())],
                                             names=["bins", "y"])

    binned = materialise(data.mapInArrow(to_bins, "bins binary, y int"), "boosting-bins")
    for _ in range(iterations if len(classes) > 1 else 0):
        trees = [Tree.empty(depth) for _ in classes]
        for level in range(depth + 1):
            if not _split(trees, _level(binned, model, trees, level, bins), level, level == depth, l2, least):
                break
        model.rounds.append(trees)
    return model


def predict(model: BoostedModel, rows: DataFrame, features: str = "features") -> DataFrame:
    """Adds ``predicted``, ``confidence`` (its probability) and ``probabilities`` in the order of the model's classes."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probabilities(model.bins(_matrix(batch.column(features), len(model.edges))))
            best = p.argmax(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([model.classes[k] for k in best], pa.string()), pa.array(p[np.arange(len(p)), best]), lists],
                                             names=[*batch.schema.names, "predicted", "confidence", "probabilities"])

    return rows.mapInArrow(run, f"{fields}, predicted string, confidence double, probabilities array<double>")
