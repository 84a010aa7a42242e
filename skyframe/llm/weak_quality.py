"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.  Expectation-maximisation over the counts of
vote patterns (all documents, at most 3 ** labellers patterns) estimates how often each labeller is right, without any
true label.  The posterior of each pattern is the soft label of its documents; a bounded sample of them trains a hashed
linear scorer, which then decides on every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm import hashed
from skyframe.llm.arrow import Block, blocks, texts_of
from skyframe.llm.quality_rules import _IS_SYMBOL, repeated_words

#: Documents that train the scorer, and the probability of good quality from which a document stays.
FIT_ROWS = 4000
KEEP_AT = 0.5

#: (measure, good at or below, bad at or above); between the two a labeller abstains, and those without the first figure
#: never vote good.  Each kind of poor text is seen by several of them.
LABELLERS = (
    ("symbols_per_word", None, 0.3),
    ("symbol_ends_share", None, 0.3),
    ("bars_per_word", None, 0.2),
    ("capital_share", None, 0.7),
    ("exclamations_per_word", None, 0.3),
    ("stutter_share", None, 0.2),
    ("repeated_share", 0.1, 0.4),
    ("odd_bytes_share", 0.03, 0.09),
    ("not_small_share", 0.2, 0.7),
)

#: A vote is worth at least this factor for its side, and at most the second one: labellers do better than chance.
VOTE_WORTH = (3.0, 100.0)

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[9, 10, 13, 32, 44, 46, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Shares of the linear scorer's meta features, in steps.
_STEPS = np.array([0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7])


def measures(block: Block) -> dict[str, np.ndarray]:
    n = np.maximum(block.n_words, 1)
    hashes, doc = block.word_hashes(), block.word_doc()
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))
    capitals, small = block.count(_CAPITAL[block.data]), block.count(_SMALL[block.data])
    last = block.data[block.word_ends - 1]
    return {
        "symbols_per_word": block.count(_IS_SYMBOL[block.data] & (block.data != 124)) / n,
        "symbol_ends_share": np.bincount(doc[_IS_SYMBOL[last] | (last == 33)], minlength=block.n) / n,
        "bars_per_word": block.count(block.data == 124) / n,
        "capital_share": capitals / np.maximum(capitals + small, 1),
        "exclamations_per_word": block.count(block.data == 33) / n,
        "stutter_share": np.bincount(doc[same], minlength=block.n) / n,
        "repeated_share": repeated_words(block, hashes) / n,
        "odd_bytes_share": block.count(~_PLAIN[block.data]) / np.maximum(block.ends - block.begins, 1),
        "not_small_share": 1 - (small + block.count(block.data >= 128)) / np.maximum(block.count(block.solid), 1),
    }


def votes(block: Block, found: dict[str, np.ndarray]) -> np.ndarray:
    """A row per document: 1 good, 0 bad, -1 no vote.  A text without words gets bad votes only."""
    out = np.full((block.n, len(LABELLERS)), -1, np.int8)
    for j, (name, good, bad) in enumerate(LABELLERS):
        if good is not None:
            out[found[name] <= good, j] = 1
        out[found[name] >= bad, j] = 0
    out[block.n_words == 0] = 0
    return out


@dataclass
class WeakLabels:
    """Share of good documents, and per labeller the chance of a bad and of a good vote on bad and on good documents."""

    prior: float
    on_bad: np.ndarray
    on_good: np.ndarray

    def worth(self) -> np.ndarray:
        """Log odds for good of each labeller's bad and good vote; no vote says nothing."""
        low, high = np.log(VOTE_WORTH)
        ratio = np.log(self.on_good) - np.log(self.on_bad)
        return np.column_stack((-np.clip(-ratio[:, 0], low, high), np.clip(ratio[:, 1], low, high)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        worth = self.worth()
        z = np.log(self.prior / (1 - self.prior)) + (patterns == 0) @ worth[:, 0] + (patterns == 1) @ worth[:, 1]
        return hashed.sigmoid(z)


def estimate(patterns: np.ndarray, count: np.ndarray, rounds: int = 100) -> WeakLabels:
    """Expectation-maximisation over distinct vote patterns and how many documents have each.

    It starts with documents that have a bad vote as bad, nine to one; chances are smoothed by one pseudo-vote each.
    """
    q = np.where((patterns == 0).any(axis=1), 0.1, 0.9)
    model = None
    for _ in range(rounds):
        good, bad = q * count, (1 - q) * count
        share = [np.column_stack([((patterns == v).T @ part + 1) / (part.sum() + 2) for v in (0, 1)]) for part in (bad, good)]
        model = WeakLabels(float((good.sum() + 1) / (count.sum() + 2)), *share)
        new = model.posterior(patterns)
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return model


def _extra(block: Block, found: dict[str, np.ndarray] | None = None) -> list[np.ndarray]:
    return [np.searchsorted(_STEPS, v) for v in (found or measures(block)).values()]


def _voter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches):
        block = Block(part.column("text"))
        code = (votes(block, measures(block)).astype(np.int64) + 1) @ (3 ** np.arange(len(LABELLERS)))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(code)], names=["doc_id", "pattern"])


def _unpack(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


@dataclass
class QualityModel:
    labels: WeakLabels
    scorer: hashed.Linear
    keep_at: float = KEEP_AT


def fit(docs: DataFrame, max_rows: int = FIT_ROWS, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Labeller accuracies from all documents; the scorer from ``max_rows`` of them, the smallest by a hash of the id."""
    rows = texts_of(docs, id_col, text_col)
    counted = rows.mapInArrow(_voter, "doc_id bigint, pattern bigint").groupBy("pattern").count().collect()
    if not counted:
        return QualityModel(estimate(np.full((1, len(LABELLERS)), -1, np.int8), np.ones(1)), hashed.Linear(np.zeros(1 << hashed.BITS, np.float32), 0.0, 1.0, 0.0), keep_at)
    labels = estimate(_unpack(np.array([r[0] for r in counted])), np.array([r[1] for r in counted], float))
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).distinct().withColumnRenamed("doc_id", "chosen")
    sample = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).select("text")

    def soft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            block = Block(part.column("text"))
            q = labels.posterior(votes(block, measures(block)))
            # a posterior near one half teaches little
            yield pa.RecordBatch.from_arrays([part.column("text"), pa.array(q), pa.array(np.abs(2 * q - 1))], names=["text", "target", "weight"])

    return QualityModel(labels, hashed.fit(sample.mapInArrow(soft, "text string, target double, weight double"), _extra), keep_at)


def probability(block: Block, model: QualityModel, found: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """A text without words has probability 0."""
    return np.where(block.n_words == 0, 0.0, model.scorer.probability(block, _extra(block, found)))


def classify(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, posterior (of the weak labels), probability (of the scorer) and kept, one row per document.

    Null and empty texts are rejected.  Repeated rows and null ids give a row each; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            block = Block(part.column("text"))
            found = measures(block)
            p = probability(block, model, found)
            q = model.labels.posterior(votes(block, found))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(q), pa.array(p), pa.array(p >= model.keep_at)], names=["doc_id", "posterior", "probability", "kept"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, posterior double, probability double, kept boolean")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    A row counts by its whole text alone: a null text counts as the empty one, ids may be null or repeat, equal texts stay or go
    together, and an empty table stays empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text_col):
            block = Block(part.column(text_col).fill_null(""))
            yield part.filter(pa.array(probability(block, model) >= model.keep_at))

    return docs.mapInArrow(run, docs.schema)
