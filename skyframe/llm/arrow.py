"""Arrow batches of bounded size, and NumPy views of the text in them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to a Python worker; texts of a block are processed together.
BATCH_ROWS = 512
BLOCK_BYTES = 1 << 20

#: Words end at these six characters only.
SPACE = b" \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may be long, and workers share an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a null text as the empty one; other columns never travel along."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        size = np.cumsum([len(x) if x is not None else 0 for x in batch.column(i).cast(pa.binary()).to_pylist()])
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


_rng = np.random.default_rng(20240229)
#: Random odd multipliers of a multilinear string hash, by position in a stretch of 64 KB, and by stretch.
MULT = _rng.integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STRETCH = _rng.integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STRETCH[0] = 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(mark: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; no run crosses the end of a document."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mark.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    cuts = doc_ends[(doc_ends > 0) & (doc_ends < len(mark))]
    cuts = np.unique(cuts[mark[cuts - 1] & mark[cuts]]) if len(cuts) else cuts
    return np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order, apart from each other and not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    value = (data[at + np.repeat(starts, size)].astype(np.uint64) + np.uint64(1)) * MULT[at & 0xFFFF]
    if size.max() > 1 << 16:
        value *= STRETCH[at >> 16]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64))


class Block:
    """The texts of a slice as one byte array, with document and word boundaries."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        raw = texts.cast(pa.binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4).astype(np.int64)
        self.n = len(raw)
        whole = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.data = whole[offsets[0]:offsets[-1]]
        self.ends = offsets[1:] - offsets[0]
        self.begins = offsets[:-1] - offsets[0]
        if lower:
            self.data = LOWER[self.data]
        self.solid = ~_IS_SPACE[self.data]
        self.word_starts, self.word_ends = spans(self.solid, self.ends)
        #: index of the first word of each document, and one past its last
        self.first_word = np.searchsorted(self.word_starts, self.begins)
        self.end_word = np.searchsorted(self.word_starts, self.ends)
        self.n_words = self.end_word - self.first_word

    @cached_property
    def _hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.word_starts, self.word_ends)

    @cached_property
    def _word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def word_hashes(self) -> np.ndarray:
        return self._hashes

    def word_doc(self) -> np.ndarray:
        return self._word_doc

    def count(self, mark: np.ndarray) -> np.ndarray:
        """Number of marked bytes of each document."""
        total = np.concatenate(([0], np.cumsum(mark, dtype=np.int64)))
        return total[self.ends] - total[self.begins]


def windows(hashes: np.ndarray, first: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of each k-word window inside a document."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = hashes[: n - k + 1].copy()
    for j in range(1, k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - k + 1 + j])
    last = np.repeat(end, end - first)[: n - k + 1]
    at = np.flatnonzero(np.arange(n - k + 1) + k <= last)
    return at, h[at]
