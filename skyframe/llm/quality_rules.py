"""Quality rules: hashed n-gram logistic regression with a calibrated probability, next to fixed rules on counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm import hashed
from skyframe.llm.arrow import Block, blocks, hash_spans, mix, spans, texts_of, windows
from skyframe.llm.labelled import labelled_sample

#: Labelled rows the model is fitted on, and the probability of good quality from which a document stays.
FIT_ROWS = 4000
KEEP_AT = 0.5

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def word_chars(block: Block) -> np.ndarray:
    """Code points inside words: bytes of words that do not continue a UTF-8 sequence."""
    return block.count(block.solid & ((block.data & 0xC0) != 0x80))


def duplicate_lines(block: Block) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    starts, ends = spans(block.data != 10, block.ends)
    total = np.concatenate(([0], np.cumsum(block.solid)))
    with_word = total[ends] > total[starts]
    starts, ends = starts[with_word], ends[with_word]
    doc = np.searchsorted(block.ends, starts, side="right")
    return _repeats(doc, hash_spans(block.data, starts, ends), block.n)


def _keyed(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(h + mix(doc.astype(np.uint64) + np.uint64(1)))


def _repeats(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Values of each document beyond the first of their kind."""
    _, first = np.unique(_keyed(doc, h), return_index=True)
    return np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)


def repeated_words(block: Block, hashes: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """Words inside k-word windows that occur twice or more in their document, the first occurrence included."""
    at, h = windows(hashes, block.first_word, block.end_word, k)
    if not len(at):
        return np.zeros(block.n, np.int64)
    doc = block.word_doc()
    _, inverse, count = np.unique(_keyed(doc[at], h), return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    step = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + k, -1)
    return np.bincount(doc[np.cumsum(step[:-1]) > 0], minlength=block.n)


def base_counts(block: Block) -> dict[str, np.ndarray]:
    return {
        "n_words": block.n_words,
        "word_chars": word_chars(block),
        "n_symbols": block.count(_IS_SYMBOL[block.data]),
        "n_dup_lines": duplicate_lines(block),
        "n_repeat_words": repeated_words(block, block.word_hashes()),
    }


def failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> hashed.Linear:
    """The model, fitted on a bounded sample of labelled rows."""
    sample = labelled_sample(docs, labels, label_col, max_rows, id_col, text_col)
    return hashed.fit(sample.select("text", "target", F.lit(1.0).alias("weight")))


def _scorer(model: hashed.Linear, keep_at: float):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            block = Block(part.column("text"))
            counts = base_counts(block)
            bad, p = failed(counts), model.probability(block)
            columns = [part.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in counts.values()), pa.array(bad), pa.array(p), pa.array(~bad & (p >= keep_at))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def apply_rules(docs: DataFrame, model: hashed.Linear, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, probability (of good quality) and kept, one row per document.

    A null text has no words and fails the base rules.  Repeated rows and null ids give a row each; an empty table gives
    an empty result.  No shuffle takes place.
    """
    schema = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
              "base_failed boolean, probability double, kept boolean")
    return texts_of(docs, id_col, text_col).mapInArrow(_scorer(model, keep_at), schema)
