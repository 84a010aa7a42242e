"""Fill-in-middle transformation of texts, with offsets by a sparse index of exceptions.

A text is cut into a prefix, a middle and a suffix, which are written in another order between sentinels.  All cutting is
done on UTF-8 bytes.  Code points and bytes of an ASCII span differ by a constant, so only the multibyte characters are
recorded: the position of each and the bytes it has beyond one.  A binary search in that list converts an offset either
way, and a text without such characters costs nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.arrow import Block, blocks, texts_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of texts that are transformed, and of those that begin with their suffix.
RATE, SPM_RATE = 50, 80


class ExceptionIndex:
    """The multibyte characters of UTF-8 bytes: where each begins, and how many bytes it has beyond one."""

    def __init__(self, data: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        excess = 1 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        #: excess bytes of all characters before each exception, and of all in the last place
        self.before = np.concatenate(([0], np.cumsum(excess)))
        self.bytes = lead
        self.points = lead - self.before[:-1]

    def to_points(self, at: np.ndarray) -> np.ndarray:
        """Code-point offsets of byte offsets, each on a character's border."""
        return at - self.before[np.searchsorted(self.bytes, at, side="left")]

    def to_bytes(self, at: np.ndarray) -> np.ndarray:
        """Byte offsets of code-point offsets."""
        return at + self.before[np.searchsorted(self.points, at, side="left")]


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 that depend on the seed and the id alone; a null id is drawn for as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


_SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def _transformer(seed: int, rate: int, spm_rate: int, unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            block = Block(part.column("text"))
            ids = part.column("doc_id").to_pylist()
            count, forms, heads, mids, outs = [], [], [], [], []
            for d, doc_id in enumerate(ids):
                data = block.data[block.begins[d] : block.ends[d]]
                raw = data.tobytes()
                index = None
                if unit == "chars":
                    index = ExceptionIndex(data)
                    n = int(index.to_points(np.array([len(data)]))[0])
                else:
                    ends = block.word_ends[block.first_word[d] : block.end_word[d]] - block.begins[d]
                    # blanks after the last word are a token of their own
                    n = len(ends) + int(len(data) > (ends[-1] if len(ends) else 0))
                h1, h2, h3, h4 = draws(seed, doc_id)
                count.append(n)
                if h3 % 100 >= rate or not raw or any(s in raw for s in (PREFIX, SUFFIX, MIDDLE)):
                    forms.append("plain")
                    heads.append(None)
                    mids.append(None)
                    outs.append(raw)
                    continue
                cuts = np.sort(np.array([h1 % (n + 1), h2 % (n + 1)]))
                if unit == "chars":
                    points, at = cuts, index.to_bytes(cuts)
                else:
                    at = np.array([0 if c == 0 else int(ends[c - 1]) if c <= len(ends) else len(raw) for c in cuts])
                    points = ExceptionIndex(data).to_points(at)
                a, b = int(at[0]), int(at[1])
                prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
                spm = h4 % 100 < spm_rate
                forms.append("spm" if spm else "psm")
                heads.append(int(points[0]))
                mids.append(int(points[1] - points[0]))
                outs.append(b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if spm else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(count, pa.int64()), pa.array(forms, pa.string()), pa.array(heads, pa.int64()), pa.array(mids, pa.int64()),
                 pa.array(outs, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transform(docs: DataFrame, seed: int = 42, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = "tokens", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output.

    ``unit`` is ``tokens`` (a word with the blanks before it; blanks at the end are one more) or ``chars``; n counts them.
    The prefix ends after the smaller of two draws from 0 to n, the middle after the larger.  A text is plain, and its own
    output, when it is empty or null, holds a sentinel, or is not drawn; its counts of code points are then null.  Draws
    depend on the id alone: repeated rows give equal rows, and rows with a null id are all drawn alike.  A text of any
    length is cut whole; other columns do not travel along; an empty table gives an empty result.
    """
    if unit not in ("tokens", "chars"):
        raise ValueError("unit is tokens or chars")
    return texts_of(docs, id_col, text_col).mapInArrow(_transformer(seed, rate, spm_rate, unit), _SCHEMA)


def rebuild(form: str, output: bytes) -> bytes:
    """The text of an output.  No part holds a sentinel, and none can arise where parts meet: each begins with ``<``."""
    if form == "plain":
        return output
    inner, middle = output.split(MIDDLE, 1)
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, other = inner[len(first) :].split(second, 1)
    return (other + middle + one) if form == "spm" else (one + middle + other)


def restore(rows: DataFrame, form: str = "form", output: str = "output", name: str = "restored") -> DataFrame:
    """Adds the text rebuilt from form and output alone; null where either is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, output):
            outs = part.column(output).cast(pa.binary()).to_pylist()
            texts = [None if f is None or o is None else rebuild(f, o) for f, o in zip(part.column(form).to_pylist(), outs, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*part.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{name}` string")


def digests(rows: DataFrame) -> DataFrame:
    """Outputs and rebuilt texts as digests."""
    return restore(rows).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                                F.sha2("restored", 256).alias("restored_sha256"))
