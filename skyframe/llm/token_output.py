"""Token ids in training order, as binary shards of equal records.

Documents are cut into sequences of a fixed number of ids.  A first pass counts the sequences of each input partition, so
each sequence has an index without any being moved.  A keyed Feistel network over the next power of four, walked until it
lands inside the range, permutes the indexes: every sequence gets its slot of the global order by itself.  Slots are dealt
to tasks in ranges, each range is a shard, and a record is found by its slot alone, so reading can stop and go on anywhere.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.arrow import blocks, mix, texts_of
from skyframe.llm.packing import END_ID, encoding, token_ids

SEQ_LEN = 512
SHARD_SEQUENCES = 8192
ROUNDS = 6


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0..n-1, given by ``key``, of any of its elements."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = mix(np.uint64(key & (2**64 - 1)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = index.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> half, out[walk] & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        out[walk] = left << half | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def _counter(path: str, pattern: str, seq_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = encoding(path, pattern), 0
        for part in blocks(batches):
            for text in part.column("text").to_pylist():
                n = len(enc.encode(text, allowed_special="all") if "<|" in text else enc.encode_ordinary(text)) + 1
                total += -(-n // seq_len)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total], pa.int64())], names=["part", "n"])

    return run


_SEQUENCE = "slot bigint, shard bigint, doc_id bigint, start bigint, length bigint, ids binary"


def _maker(path: str, pattern: str, seq_len: int, shard: int, first: dict[int, tuple[int, int]], n: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        dtype = np.dtype("<u2" if enc.n_vocab <= 1 << 16 else "<u4")
        index, expected = first.get(TaskContext.get().partitionId(), (0, 0))
        begin = index
        for part in blocks(batches):
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = token_ids(enc, text)
                for s in range(0, len(ids), seq_len):
                    piece = ids[s : s + seq_len]
                    padded = np.full(seq_len, END_ID, dtype)
                    padded[: len(piece)] = piece
                    rows.append((doc, s, len(piece), padded.tobytes()))
            slot = permute(np.arange(index, index + len(rows)), n, key)
            index += len(rows)
            doc, start, length, raw = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // shard), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(raw, pa.binary())],
                                             names=["slot", "shard", "doc_id", "start", "length", "ids"])
        if index - begin != expected:
            raise ValueError("the documents were read in another order than when they were counted; write them to a table first")

    return run


def shard_name(shard: int) -> str:
    return f"shard-{shard:07d}.bin"


_WRITTEN = "slot bigint, shard bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint"


def _writer(folder: str, shard_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        out, now, part = None, None, ""

        def finish():
            # a shard appears whole or not at all; a repeated task writes the same bytes
            if out is not None:
                out.close()
                store.move(part, posixpath.join(root, shard_name(now)))

        for batch in batches:
            crcs = []
            for shard, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if shard != now:
                    finish()
                    now, part = shard, posixpath.join(root, f"_writing-{uuid.uuid4().hex}")
                    out = store.open_output_stream(part)
                out.write(ids)
                crcs.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("slot", "shard", "doc_id", "start", "length")), pa.array(crcs, pa.int64())],
                                             names=[c.split()[0] for c in _WRITTEN.split(", ")])
        finish()

    return run


def write_shards(docs: DataFrame, folder: str, path: str, pattern: str, key: int, seq_len: int = SEQ_LEN, shard_size: int = SHARD_SEQUENCES,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards below ``folder``, a place that all executors share, and return a row per sequence.

    slot, shard, doc_id, start (first id within the document), length (without padding) and ids_crc32 (of the record as
    written).  Slots are 0..n-1 without gaps; slot s is record s % shard_size of shard s // shard_size.  A document ends
    with END_ID, which also pads its last sequence.  A null or empty text is one sequence.  Repeated rows and null ids
    are documents like any other; an empty table writes nothing.  Files are written when the result is.  ``docs`` must
    be read in the same order twice, as a stored table is.
    """
    rows = texts_of(docs, id_col, text_col)
    counts = sorted(map(tuple, rows.mapInArrow(_counter(path, pattern, seq_len), "part bigint, n bigint").collect()))
    first, total = {}, 0
    for part, n in counts:
        first[part] = (total, n)
        total += n
    made = rows.mapInArrow(_maker(path, pattern, seq_len, shard_size, first, max(total, 1), key), _SEQUENCE)
    return made.repartition("shard").sortWithinPartitions("slot").mapInArrow(_writer(folder, shard_size), _WRITTEN)


def read_records(folder: str, first: int, count: int, seq_len: int = SEQ_LEN, shard_size: int = SHARD_SEQUENCES, dtype: str = "<u2") -> Iterator[np.ndarray]:
    """Records from slot ``first`` on, shard by shard, in order."""
    store, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
    stride = seq_len * np.dtype(dtype).itemsize
    while count > 0:
        shard, at = divmod(first, shard_size)
        n = min(count, shard_size - at)
        with store.open_input_file(posixpath.join(root, shard_name(shard))) as f:
            f.seek(at * stride)
            yield from np.frombuffer(f.read(n * stride), dtype).reshape(-1, seq_len)
        first, count = first + n, count - n
