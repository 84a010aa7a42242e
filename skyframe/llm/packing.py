"""Token sequences of bounded length, packed so that their attention costs are even.

A document is cut into full sequences and a rest.  Rests are dealt to tasks by a hash of the document and packed in
blocks: in descending order of cost, each goes to the sequence of lowest cost that still has room for it, and a rest that
fits nowhere is cut where the open sequences end.  What remains of a block's last sequences ends at powers of two.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.arrow import blocks, texts_of

#: Tokens of a sequence, rests packed together, and the cost of a token next to that of a pair of tokens.
SEQ_LEN = 1024
BLOCK_RESTS = 4096
LINEAR_COST = 2048

END_ID = 0


def load_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level BPE of a `tokenizers` JSON file; its special tokens are recognised in texts, as that library does."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    if path not in _ENCODINGS:
        _ENCODINGS[path] = load_encoding(path, pattern)
    return _ENCODINGS[path]


def token_ids(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a text and the id that ends it."""
    ids = enc.encode(text, allowed_special="all") if "<|" in text else enc.encode_ordinary(text)
    ids.append(END_ID)
    return np.array(ids, dtype="<u4")


def cost(length: int) -> int:
    return LINEAR_COST * length + length * length


def pack(lengths: np.ndarray, seq_len: int = SEQ_LEN) -> list[tuple[int, int, int, int, int]]:
    """Place rests of these lengths: (rest, start in it, length, sequence, offset).

    All sequences but the last are full; the last one's content is cut into powers of two, which need no padding.
    """
    total = int(lengths.sum())
    full, tail = divmod(total, seq_len)
    room = [seq_len] * full + [1 << b for b in range(seq_len.bit_length()) if tail >> b & 1]
    size, spent = list(room), [0] * len(room)
    # sequences by the room they have left, those of one room by cost, and the least cost of each room
    open_: list[list[tuple[int, int]]] = [[] for _ in range(seq_len + 1)]
    least = np.full(seq_len + 1, np.inf)

    def add(s: int) -> None:
        if room[s]:
            heapq.heappush(open_[room[s]], (spent[s], s))
            least[room[s]] = open_[room[s]][0][0]

    def cheapest(need: int) -> int | None:
        """The cheapest sequence with so much room, of equal ones the emptiest."""
        at = seq_len - int(least[need:][::-1].argmin())
        if least[at] == np.inf:
            return None
        _, s = heapq.heappop(open_[at])
        least[at] = open_[at][0][0] if open_[at] else np.inf
        return s

    def put(i: int, start: int, take: int, s: int) -> None:
        placed.append((i, start, take, s, size[s] - room[s]))
        room[s] -= take
        spent[s] += cost(take)
        add(s)

    for s in range(full):
        add(s)
    placed: list[tuple[int, int, int, int, int]] = []
    unplaced = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        s = cheapest(int(lengths[i]))
        if s is None:
            unplaced.append(i)
        else:
            put(i, 0, int(lengths[i]), s)
    # what is left is cut to fill the remaining room, cheapest sequences first
    for s in range(full, len(room)):
        add(s)
    for i in unplaced:
        start, need = 0, int(lengths[i])
        while need:
            s = cheapest(1)
            take = min(need, room[s])
            put(i, start, take, s)
            start, need = start + take, need - take
    return placed


_CUT = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, spread bigint, ids binary"
_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _cutter(path: str, pattern: str, seq_len: int):
    schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in (c.split()[0] for c in _CUT.split(", "))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for block in blocks(batches):
            rows = []
            for doc, text, spread in zip(*(block.column(n).to_pylist() for n in ("doc_id", "text", "spread")), strict=True):
                ids = token_ids(enc, text)
                n = len(ids)
                for s in range(0, n - n % seq_len, seq_len):
                    rows.append((doc, s, seq_len, zlib.crc32(ids[s : s + seq_len].tobytes()), n, spread, None))
                if n % seq_len:
                    rest = ids[n - n % seq_len :]
                    narrow = rest.astype("<u2") if enc.n_vocab <= 1 << 16 else rest
                    rows.append((doc, n - len(rest), len(rest), None, n, spread, narrow.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return cut


def _packer(narrow: bool, seq_len: int):
    schema = pa.schema([(c.split()[0], pa.int64()) for c in _PIECE.split(", ")])

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task numbers its own sequences: ids stay unique without counting those of other tasks
        next_id, rests = TaskContext.get().partitionId() << 40, []

        def flush():
            nonlocal next_id, rests
            rows, used = [], 0
            for i, start, length, s, offset in pack(np.array([len(r[1]) for r in rests]), seq_len):
                (doc, first, n), ids = rests[i]
                rows.append((doc, first + start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), n, next_id + s, offset))
                used = max(used, s + 1)
            next_id, rests = next_id + used, []
            return emit(rows)

        for batch in batches:
            done = []
            for doc, first, length, crc, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")), strict=True):
                if ids is None:
                    done.append((doc, first, length, crc, n, next_id, 0))
                    next_id += 1
                    continue
                rests.append(((doc, first, n), np.frombuffer(ids, "<u2" if narrow else "<u4")))
                if len(rests) == BLOCK_RESTS:
                    yield flush()
            if done:
                yield emit(done)
        if rests:
            yield flush()

    return place


def pack_documents(docs: DataFrame, path: str, pattern: str, seq_len: int = SEQ_LEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the ending id alone.  Null ids and repeated rows are documents like any other.  Pieces of a
    sequence are gapless from offset 0; sequences are full, or as long as a power of two.  An empty table gives an empty
    result.  Blocks are read from the sorted rows of a task, so memory does not depend on how rows are dealt.
    """
    source = texts_of(docs, id_col, text_col).withColumn("spread", F.xxhash64("doc_id", "text"))
    cut = source.mapInArrow(_cutter(path, pattern, seq_len), _CUT)
    dealt = cut.repartition("spread", "start").sortWithinPartitions("spread", "start")
    return dealt.mapInArrow(_packer(encoding(path, pattern).n_vocab <= 1 << 16, seq_len), _PIECE)
