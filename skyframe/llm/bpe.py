"""Byte-level BPE with two tiers: a minimal perfect hash over the vocabulary, then merges from a heap over linked bytes.

Texts are split by the pattern of the vocabulary.  Of a block of texts, each distinct pre-token is looked up once: a
displacement per bucket sends every token of the vocabulary to a slot of its own, and the token stored there is compared
byte by byte.  Pre-tokens that are no token themselves are merged by rank.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from skyframe.llm.arrow import blocks, hash_spans, mix, texts_of

#: Text that is looked up together; the more, the fewer distinct pre-tokens.
BLOCK_BYTES = 4 << 20
#: Keys of a bucket on average, and pre-tokens whose merges a worker remembers.
BUCKET_KEYS = 4
REMEMBERED = 400_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def hash_strings(keys: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    ends = np.cumsum(sizes)
    return hash_spans(np.frombuffer(b"".join(keys), np.uint8), ends - sizes, ends)


@dataclass
class PerfectHash:
    """Slots 0..n-1 for n keys. ``shift`` has a displacement for each bucket, or -1 - slot where one key has the bucket."""

    shift: np.ndarray
    n: int

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        d = self.shift[(hashes % np.uint64(len(self.shift))).astype(np.int64)]
        moved = (mix(hashes ^ (d.astype(np.uint64) * _STEP)) % np.uint64(self.n)).astype(np.int64)
        return np.where(d < 0, -1 - d, moved)


def perfect_hash(hashes: np.ndarray) -> PerfectHash:
    n = len(hashes)
    m = max(1, n // BUCKET_KEYS)
    bucket = (hashes % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=m)
    first = np.cumsum(size) - size
    shift, used = np.zeros(m, np.int64), np.zeros(n, bool)
    for b in np.argsort(-size, kind="stable"):
        k = size[b]
        if k < 2:
            break
        keys, d, tried = hashes[order[first[b] : first[b] + k]], 0, 64
        while True:
            tries = np.arange(d, d + tried, dtype=np.uint64) * _STEP
            slots = (mix(keys[None, :] ^ tries[:, None]) % np.uint64(n)).astype(np.int64)
            free = ~used[slots].any(axis=1)
            ranked = np.sort(slots[free], axis=1)
            good = np.flatnonzero(free)[(ranked[:, 1:] != ranked[:, :-1]).all(axis=1)]
            if len(good):
                shift[b] = d + good[0]
                used[slots[good[0]]] = True
                break
            d, tried = d + tried, min(tried * 2, 8192)
    single = np.flatnonzero(size == 1)
    shift[single] = -1 - np.flatnonzero(~used)[: len(single)]
    return PerfectHash(shift, n)


def merge(word: bytes, ranks: dict[bytes, int], byte_ids: list[int]) -> list[int]:
    """Ids of a pre-token: the adjacent parts of lowest rank are joined first, the leftmost of equal ones."""
    n = len(word)
    get = ranks.get
    part = [byte_ids[b] for b in word]
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    #: rank of the part that starts here joined with the next one; -1 where there is none
    joined = [get(word[i : i + 2], -1) for i in range(n - 1)]
    joined.append(-1)
    heap = [r << 32 | i for i, r in enumerate(joined) if r >= 0]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        i = top & 0xFFFFFFFF
        rank = top >> 32
        if joined[i] != rank:
            continue
        j = end[i]
        k = end[j]
        part[i], part[j], end[i], joined[j] = rank, -1, k, -1
        if k < n:
            prev[k] = i
            joined[i] = r = get(word[i : end[k]], -1)
            if r >= 0:
                push(heap, r << 32 | i)
        else:
            joined[i] = -1
        if i:
            p = prev[i]
            joined[p] = r = get(word[p:k], -1)
            if r >= 0:
                push(heap, r << 32 | p)
    return [t for t in part if t >= 0]


@dataclass
class Vocabulary:
    tokens: list[bytes]
    ids: list[int]
    pattern: str
    ranks: dict[bytes, int] = field(init=False)
    by_id: dict[int, bytes] = field(init=False)
    merged: dict[bytes, list[int]] = field(init=False, default_factory=dict)

    def __post_init__(self):
        self.ranks = dict(zip(self.tokens, self.ids, strict=True))
        self.by_id = dict(zip(self.ids, self.tokens, strict=True))
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(self.pattern).findall
        self.hash: PerfectHash | None = None

    def index(self, table: PerfectHash) -> None:
        """Put each token at its slot."""
        self.hash = table
        self.at = np.empty(table.n, np.int64)
        self.at[table.slots(hash_strings(self.tokens))] = np.arange(table.n)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode() for w in words]
        where = self.at[self.hash.slots(hash_strings(raw))].tolist() if raw else []
        out = []
        for word, k in zip(raw, where, strict=True):
            if self.tokens[k] == word:
                out.append((self.ids[k],))
                continue
            got = self.merged.get(word)
            if got is None:
                if len(self.merged) >= REMEMBERED:
                    self.merged.clear()
                got = self.merged[word] = tuple(merge(word, self.ranks, self.byte_ids))
            out.append(got)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        words = [self.split(t) for t in texts]
        place = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        coded = self.encode_words(list(place))
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), "<u4", int(size.sum()))
        first = np.cumsum(size) - size
        out = []
        for ws in words:
            at = np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))
            n = size[at]
            begin = np.cumsum(n) - n
            out.append(flat[np.repeat(first[at] - begin, n) + np.arange(int(n.sum()))])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids.tolist()))


def read_ranks(path: str) -> tuple[list[bytes], list[int]]:
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return [base64.b64decode(t) for t, _ in pairs], [int(r) for _, r in pairs]


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str, table: PerfectHash | None = None) -> Vocabulary:
    """The vocabulary of a rank file; a worker reads it once. Without ``table`` the perfect hash is built here."""
    key = (path, pattern)
    if key not in _LOADED:
        vocab = Vocabulary(*read_ranks(path), pattern)
        vocab.index(table or perfect_hash(hash_strings(vocab.tokens)))
        _LOADED[key] = vocab
    return _LOADED[key]


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _coder(path: str, pattern: str, table: PerfectHash, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern, table)
        for block in blocks(batches, limit=BLOCK_BYTES):
            rows = []
            for doc, ids in zip(block.column("doc_id").to_pylist(), vocab.encode(block.column("text").to_pylist()), strict=True):
                raw, back = ids.tobytes(), vocab.decode(ids)
                rows.append((doc, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()) if digests else (doc, raw, back))
            schema = DIGESTS if digests else ENCODED
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and the bytes decoded from them; with ``digests`` their SHA-256 instead.

    A null or empty text has no ids.  Null ids and repeated rows give a row each; an empty table gives an empty result.
    No special token is recognised in texts.  No shuffle takes place.
    """
    table = vocabulary(path, pattern).hash
    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "doc_id bigint, ids binary, decoded binary"
    return texts_of(docs, id_col, text_col).mapInArrow(_coder(path, pattern, table, digests), kind)
