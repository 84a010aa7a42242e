"""Removal of passages that an earlier document holds, located by automata of recurring phrases.

A window of WINDOW words is removed where its words also occur in a document with a smaller id.  Every window has an
anchor: of its shorter word runs, the one with the smallest hash.  Equal windows have equal anchors, and a new anchor
comes only every few words, so anchors are shuffled instead of windows.

1. Anchors found in several documents are kept, with the first of these documents.
2. Documents are read again with their recurring anchors, and give the passage around each: the words of all windows
   that have it.
3. Passages are dealt out by anchor and sorted.  A task confirms on their words which phrases recur, compiles shards of
   phrases into Aho-Corasick automata of bounded size, and streams the passages through them.  A symbol of an automaton
   is a whole word.
4. The words located are removed from the documents.

An anchor in very many windows would bring all of them into one task.  Its passages are folded into distinct ones before
the shuffle, the windows of these are keyed by their own words, and what recurs in a distinct passage comes back to its
occurrences by a join that is split where one passage is in a large part of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.arrow import Block, blocks, bound_batches, texts_of, windows
from skyframe.session import materialise

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 13, 5
#: Windows of an anchor beyond which its passages are keyed by their words instead.
COMMON = 65_536
#: Words after which a shard is compiled, once its last anchor ends.
SHARD = 150_000
#: Windows of a passage; more with one anchor, as in periodic texts, are several passages.
LONGEST = 4096


def _anchors(block: Block, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: document, first window, last window (as words of the block), anchor hash."""
    empty = np.zeros(0, np.int64)
    at, h = windows(block.word_hashes(), block.first_word, block.end_word, anchor)
    start = np.flatnonzero(np.repeat(block.end_word, block.n_words) - np.arange(len(block.word_starts)) >= window)
    if not len(start):
        return empty, empty, empty, np.zeros(0, np.uint64)
    # hash of the anchor at each word; none where the document ends too early
    value = np.full(len(block.word_starts), np.uint64(0xFFFFFFFFFFFFFFFF))
    value[at] = h
    # smallest of a window's anchors: spans of two, four, ... words are combined
    span, reach, best = window - anchor + 1, 1, value
    while 2 * reach <= span:
        best, reach = np.minimum(best[: len(best) - reach], best[reach:]), 2 * reach
    rest = span - reach
    best = (np.minimum(best[: len(best) - rest], best[rest:]) if rest else best)[start]
    doc = block.word_doc()[start]
    new = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1]))))
    within = np.arange(len(start)) - np.repeat(new, np.diff(np.append(new, len(start))))
    first = np.flatnonzero(within % LONGEST == 0)
    last = np.append(first[1:], len(start)) - 1
    return doc[first], start[first], start[last], best[first]


def _anchorer(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            doc, first, last, value = _anchors(Block(part.column("text")), window, anchor)
            order = np.lexsort((value, doc))
            doc, value, size = doc[order], value[order], (last - first + 1)[order]
            fresh = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])))) if len(doc) else np.zeros(0, np.int64)
            n = np.add.reduceat(size, fresh) if len(doc) else size
            yield pa.RecordBatch.from_arrays([pa.array(value[fresh].view(np.int64)), part.column("doc_id").take(pa.array(doc[fresh])), pa.array(n.astype(np.int32))],
                                             names=["anchor", "doc_id", "n"])

    return run


_PASSAGE = "doc_id bigint, copy bigint, anchor bigint, common boolean, at bigint, passage string"


def _passages(window: int, anchor: int):
    """The passages of a document's recurring anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            block = Block(part.column("text"))
            doc, first, last, value = _anchors(block, window, anchor)
            lists = part.column("anchors")
            held = lists.flatten()
            owner = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            # documents of the block by number, so that one sorted search finds all anchors
            known = np.zeros(len(owner), [("doc", np.int64), ("value", np.int64)])
            known["doc"], known["value"] = owner, held.field("anchor").to_numpy()
            common = held.field("common").to_numpy(zero_copy_only=False).astype(bool)
            order = np.argsort(known)
            known, common = known[order], common[order]
            mine = np.zeros(len(doc), known.dtype)
            mine["doc"], mine["value"] = doc, value.view(np.int64)
            place = np.minimum(np.searchsorted(known, mine), max(len(known) - 1, 0))
            hit = np.flatnonzero(known[place] == mine) if len(known) else np.zeros(0, np.int64)
            begins, ends = block.word_starts[first[hit]].tolist(), block.word_ends[last[hit] + window - 1].tolist()
            raw = block.data.tobytes()
            texts = [b" ".join(raw[x:y].split()) for x, y in zip(begins, ends, strict=True)]
            rows = pa.array(doc[hit])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(rows), part.column("copy").take(rows), pa.array(mine["value"][hit]), pa.array(common[place[hit]] if len(hit) else np.zeros(0, bool)),
                 pa.array(first[hit] - block.first_word[doc[hit]]), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "copy", "anchor", "common", "at", "passage"])

    return run


_SPAN = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


class _Symbols(dict):
    """A symbol for each word; surrogates are none."""

    def __missing__(self, word: str) -> str:
        n = len(self) + 1
        symbol = self[word] = chr(n if n < 0xD800 else n + 0x800)
        return symbol


class PhraseAutomaton:
    """Phrases of whole words with the first document of each; a word is one symbol."""

    def __init__(self, window: int):
        self.window = window
        self.symbols = _Symbols()
        self.automaton = ahocorasick.Automaton()
        self.ready = False

    def encode(self, words: list[str]) -> str:
        return "".join(map(self.symbols.__getitem__, words))

    def compile(self, phrases: dict[str, int]) -> None:
        """Phrases with their first document; a phrase may be longer than a window."""
        for phrase, first in phrases.items():
            self.automaton.add_word(phrase, (len(phrase), first))
        self.ready = bool(phrases)
        if self.ready:
            self.automaton.make_automaton()

    def locate(self, symbols: str) -> list[tuple[int, int, int]]:
        """(first word, word after the last, first document) of every phrase in the symbols of a passage, in order."""
        return [(end + 1 - size, end + 1, first) for end, (size, first) in self.automaton.iter(symbols)] if self.ready else []


def recurring(texts: dict[str, tuple[int, int]], window: int) -> dict[str, int]:
    """The phrases found in two or more documents, with the first of them; a text comes with its first and last document.

    The texts are the passages of one anchor.  Where there is only one, all its windows recur with it, and it is one phrase.
    """
    if len(texts) == 1:
        return {text: low for text, (low, high) in texts.items() if low < high}
    seen: dict[str, tuple[int, int]] = {}
    for text, (low, high) in texts.items():
        for i in range(len(text) - window + 1):
            phrase = text[i : i + window]
            known = seen.get(phrase)
            seen[phrase] = (low, high) if known is None else (min(known[0], low), max(known[1], high))
    return {phrase: l for phrase, (l, h) in seen.items() if l < h}


def covered(located: list[tuple[int, int, int]], doc: int) -> list[tuple[int, int]]:
    """The words of located phrases (first word, word after the last, first document; in order) that begin in a smaller document, as spans."""
    spans: list[tuple[int, int]] = []
    for where, end, first in located:
        if first < doc:
            if spans and where <= spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((where, end))
    return spans


def _shard(columns: list[list], window: int) -> pa.RecordBatch:
    """The words of passages (anchor, doc_id, copy, at, passage) that earlier documents hold, as spans."""
    automaton = PhraseAutomaton(window)
    texts: dict[str, tuple[int, int]] = {}
    of: dict[int, list[str]] = {}
    for anchor, doc, _, _, passage in zip(*columns, strict=True):
        known = texts.get(passage)
        if known is None:
            texts[passage] = (doc, doc)
            of.setdefault(anchor, []).append(passage)
        else:
            texts[passage] = (min(known[0], doc), max(known[1], doc))
    coded = {passage: automaton.encode(passage.split(" ")) for passage in texts}
    # phrases hold their anchor, so those of two anchors are never in one passage
    phrases: dict[str, int] = {}
    for passages in of.values():
        phrases |= recurring({coded[p]: texts[p] for p in passages}, window)
    automaton.compile(phrases)
    located = {passage: automaton.locate(symbols) for passage, symbols in coded.items()}
    spans: list[list[int]] = [[], [], [], []]
    for _, doc, copy, at, passage in zip(*columns, strict=True):
        for start, stop in covered(located[passage], doc):
            for column, v in zip(spans, (doc, copy, at + start, at + stop), strict=True):
                column.append(v)
    return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in spans], schema=_SPAN)


def _locator(window: int):
    """Rows come sorted by anchor; a shard takes whole anchors, so all passages that can share a phrase."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        words = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "doc_id", "copy", "at", "passage")]
            begin = 0
            anchor = batch.column("anchor").to_numpy()
            last = held[0][-1] if held[0] else None
            size = np.cumsum(pc.count_substring(batch.column("passage"), " ").to_numpy() + 1) + words
            # rows with which another anchor begins
            for i in np.flatnonzero(np.concatenate(([anchor[0] != last], anchor[1:] != anchor[:-1])) if len(anchor) else []).tolist():
                before = int(size[i - 1]) if i else words
                if before >= SHARD:
                    yield _shard([h + c[begin:i] for h, c in zip(held, columns, strict=True)], window)
                    held, begin = [[], [], [], [], []], i
                    size = size - before
            words = int(size[-1]) if len(size) else words
            held = [h + c[begin:] for h, c in zip(held, columns, strict=True)]
        if held[0]:
            yield _shard(held, window)

    return run


def _windows_of(window: int):
    """The windows of passages, by the place of their first word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "passage"):
            out: list[list] = [[], [], []]
            for i, passage in enumerate(part.column("passage").to_pylist()):
                words = passage.split(" ")
                n = len(words) - window + 1
                for column, values in zip(out, ([i] * n, range(n), [" ".join(words[w : w + window]) for w in range(n)]), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([*part.take(pa.array(out[0], pa.int64())).columns, pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                                             names=[*part.schema.names, "place", "phrase"])

    return run


def _common_spans(passages: DataFrame, window: int) -> DataFrame:
    """What ``_locator`` finds, for passages of anchors with very many windows."""
    distinct = materialise(passages.groupBy("passage").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "common_passages")
    pieces = distinct.mapInArrow(_windows_of(window), "passage string, low bigint, high bigint, place bigint, phrase string")
    first = pieces.groupBy("phrase").agg(F.min("low").alias("first"), F.max("high").alias("last")).filter("first < last").select("phrase", "first")
    # at most one entry per word of a passage; the files of such texts are far smaller than the texts, so sizes must not invite a broadcast
    located = pieces.select("passage", "place", "phrase").join(first.hint("merge"), "phrase").groupBy("passage").agg(F.collect_list(F.struct("place", "first")).alias("located"))
    held = passages.select("doc_id", "copy", "at", "passage").join(materialise(located, "common_phrases").hint("merge"), "passage")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for doc, copy, at, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "copy", "at", "located")), strict=True):
                for start, stop in covered(sorted((x["place"], x["place"] + window, x["first"]) for x in places), doc):
                    for column, v in zip(out, (doc, copy, at + start, at + stop), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in out], schema=_SPAN)

    return held.select("doc_id", "copy", "at", "located").mapInArrow(spans, "doc_id bigint, copy bigint, start bigint, stop bigint")


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches):
        block = Block(part.column("text"))
        gone = np.zeros(len(block.word_starts) + 1, np.int64)
        copies = part.column("copy").to_pylist()
        for d, spans in enumerate(part.column("spans").to_pylist()):
            for s in spans or ():
                if s["copy"] == copies[d]:
                    gone[block.first_word[d] + s["start"]] += 1
                    gone[block.first_word[d] + s["stop"]] -= 1
        kept = np.cumsum(gone)[:-1] == 0
        texts = []
        for d in range(block.n):
            words = block.data[block.begins[d] : block.ends[d]].tobytes().split()
            mask = kept[block.first_word[d] : block.end_word[d]]
            texts.append(b" ".join(words if mask.all() else [w for w, k in zip(words, mask.tolist(), strict=True) if k]))
        removed = np.concatenate(([0], np.cumsum(~kept)))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(block.n_words.astype(np.int64)), pa.array((removed[block.end_word] - removed[block.first_word]).astype(np.int64)),
             pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, common: int = COMMON) -> DataFrame:
    """(doc_id, copy, start, stop): word spans whose windows an earlier document holds; ``copy`` is a hash of the text."""
    return _spans(_keyed(texts_of(docs)), window, anchor, common)


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "text").withColumn("copy", F.xxhash64("text"))


def _spans(rows: DataFrame, window: int, anchor: int, common: int) -> DataFrame:
    placed = rows.filter("doc_id IS NOT NULL")
    anchors = placed.select("doc_id", "text").mapInArrow(_anchorer(window, anchor), "anchor bigint, doc_id bigint, n int")
    several = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("n").alias("n")).filter("low < high")
    # written, so that the join below has an exchange on either side, of which a common anchor's rows can be split
    several = materialise(several.select("anchor", (F.col("n") > common).alias("common")), "recurring_anchors")
    mine = anchors.select("anchor", "doc_id").join(several, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "common")).alias("anchors"))
    # a document has no more anchors than words
    found = placed.join(mine, "doc_id").select("doc_id", "text", "copy", "anchors").mapInArrow(_passages(window, anchor), _PASSAGE)
    passages = materialise(found, "passages")
    dealt = passages.filter("NOT common").repartition("anchor").sortWithinPartitions("anchor", "doc_id")
    some = dealt.select("anchor", "doc_id", "copy", "at", "passage").mapInArrow(_locator(window), "doc_id bigint, copy bigint, start bigint, stop bigint")
    return some.unionByName(_common_spans(passages.filter("common"), window))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, common: int = COMMON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    Words are runs of anything but blanks, unchanged.  A word goes when a window of ``window`` words over it also starts in
    a document with a smaller id, judged on the input.  Null, empty and short texts have no window.  Rows with equal ids
    never remove words of each other; a row with a null id has no place in the order: it keeps all and removes nothing.
    A text of any length is read whole; other columns do not travel along; an empty table gives an empty result.
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor is part of a window")
    bound_batches(docs.sparkSession)
    rows = _keyed(texts_of(docs, id_col, text_col))
    spans = materialise(_spans(rows, window, anchor, common), "repeated_spans")
    mine = spans.groupBy("doc_id").agg(F.collect_list(F.struct("copy", "start", "stop")).alias("spans"))
    return rows.join(mine, "doc_id", "left").select("doc_id", "text", "copy", "spans").mapInArrow(_remover, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
