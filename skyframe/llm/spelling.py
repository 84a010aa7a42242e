"""Spelling variants: words that are one edit apart, found by Gram matrices of letter counts.

A word is a vector of letter counts.  The squared distance of two such vectors is at most two when the words are one edit
apart: a replaced letter lowers one count and raises another, an inserted one raises a single count.  Words lie in blocks
by length and by how many of their letters fall into each of a few classes; an edit leads to the same block or to one of
its few neighbours, so no other blocks meet.  A large block is dealt into slices, and every pair of slices is one group of
bounded size whose products NumPy takes at once.  Pairs at most two apart are verified letter by letter.  A group returns
one row per word, with its count of near words and the best of them, so what is shuffled grows with the words, not with
the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.llm.arrow import bound_batches
from skyframe.session import materialise

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A noise step deletes a letter where this number divides the hash of an occurrence.
NOISE = 199
MIN_CHARS, MIN_COUNT = 6, 5
#: A near word is a form when it occurs so many times as often.
RATIO = 5
#: Letters of the first three classes; all other letters are the fourth, known from the length.
CLASSES = ("aou", "eiy", "nrtls")
PLACE = ["size", "x", "y", "z"]
#: Words of a slice of a block, and rows of a product that are held at a time.
SLICE, ROWS = 8192, 512
#: Dimensions of the letter counts: letters beyond a to z share the last ones, which can only bring vectors closer.
DIMENSIONS = 32


def occurrences(docs: DataFrame, noise: int = NOISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the lower-cased letter runs of all texts, some occurrences with a letter left out, and their counts."""
    found = F.explode(F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("w")
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), found)
    h = F.crc32(F.concat("i", F.lit(":"), "w"))
    at = F.pmod(h, F.char_length("w")).cast("int")
    cut = F.concat(F.expr("left(w, at)"), F.expr("substring(w, at + 2)"))
    word = F.when(h % noise == 0, cut).otherwise(F.col("w"))
    return rows.withColumn("at", at).select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _letters(word: Column, letters: str) -> Column:
    return F.char_length(word) - F.char_length(F.translate(word, letters, ""))


def _slices(words: DataFrame) -> DataFrame:
    """(word, n, size, x, y, z, slice, slices): block and slice of each word, and how many slices its block has."""
    placed = words.select("word", "n", F.char_length("word").alias("size"), *(_letters(F.col("word"), c).alias(k) for k, c in zip(PLACE[1:], CLASSES, strict=True)))
    # a row per block: lengths times counts of three classes
    sizes = placed.groupBy(*PLACE).agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices"))
    return placed.join(sizes, PLACE).withColumn("slice", F.pmod(F.xxhash64("word"), F.col("slices")))


def _steps() -> list[tuple[int, ...]]:
    """Differences of (size, x, y, z) between a word and a near one."""
    unit = [tuple(int(i == c) for i in range(3)) for c in range(3)] + [(0, 0, 0)]
    replaced = {tuple(a - b for a, b in zip(p, q, strict=True)) for p in unit for q in unit}
    return [(0, *r) for r in sorted(replaced)] + [(1, *u) for u in unit] + [(-1, *(-c for c in u)) for u in unit]


def _meetings(words: DataFrame) -> DataFrame:
    """Every word once for each pair of slices it is compared in: (group, side, word, n).

    A group is named by its two slices, each by its block and number, the lower one first.
    """
    sizes = words.select(*PLACE, "slices").distinct()
    steps = F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(PLACE, step, strict=True))) for step in _steps()))).alias("step")
    near = words.select("word", "n", F.struct(*PLACE, "slice").alias("own"), steps).select(
        "word", "n", "own", *((F.col(f"own.{c}") + F.col(f"step.{c}")).alias(c) for c in PLACE))
    met = near.join(sizes, PLACE).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)))
    there = F.struct(*PLACE, F.col("other").alias("slice"))
    first = F.col("own") <= there
    return met.select(F.when(first, F.struct(F.col("own").alias("a"), there.alias("b"))).otherwise(F.struct(there.alias("a"), F.col("own").alias("b"))).alias("group"),
                      first.alias("first"), (F.col("own") == there).alias("same"), "word", "n")


def counts(words: list[str]) -> np.ndarray:
    """Letter counts, one row per word."""
    out = np.zeros((len(words), DIMENSIONS), np.float32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    column = np.where((points >= 97) & (points <= 122), points - 97, 26 + points % (DIMENSIONS - 26))
    np.add.at(out, (np.repeat(np.arange(len(words)), sizes), column), 1)
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point leads from one to the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


_PARTIAL = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _compare(table: pa.Table) -> pa.Table:
    """The near words of one group: for each word with any, their number and the one of largest n, of ties the smallest."""
    words, n = table.column("word").to_pylist(), table.column("n").to_pylist()
    first = np.array(table.column("first").to_pylist(), bool)
    same = bool(len(words)) and table.column("same")[0].as_py()
    left = np.arange(len(words)) if same else np.flatnonzero(first)
    right = left if same else np.flatnonzero(~first)
    found: dict[int, list] = {}

    def add(i: int, j: int) -> None:
        mine = found.setdefault(i, [0, -1, ""])
        mine[0] += 1
        if n[j] > mine[1] or (n[j] == mine[1] and words[j] < mine[2]):
            mine[1:] = n[j], words[j]

    if len(left) and len(right):
        c = counts(words)
        norm = (c * c).sum(axis=1, keepdims=True)
        one = np.ones_like(norm)
        # a product of these rows and columns is a squared distance
        rows, columns = np.hstack((c, norm, one))[left], np.ascontiguousarray(np.hstack((-2 * c, one, norm))[right].T)
        for start in range(0, len(left), ROWS):
            i, j = np.nonzero(rows[start : start + ROWS] @ columns < 2.5)
            i, j = left[i + start], right[j]
            if same:
                i, j = i[i < j], j[i < j]
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                if one_edit(words[p], words[q]):
                    add(p, q)
                    add(q, p)
    return pa.Table.from_arrays([pa.array([words[i] for i in found], pa.string()), *(pa.array([v[k] for v in found.values()], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string())))],
                                schema=_PARTIAL)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of each word with a near word among ``words`` (word, n; each word once)."""
    bound_batches(words.sparkSession)
    parts = _meetings(_slices(words)).groupBy("group").applyInArrow(_compare, "word string, n_near bigint, best_n bigint, best string")
    # of the largest n, the smallest word: strings are ordered by their UTF-8 bytes, as code points are
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("top")).select(
        "word", "n_near", (-F.col("top.m")).alias("best_n"), F.col("top.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form; each pass doubles the steps taken.

    A form occurs several times as often as its word, so the chains end, and soon.
    """
    at = materialise(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = at.join(further, "root", "left")
        if stepped.filter("next IS NOT NULL").isEmpty():
            return at
        at = materialise(stepped.select("word", F.coalesce("next", "root").alias("root")), "spelling_roots")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per row of ``words`` (word, n): word, form, root, n, n_near, form_n.

    Two words are near when they are one edit apart.  A word's form is its near word of largest n, of ties the smallest,
    if that n is at least ``ratio`` times its own, else null; its root is the last of its forms, or itself.  Words are
    distinct and not null; an empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("forms form no cycle only when the ratio is 2 or more")
    near = near_words(words)
    has = F.col("best_n") >= ratio * F.col("n")
    joined = materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "spelling_forms")
    roots = _roots(joined.filter("form IS NOT NULL"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, noise: int = NOISE, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spelling variants among the frequent words of all texts, as ``group_variants`` returns them.

    Words are letter runs (A to Z lower-cased, accented Latin letters as they are) of at least ``min_chars`` code points
    that occur ``min_count`` times or more; where ``noise`` divides the hash of an occurrence (its id, its word), one
    letter is left out.  Null and empty texts have no words; a null id hashes as an empty one; repeated rows count as
    often as they occur; a text of any length is read whole; other columns do not matter; an empty table gives an empty result.
    """
    frequent = materialise(occurrences(docs, noise, id_col, text_col).filter((F.col("n") >= min_count) & (F.char_length("word") >= min_chars)), "spelling_words")
    return group_variants(frequent, ratio)
