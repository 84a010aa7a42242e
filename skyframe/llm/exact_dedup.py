"""Exact duplicates by a tree-merge of sorted digest runs.

Every input partition turns its documents into one sorted run of digests.  Runs then meet in binomial rounds: in each
round the entries of FAN neighbouring runs are dealt to the same tasks by (run group, digest), sorted, and merged in one
pass that keeps, for each digest, the verified best document and the number of documents.  After the last round one run
is left, spread over all tasks by digest.  An entry is a few dozen bytes and a run holds a digest once, so a text that
makes up a third of all rows is one entry of each run; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.llm.arrow import bound_batches, fresh
from skyframe.session import materialise

#: Runs merged by one round.
FAN = 16

#: Characters that do not count when texts are compared: [\x20\x09-\x0D].
BLANK = " \t\n\x0b\f\r"

def _same_as_previous(keys: list[np.ndarray]) -> np.ndarray:
    same = np.ones(len(keys[0]), bool)
    same[0] = False
    for k in keys:
        flat = k.reshape(len(k), -1)
        same[1:] &= (flat[1:] == flat[:-1]).all(axis=1)
    return same


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge sorted entries: the first of each (run, digest, guard) stays and gets the sum of the counts.

    A digest alone does not join two entries: the length of the compared text and a second, unrelated hash must agree.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        col = {n: table.column(n).combine_chunks() for n in ("run", "digest", "norm_len", "guard", "n")}
        raw = col["digest"].chunk(0) if isinstance(col["digest"], pa.ChunkedArray) else col["digest"]
        start = int(np.frombuffer(raw.buffers()[1], np.int32, 1, raw.offset * 4)[0])
        digest = np.frombuffer(raw.buffers()[2], np.uint8, 32 * len(raw), start).reshape(-1, 4, 8)
        same = _same_as_previous([col["run"].to_numpy(), digest, col["norm_len"].to_numpy(), col["guard"].to_numpy()])
        first = np.flatnonzero(~same)
        total = np.add.reduceat(col["n"].to_numpy(), first)
        merged = table.take(pa.array(first)).set_column(table.schema.get_field_index("n"), "n", pa.array(total, pa.int64()))
        held = merged.slice(merged.num_rows - 1).combine_chunks()
        yield from merged.slice(0, merged.num_rows - 1).combine_chunks().to_batches()
    if held is not None:
        yield from held.to_batches()


_ENTRY = "run int, digest binary, norm_len int, guard bigint, n_points int, best_id bigint, home int, n bigint"


def _round(runs: DataFrame) -> DataFrame:
    """Deal the entries of FAN runs to the same tasks and merge them."""
    dealt = runs.withColumn("run", F.floor(F.col("run") / FAN).cast("int")).repartition("run", "digest")
    # best document first: the longest text, then the smallest id; a null id is last
    order = ["run", "digest", "norm_len", "guard", F.col("n_points").desc(), F.col("best_id").asc_nulls_last(), "home"]
    return dealt.sortWithinPartitions(*order).mapInArrow(_merge, _ENTRY)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without blanks; null and empty texts are equal too.  The row with the longest
    original text stays, then the smallest id; a null id loses against any other.  Repeated rows are rows of their own:
    exactly one row of a group is kept.  An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.translate(text, BLANK, "")
    rows = docs.select(
        F.spark_partition_id().alias("run"), F.unhex(F.sha2(norm, 256)).alias("digest"), F.length(norm).alias("norm_len"),
        F.xxhash64(norm).alias("guard"), F.length(text).alias("n_points"), F.col(id_col).cast("bigint").alias("best_id"))
    ranked = F.struct((-F.col("n_points")).alias("less"), F.col("best_id").isNull().alias("no_id"), F.col("best_id").alias("id"))
    # each input partition groups its own rows: the leaves of the tree, read twice below
    leaves = materialise(rows.groupBy("run", "digest", "norm_len", "guard").agg(F.sort_array(F.collect_list(ranked)).alias("members")), "digest_runs")
    top = F.col("members")[0]
    runs = leaves.select(
        "run", "digest", "norm_len", "guard", (-top["less"]).cast("int").alias("n_points"), top["id"].alias("best_id"),
        F.col("run").alias("home"), F.size("members").cast("bigint").alias("n"))
    last_run = leaves.agg(F.max("run")).first()[0] or 0
    while True:
        runs = _round(runs)
        last_run //= FAN
        if not last_run:
            break
    best = runs.select("digest", "norm_len", "guard", F.col("best_id").alias("keep_id"), "home", F.col("n").alias("group_size"))
    placed = leaves.join(best, ["digest", "norm_len", "guard"]).select(
        "digest", "keep_id", "group_size", (F.col("run") == F.col("home")).alias("at_home"), F.posexplode("members").alias("pos", "m"))
    return placed.select(
        F.col("m.id").alias("doc_id"), "keep_id", "group_size", (F.col("at_home") & (F.col("pos") == 0)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of ``docs`` that stay, with all their columns; of repeated rows of one id and text, one.

    Null and empty texts are copies of each other; texts of any length count whole; of equal texts the longest original
    stays, of ties the smallest id, a row without an id last; an empty table stays empty.
    """
    i, sha, one = fresh(docs, "__id"), fresh(docs, "__sha"), fresh(docs, "__one")
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(_id_key("doc_id").alias(i), F.col("text_sha256").alias(sha))
    norm = F.translate(F.coalesce(F.col(text_col), F.lit("")), BLANK, "")
    keyed = docs.withColumns({i: _id_key(id_col), sha: F.sha2(norm, 256)})
    # the window needs no shuffle or sort beyond those of the join
    rank = F.row_number().over(Window.partitionBy(i, sha).orderBy(i, sha))
    return keyed.join(kept, [i, sha], "left_semi").withColumn(one, rank).filter(F.col(one) == 1).drop(i, sha, one)


def _id_key(column: str) -> Column:
    """An id that never is null, for equality joins."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
