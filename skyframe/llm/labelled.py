"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.arrow import texts_of


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text", rule=None) -> DataFrame:
    """(doc_id, text, target) of at most ``max_rows`` documents with a label, the smallest by a hash of the id.

    Of repeated labels the largest counts; null labels and ids do not.  ``rule`` is a condition on the id.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("labelled"), F.col(label_col).alias("target"))
    if rule is not None:
        known = known.filter(rule("labelled"))
    chosen = known.groupBy("labelled").agg(F.max("target").alias("target")).orderBy(F.xxhash64("labelled"), "labelled").limit(max_rows)
    rows = texts_of(docs, id_col, text_col)
    # max_rows bounds what is broadcast, so texts stay where they are read
    return rows.join(F.broadcast(chosen), rows.doc_id == chosen.labelled).select("doc_id", "text", "target")
