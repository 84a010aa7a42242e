"""Preparation of a training corpus: each stage works on all that its predecessor kept.

Every stage takes null ids and texts, empty and very long texts, repeated rows, tables without rows and columns of any name;
what becomes of them is said where its operator is. All stages but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skyframe.llm import exact_dedup, near_dedup, packing, toxicity, weak_quality
from skyframe.session import materialise

#: Words of a shingle and similarity, in percent, of near copies.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic by a model learned from all labelled ones."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier finds good; it is fitted on these documents."""
    return weak_quality.keep_good(docs, weak_quality.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for blanks."""
    return exact_dedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies."""
    return near_dedup.keep_one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack)]

#: The models and the search for near copies have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
