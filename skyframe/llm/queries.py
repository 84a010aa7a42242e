"""Registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import (
    bpe, exact_dedup, fill_in_middle, html_text, licences, near_dedup, oracles, packing, phrases, quality_rules, spelling, token_output, toxicity, weak_quality)
from skyframe.session import checkpoint_root

SHUFFLE_KEY = 20240229


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_groups(_table(spark, sf_dir, "documents"), k=4, percent=80)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return weak_quality.classify(docs, weak_quality.fit(docs))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.fit(docs, _table(spark, sf_dir, "labels")))


def held_out(column: str):
    return F.crc32(F.col(column).cast("string")) % 3 == 1


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), rule=lambda c: ~held_out(c))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_root(spark)}/token_shards-{uuid.uuid4().hex}"
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_output.write_shards(_table(spark, sf_dir, "documents"), folder, path, public_tokenizers.PATTERN, SHUFFLE_KEY)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = phrases.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.transform(_table(spark, sf_dir, "documents"), seed=42))


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_minhash_near_dedup, op3_html_extraction, op4_quality_classifier, op5_packing, op6_quality_rules, op7_toxicity, op8_byte_bpe,
    op9_licence_scan, op10_token_output, op11_spelling_variants, op12_substring_dedup, op13_fill_in_middle)}

ORACLES = {"op1_exact_dedup": oracles.EXACT, "op2_minhash_near_dedup": oracles.NEAR, "op9_licence_scan": oracles.licence_sql(),
           "op12_substring_dedup": oracles.REPEATS, "op13_fill_in_middle": oracles.FILL}
