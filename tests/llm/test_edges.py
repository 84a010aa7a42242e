"""Every operator and stage over nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import tempfile

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyframe.llm import bpe, exact_dedup, hashed, html_text, licences, near_dedup, packing, quality_rules, token_output, toxicity, weak_quality

SF = "/root/testdata/sf0.001"
JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
LONG = " ".join(f"word{i}é" for i in range(60_000))
ROWS = [(None, "alone without an id"), (None, None), (1, None), (2, ""), (3, LONG), (4, "the same text again and again here"), (4, "the same text again and again here"),
        (5, "the  same text again\nand again here"), (6, " \t\n "), (7, "x" * 200_000), (8, " Ünïcode\u0000 — text <|endoftext|> 'quoted'"), (9, "#" * 50 + "\n\n" + "!" * 50)]
CLASH = ["run", "digest", "home", "signature", "rep", "region", "members", "__id", "__sha", "__gone", "slot", "spread", "target", "labelled", "keep_id", "html", "s", "w"]


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.select("*", *(F.lit(f"clash-{c}").alias(c) for c in CLASH))


def quality_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return quality_rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), max_rows=80)


def operators(spark):
    tox = toxicity.ToxicityModel(toxicity.Lexicon([toxicity.Term("idiot", False, 5.0, 1)]), __import__("numpy").ones(toxicity.FEATURES), -3.0)
    return {
        "exact": exact_dedup.exact_groups,
        "near": near_dedup.near_groups,
        "quality": lambda d: weak_quality.classify(d, weak_quality.fit(d, max_rows=50)),
        "packing": lambda d: packing.pack_documents(d, JSON, PATTERN),
        "rules": lambda d: quality_rules.apply_rules(d, quality_model(spark)),
        "toxicity": lambda d: toxicity.score(d, tox),
        "bpe": lambda d: bpe.encode_documents(d, RANKS, PATTERN),
        "licences": licences.scan,
        "tokens": lambda d: token_output.write_shards(d, tempfile.mkdtemp(prefix="shards-"), JSON, PATTERN, key=5),
    }


PER_ROW = {"exact", "near", "quality", "rules", "toxicity", "bpe"}


@pytest.mark.parametrize("name", ["exact", "near", "quality", "packing", "rules", "toxicity", "bpe", "licences", "tokens"])
def test_operator_on_odd_rows(spark, name):
    run = operators(spark)[name]
    got = run(table(spark, ROWS)).collect()
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got)
    if name in PER_ROW:
        assert ids == sorted((i is not None, i or 0) for i, _ in ROWS)
    elif name != "licences":
        assert {i for _, i in ids} == {i or 0 for i, _ in ROWS}
    assert run(table(spark, [])).collect() == []


def test_html_on_odd_rows(spark):
    rows = [(None, "<p>a"), (1, None), (1, ""), (2, "<b>" * 20_000 + "deep"), (3, "<!-- never closed <p>x"), (4, "<table><td>1<td>2</table>")]
    df = spark.createDataFrame(rows, "page_id bigint, html string").withColumn("text", F.lit("clash")).withColumn("n_lines", F.lit(-1))
    got = sorted((r["page_id"] or 0, r["text"]) for r in html_text.extract_pages(df).collect())
    assert got == [(0, "a"), (1, ""), (1, ""), (2, "deep"), (3, ""), (4, "1  2")]
    assert html_text.extract_pages(df.limit(0)).collect() == []


@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_stage_on_odd_rows(spark, stage):
    name, fn = corpus_pipeline.STAGES[stage]
    docs = table(spark, ROWS)
    got = fn(spark, docs, SF)
    if name != "packing":
        assert got.columns == docs.columns
    rows = got.collect()
    assert fn(spark, table(spark, []), SF).collect() == []
    if name == "exact_dedup":
        assert sorted(r["doc_id"] or 0 for r in rows) == [0, 3, 5, 6, 7, 8, 9]  # of the empty texts, the longest before blanks go
    if name != "packing":
        assert all(r[c] == f"clash-{c}" for r in rows for c in CLASH)
    if name == "near_dedup":
        assert sorted(r["doc_id"] or 0 for r in rows) == [0, 0, 1, 2, 3, 4, 4, 6, 7, 8, 9]


def test_models_without_labels(spark):
    docs = spark.createDataFrame([(1, "a few words of text to look at in this row")], "doc_id bigint, text string")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, toxic int").withColumn("quality", F.col("toxic"))
    assert toxicity.score(docs, toxicity.fit(docs, none)).first()["predicted"] == 0
    assert quality_rules.apply_rules(docs, quality_rules.fit(docs, none)).first()["probability"] == pytest.approx(0.5)
    assert hashed.BITS == 18
