"""Nested records written as a stream of pieces."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from skyframe.sources import sinks


def read_back(folder):
    text = "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))
    out, at, decoder = [], 0, json.JSONDecoder()
    while at < len(text):
        record, at = decoder.raw_decode(text, at)
        out.append(record)
        while at < len(text) and text[at].isspace():
            at += 1
    return out


def tables(spark, n):
    plans = spark.createDataFrame([(1, "caption"), (2, None), (3, "say \"hi\"\n")], "request_id int, task string")
    trace = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (9, 1, "of no request")], "request_id int, step int, tool string")
    facts = spark.range(n).select(F.lit(1).alias("request_id"), (F.lit(n - 1) - F.col("id")).alias("ord"), F.concat(F.lit("k"), F.col("id")).alias("fact_key"), (F.col("id") / 2).alias("value_num"))
    facts = facts.unionByName(spark.createDataFrame([(3, 0, "only", None)], "request_id int, ord bigint, fact_key string, value_num double"))
    provenance = spark.createDataFrame([(1, 0, "x"), (1, 0, "x"), (3, None, "y")], "request_id int, ord int, source string")
    grounding = spark.createDataFrame([(1, True)], "request_id int, passed boolean")
    return plans, trace, facts, provenance, grounding


def test_a_record_of_any_length(spark, tmp_path):
    n = 25_000
    sinks.write_records(sinks.record_pieces(*tables(spark, n)), str(tmp_path / "out"))
    records = read_back(tmp_path / "out")
    assert [r["request_id"] for r in records] == [1, 2, 3]
    one, two, three = records
    assert one["plan"] == {"task": "caption"} and one["execution_trace"] == [{"step": 1, "tool": "a"}, {"step": 2, "tool": "b"}]
    assert [f["ord"] for f in one["facts"]] == list(range(n)) and one["facts"][0] == {"ord": 0, "fact_key": f"k{n - 1}", "value_num": (n - 1) / 2}
    assert one["grounding"] == {"passed": True}
    assert two == {"request_id": 2, "plan": {"task": None}, "execution_trace": [], "facts": [], "provenance": [], "grounding": None}
    assert three["plan"]["task"] == "say \"hi\"\n" and three["facts"] == [{"ord": 0, "fact_key": "only", "value_num": None}] and three["provenance"] == [{"ord": None, "source": "y"}]


def test_equal_children_are_separated(spark, tmp_path):
    sinks.write_records(sinks.record_pieces(*tables(spark, 3)), str(tmp_path / "out"))
    assert read_back(tmp_path / "out")[0]["provenance"] == [{"ord": 0, "source": "x"}, {"ord": 0, "source": "x"}]


def test_no_request(spark, tmp_path):
    given = [t.limit(0) for t in tables(spark, 1)]
    assert sinks.record_pieces(*given).collect() == []
