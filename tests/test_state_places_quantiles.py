"""State of the best scene over restarts, place lookup without n-grams, quantiles of crowded value ranges."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe import streaming
from skyframe.operators import lexicon, stats

DAY = datetime.date
SCENES = "aoi string, scene_id bigint, usable_fraction double, acq_date date"


def arrive(spark, folder, n, rows):
    spark.createDataFrame(rows, SCENES).coalesce(1).write.parquet(f"{folder}/f{n}")


def stream(spark, folder):
    return spark.readStream.schema(SCENES).option("recursiveFileLookup", True).parquet(str(folder))


def batches(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["batch"], {})[r["aoi"]] = r["scene_id"]
    return out


def test_a_restart_only_writes_changed_areas(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "state")
    arrive(spark, source, 0, [("a", 1, 0.5, DAY(2024, 1, 1)), ("b", 2, 0.6, DAY(2024, 1, 1)), ("c", 3, 0.1, DAY(2024, 1, 1)), ("a", 4, 0.5, DAY(2024, 1, 2))])

    def run():
        return streaming.run_to_table(streaming.latest_usable_scene(stream(spark, source)), "t", "update", root)

    assert batches(run()) == {0: {"a": 4, "b": 2}}
    arrive(spark, source, 1, [("b", 5, 0.9, DAY(2023, 1, 1)), ("a", 6, 0.4, DAY(2024, 5, 1)), ("d", 7, 0.3, DAY(2024, 1, 1))])
    assert batches(run()) == {0: {"a": 4, "b": 2}, 1: {"b": 5, "d": 7}}
    everything = spark.read.schema(SCENES).option("recursiveFileLookup", True).parquet(str(source))
    want = {tuple(r) for r in streaming.latest_usable_scene(everything).collect()}
    assert {tuple(r) for r in streaming.latest(run(), "aoi").collect()} == want


def test_areas_without_scenes_are_forgotten(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "state")

    def run():
        return batches(streaming.run_to_table(streaming.latest_usable_scene(stream(spark, source), keep_days=30), "t", "update", root))

    arrive(spark, source, 0, [("a", 1, 0.9, DAY(2024, 1, 1)), ("b", 2, 0.5, DAY(2024, 1, 1))])
    run()
    arrive(spark, source, 1, [("b", 3, 0.6, DAY(2024, 6, 1))])
    run()
    arrive(spark, source, 2, [("b", 4, 0.7, DAY(2024, 6, 5)), ("a", 5, 0.4, DAY(2024, 6, 5))])
    got = run()
    assert {k: v for rows in got.values() for k, v in rows.items()} == {"a": 5, "b": 4}


def test_an_empty_source_has_no_scenes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = streaming.run_to_table(streaming.latest_usable_scene(stream(spark, tmp_path / "in")), "t", "update")
    assert streaming.latest(out, "aoi").collect() == []


PLACES = "ord int, name string, west double, south double, east double, north double, kind string, country string, aliases array<string>"


@pytest.fixture(scope="module")
def places(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    rows = [(0, "Delta", *box, "x", "x", []), (1, "Nile Delta", *box, "x", "x", ["the delta of the nile"]), (2, "Goa", *box, "x", "x", ["old goa"]), (3, "Gao", *box, "x", "x", ["goa town"]),
            (4, "Oman", *box, "x", "x", []), (5, "Iran", *box, "x", "x", [])]
    return spark.createDataFrame(rows, PLACES)


ASKED = [(1, "Floods in the Nile Delta?"), (2, "the delta"), (3, "delta of the nile: water"), (4, "nothing here"), (5, None), (6, ""), (7, "Iran Oman"), (8, "goa town and old goa"),
         (9, "nile deltas and a deltaic plain"), (10, "water in the DELTA of the Nile, the delta of the nile")]


@pytest.mark.parametrize("room", [lexicon.AUTOMATON_BYTES, 0])
def test_longest_place_of_each_question(spark, places, room):
    asked = spark.createDataFrame(ASKED, "question_id int, text string")
    got = {r["question_id"]: r["name"] for r in lexicon.resolve_place(asked, places, automaton_bytes=room).collect()}
    assert got == {1: "Nile Delta", 2: "Delta", 3: "Delta", 7: "Oman", 8: "Gao", 10: "Nile Delta"}


@pytest.mark.parametrize("room", [lexicon.AUTOMATON_BYTES, 0])
def test_a_text_of_a_million_words(spark, places, room):
    long = spark.range(1).select(F.lit(1).alias("question_id"), F.concat(F.repeat(F.lit("the of "), 500_000), F.lit("goa")).alias("text"))
    assert [r["name"] for r in lexicon.resolve_place(long, places, automaton_bytes=room).collect()] == ["Goa"]


def test_no_n_gram_is_shuffled(spark, places):
    asked = spark.createDataFrame(ASKED, "question_id int, text string")
    plan = lexicon.resolve_place(asked, places)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "array_join" not in plan and "slice(" not in plan


@pytest.mark.parametrize("shape", ["narrow", "ties", "wide"])
def test_quantiles_of_crowded_ranges(spark, monkeypatch, shape):
    monkeypatch.setattr(stats, "RANKED", 500)
    monkeypatch.setattr(stats, "PARTS", 16)
    rng = np.random.default_rng(3)
    v = {"narrow": 1 + rng.random(20_000) * 1e-4, "ties": np.repeat([1.0, 1.00001, 1.00002], [9000, 2, 9000]), "wide": rng.normal(size=20_000) * np.exp(rng.normal(size=20_000) * 3)}[shape]
    df = spark.createDataFrame([("k", float(x)) for x in v] + [("few", 1.0), ("few", 3.0)], "g string, v double")
    probs = {"p02": 0.02, "p50": 0.5, "p51": 0.51, "p98": 0.98, "lo": 0.0, "hi": 1.0}
    got = {r["g"]: r for r in stats.exact_quantiles(df, ["g"], "v", probs).collect()}
    for name, p in probs.items():
        assert got["k"][name] == pytest.approx(np.quantile(v, p), rel=1e-14)
        assert got["few"][name] == 1 + 2 * p


def test_a_million_values_in_one_bucket(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("g"), (F.lit(1.0) + (F.col("id") * 7919 % 1_000_000) * 1e-10).alias("v"))
    widest = []
    plain = stats.materialise

    def seen(table, label):
        out = plain(table, label)
        if label == "quantile_buckets":
            widest.append(out.agg(F.max("_n")).first()[0])
        return out

    stats.materialise = seen
    try:
        got = stats.exact_quantiles(df, ["g"], "v", {"m": 0.5}).first()["m"]
    finally:
        stats.materialise = plain
    assert got == pytest.approx(1 + 499_999.5e-10, abs=1e-15)
    assert widest[0] > stats.RANKED >= widest[-1]
