"""Nothing is cut off: long place names, several areas, scenes with holes, requests without facts."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from helpers import half_water, raster
from skyframe.functions.text import geocodable_terms
from skyframe.operators import landcover, lexicon, pairing
from skyframe.plans import answers

DAY = datetime.date


def test_place_names_of_any_length(spark):
    places = spark.createDataFrame([(0, "Andaman and Nicobar Islands Territory", 92.0, 6.0, 94.0, 14.0, "territory", "India", []), (1, "Islands", 0.0, 0.0, 1.0, 1.0, "x", "x", [])],
                                   "ord int, name string, west double, south double, east double, north double, kind string, country string, aliases array<string>")
    asked = spark.createDataFrame([(1, "What changed in the Andaman and Nicobar Islands Territory since 2020?")], "question_id int, text string")
    assert [r["name"] for r in lexicon.resolve_place(asked, places).collect()] == ["Andaman and Nicobar Islands Territory"]


def probes(spark):
    rows = [("A", "p", DAY(2024, 1, 10), 0.9, 0.1, 0.0), ("B", "p", DAY(2024, 1, 12), 0.8, 0.3, 0.0)]
    return spark.createDataFrame(rows, "area string, layer_key string, probe_date date, coverage double, cloud_fraction double, dark_fraction double")


def test_each_area_gets_its_own_date(spark):
    asked = spark.createDataFrame([(1, "A", DAY(2024, 1, 11)), (2, "B", DAY(2024, 1, 11)), (3, "C", DAY(2024, 1, 11))], "request_id int, area string, anchor date")
    optical = pairing.search_optical(asked, probes(spark), primary="p", fallback="q", area=("area",))
    want = {1: DAY(2024, 1, 10), 2: DAY(2024, 1, 12), 3: None}
    assert {r["request_id"]: r["selected"] for r in optical.collect()} == want
    radar = pairing.search_sar(asked.withColumn("anchor", F.lit(DAY(2024, 1, 4))), probes(spark), area=("area",))
    assert {r["request_id"]: r["selected"] for r in radar.collect()} == {1: DAY(2024, 1, 10), 2: None, 3: None}


def test_a_scene_goes_one_way_as_a_whole(spark):
    px = raster(spark, half_water(32)).withColumn("nir", F.when(F.col("c") % 4 != 0, F.col("nir")))
    out = landcover.segment_any(px)
    assert {r["basis"] for r in out.select("basis").distinct().collect()} == {"multispectral"}
    assert out.count() == 32 * 24
    assert np.isclose(out.where("class = 'water'").count() / out.count(), 0.5, atol=0.06)


def test_stop_words_leave_names_whole(spark):
    asked = spark.createDataFrame([("Show floods near Chilika Lake",), ("cyclones and landslides in the Thar Desert",)], "text string")
    assert [r[0] for r in asked.select(geocodable_terms(F.col("text"))).collect()] == ["chilika lake", "thar desert"]


def test_requests_without_facts_stay(spark):
    requests = spark.createDataFrame([(1, "archive", "Goa", DAY(2024, 1, 1), 64, 64, True, "caption", [DAY(2024, 1, 1)])],
                                     "request_id int, source string, place string, acq_date date, width int, height int, in_domain boolean, task string, dates array<date>")
    facts = spark.createDataFrame([], "request_id int, fact_key string, value_num double, value_str string, unit string, ord int, confidence double, tool string")
    assert [r["request_id"] for r in answers.caption(requests, facts).collect()] == [1]
    assert [r["request_id"] for r in answers.narrate(requests, facts).collect()] == [1]


def test_a_summary_of_change_plans_nothing_else(spark):
    from helpers import BANDS, scene_row
    from test_spatial import change_pair

    from skyframe.plans import change_analysis

    px, pairs = change_pair(spark)
    out = change_analysis.change_analysis(px, pairs, scene_row(spark, 64, 64, "p", (70.0, 20.0, 71.0, 21.0), "pair_id"), list(BANDS))
    assert out.made == [] and list(out) == ["summary", "transitions", "class_deltas", "delta_stats", "regions", "facts"]
    out["summary"].collect()
    assert set(out.made) == {"co_observed", "gate", "both", "cuts", "measured", "summary"}
    out["transitions"].collect()
    assert "regions" not in out.made and len(out) == 6


def test_every_transition_of_a_pair_stays(spark):
    from skyframe.fixed_values import CLASSES
    from skyframe.operators.change import transition_matrix

    counts = spark.createDataFrame([("p", a, b, 10 * i + j + 1) for i, a in enumerate(CLASSES) for j, b in enumerate(CLASSES)],
                                   "pair_id string, from_class string, to_class string, pixels bigint")
    km2 = spark.createDataFrame([("p", 0.5)], "pair_id string, pixel_km2 double")
    assert transition_matrix(counts, km2, None).count() == len(CLASSES) ** 2
    assert transition_matrix(counts, km2).count() == len(CLASSES) + 8


def test_a_written_table_of_many_rows_is_not_sent_out(spark, monkeypatch):
    from skyframe.operators import stats

    monkeypatch.setattr(stats, "SENT", 2)
    rows = spark.range(4000).selectExpr("id % 5 AS k", "double(id) AS v")
    out = stats.exact_quantiles(rows, ["k"], "v", {"q": 0.5})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    assert {r["k"]: r["q"] for r in out.collect()} == {k: 1997.5 + k for k in range(5)}


def test_stop_words_are_looked_up_in_a_set(spark):
    words = spark.createDataFrame([("floods in the Thar Desert",)], "text string").select(geocodable_terms(F.col("text")).alias("t"))
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan and "array_contains" not in plan
