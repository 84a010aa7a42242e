import datetime

import pytest
from pyspark.sql import functions as F

from skyframe.functions import text as T
from skyframe.operators import dates, facts, grounding, lexicon
from skyframe.plans import answers
from skyframe.sources import catalog

TODAY = datetime.date(2025, 11, 1)


@pytest.fixture(scope="module")
def plan(spark):
    """All questions of this module annotated in one job."""
    texts = [t for t, _ in TASKS] + [t for t, _ in EVENTS] + [t for t, _ in PLACES] + NO_PLACE
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "question_id int, text string")
    rows = lexicon.annotate_queries(df, catalog.gazetteer(spark), F.lit(TODAY)).collect()
    return {r.text: r for r in rows}


TASKS = [
    ("What changed around Chennai between January 2021 and October 2023?", "change_detection"),
    ("Has the water body increased or decreased near Patna?", "change_vqa"),
    ("Use the optical and SAR images together over Kolkata", "optical_sar_fusion"),
    ("Highlight the water body in Chilika Lake", "grounding"),
    ("Show the NDVI trend for Assam", "time_series"),
    ("Describe this scene", "caption"),
    ("What is the mean NDVI over Punjab?", "index_analysis"),
    ("How deep is it?", "vqa"),
]
EVENTS = [("Kerala floods 2025", "Flood / surface water"), ("California wildfire", "Wildfire / burn severity"),
          ("forest loss Amazon", "Forest loss"), ("Delhi air quality", "Air quality"), ("glacier retreat Ladakh", "Snow, ice and glacier change")]
PLACES = [("water in new delhi today", "Delhi"), ("Chilika lake extent", "Chilika Lake"), ("floods in West Bengal", "West Bengal"),
          ("crops in bengal", "West Bengal"), ("the Bay of Bengal", "Bay of Bengal"), ("Amazon Basin fires", "Amazon Basin")]
NO_PLACE = ["How much water is there?", "puneet likes maps", "highlight the water body"]


def test_tasks(plan):
    assert {t: plan[t].task for t, _ in TASKS} == dict(TASKS)


def test_events(plan):
    assert {t: plan[t].event for t, _ in EVENTS} == dict(EVENTS)
    assert plan["Delhi air quality"].unsupported and "out_of_scope_quantity" in plan["Delhi air quality"].ambiguities


def test_places_longest_name_wins(plan):
    assert {t: plan[t].aoi_name for t, _ in PLACES} == dict(PLACES)
    assert all(plan[t].aoi_name is None for t in NO_PLACE)


def test_short_flood_query_becomes_a_map_of_water(plan):
    row = plan["Kerala floods 2025"]
    assert row.task == "grounding" and row.target_classes == ["water"] and row.indices == ["MNDWI"]
    assert "flood / surface water" in row.interpretation and "Kerala" in row.interpretation


@pytest.mark.parametrize("text, want", [
    ("on 2024-03-05 please", ["2024-03-05"]),
    ("on 2024-02-31", ["2024-06-15"]),
    ("15 March 2024 and March 20, 2024", ["2024-03-15", "2024-03-20"]),
    ("in March 2024", ["2024-03-15"]),
    ("between January and October 2025", ["2025-01-15", "2025-10-15"]),
    ("monsoon 2024", ["2024-07-15"]),
    ("winter of 2019", ["2019-01-15"]),
    ("floods 2020 vs 2023", ["2020-06-15", "2023-06-15"]),
    ("in 1985", ["1985-06-15"]),
    ("in 2042", []),
    ("this year 2025", ["2025-10-02"]),
    ("yesterday", ["2025-10-30"]),
    ("last month", ["2025-10-02"]),
    ("3 years ago", ["2022-11-02"]),
    ("2025-12-25", ["2025-10-30"]),
    ("no date at all", []),
])
def test_dates(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    got = dates.extract_dates(df, "text", F.lit(TODAY)).first().dates
    assert [d.isoformat() for d in got] == want


def test_words(spark):
    def one(col):
        return spark.range(1).select(col).first()[0]

    assert one(T.normalise_text(F.lit("Hey, can you   show me rice & wheat"))) == ", rice and wheat"
    assert one(T.fold_key(F.lit("Réunion-Île 2"))) == "reunion ile 2"
    assert [one(T.singularise(F.lit(w))) for w in ("cities", "boxes", "floods", "grass", "gas")] == ["city", "box", "flood", "grass", "gas"]
    assert one(T.geocodable_terms(F.lit("Kerala's floods 2025"))) == "kerala"
    assert one(T.geocodable_terms(F.lit("How much water is there?"))) == ""
    assert one(T.format_fact(F.lit(-1059.17), F.lit(None).cast("string"), F.lit("km2"))) == "-1,059.17 km²"
    assert one(T.format_fact(F.lit(3.5), F.lit(None).cast("string"), F.lit("percent"))) == "+3.50%"
    assert one(T.format_fact(F.lit(0.5), F.lit(None).cast("string"), F.lit(None).cast("string"), brief=True)) == "0.5"


STORE = [("water_fraction", 0.2841), ("water_area_km2", 1021.55), ("ndvi_mean", 0.3617), ("veg_delta_km2", -1059.17), ("zero", 0.0)]
CLAIMS = [
    ("Water covers 28.41% of the scene.", True), ("an area of 1,021.55 km²", True), ("Mean NDVI is 0.3617.", True),
    ("Vegetation shrank by 1,059.17 km2", True), ("about 28% water", True), ("Water covers 63.20% of the scene", False),
    ("an area of 4200 km²", False), ("on 2025-10-14 at 512x512 pixels, band 4, 10th percentile, EPSG:4326, P90", None),
    ("comparing 2 dates over 3 regions", None)]


@pytest.fixture(scope="module")
def audited(spark):
    n = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLAIMS)], "request_id int, text string")
    f = spark.createDataFrame([(i, j, k, v) for i in range(len(CLAIMS)) for j, (k, v) in enumerate(STORE)],
                              "request_id int, ord int, fact_key string, value_num double")
    out = {}
    for r in grounding.match_claims(grounding.extract_claims(n), f).collect():
        out.setdefault(r.request_id, []).append(r)
    return out


@pytest.mark.parametrize("i", range(len(CLAIMS)))
def test_numerals_are_traced(audited, i):
    want, rows = CLAIMS[i][1], audited.get(i, [])
    assert (rows == []) if want is None else (rows and all(r.verified is want for r in rows))


def test_first_fact_wins_and_bands_lose_nothing(spark):
    import random

    rnd = random.Random(3)
    targets = [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-4, 6) for _ in range(150)] + [0.0]
    claims = [t * (1 + rnd.uniform(-0.025, 0.025)) + rnd.uniform(-0.06, 0.06) for t in targets] + [0.0]
    f = spark.createDataFrame([(1, i, f"k{i}", t) for i, t in enumerate(targets)], "request_id int, ord int, fact_key string, value_num double")
    c = spark.createDataFrame([(1, i, str(v), v) for i, v in enumerate(claims)], "request_id int, claim_ord int, raw string, value double")

    def forms(v):
        yield v
        if v < 0:
            yield -v
        if -1 <= v <= 1:
            yield v * 100
            if v < 0:
                yield -v * 100
        if abs(v) >= 1000:
            yield v / 1000

    def expected(x):
        for i, t in enumerate(targets):
            if any((abs(x) < 1e-9) if g == 0 else abs(x - g) <= max(abs(g) * 0.02, 0.05) for g in forms(t)):
                return f"k{i}"
        return None

    got = {r.claim_ord: r.matched_fact for r in grounding.match_claims(c, f).collect()}
    assert got == {i: expected(x) for i, x in enumerate(claims)}


def test_rejected_text_gives_way_to_a_verified_fallback(spark):
    n = spark.createDataFrame([(1, "llm", "63.2% is water", "28.41% is water"), (2, "llm", "28.41% is water", "x")],
                              "request_id int, narrator string, text string, fallback string")
    f = spark.createDataFrame([(r, 0, "water_fraction", 0.2841) for r in (1, 2)], "request_id int, ord int, fact_key string, value_num double")
    p = spark.createDataFrame([(1, "a", "synthetic_demo"), (2, "a", "cached_satellite")], "request_id int, source string, origin string")
    out = {r.request_id: r for r in grounding.verify_narrations(n, f, p).collect()}
    assert out[1].narrator == "rejected_fallback_template" and out[1].passed and not out[1].all_sources_real
    assert out[2].narrator == "llm" and out[2].all_sources_real


def test_parameters(spark):
    rq = spark.createDataFrame([
        (1, "region_grounder", "max_regions", "9999"), (1, "region_grounder", "colour", "red"), (2, "spectral_index", "indices", "NDVI,FOO"),
        (3, "timeseries_analyzer", "index", "FOO"), (4, "sar_analyzer", "builtup_percentile", "12.5")], "request_id int, tool string, param string, value string")
    rows = {(r.request_id, r.param): (r.value, r.note) for r in facts.validate_parameters(rq, facts.param_rules(spark)).collect() if r.value}
    assert rows[1, "max_regions"][0] == "20" and (1, "colour") not in rows and rows[1, "min_pixels"] == ("40", "default")
    assert rows[2, "indices"][0] == "NDVI" and rows[3, "index"] == ("NDVI", "default") and rows[4, "builtup_percentile"][0] == "50.0"


def plans_and_facts(spark, text, task, classes, indices, rows):
    p = spark.createDataFrame([(1, text, task, classes, indices)], "request_id int, text string, task string, target_classes array<string>, indices array<string>")
    f = spark.createDataFrame([(1, i, k, k.replace("_", " ").capitalize(), float(v), None, u) for i, (k, v, u) in enumerate(rows)],
                              "request_id int, ord int, fact_key string, label string, value_num double, value_str string, unit string")
    return p, f


def test_yes_no_direction_answer(spark):
    p, f = plans_and_facts(spark, "Has the water increased?", "change_vqa", ["water"], [], [
        ("change_fraction", 0.1, "fraction"), ("water_delta_area_km2", -12.5, "km2"), ("water_relative_change_pct", -4.0, "percent")])
    row = answers.answer(p, f).first()
    assert row.answer.startswith("Yes — water decreased by 12.50 km² (-4.00% relative to the earlier date).")


def test_answer_refuses_without_a_matching_fact(spark):
    p, f = plans_and_facts(spark, "zzzz?", "vqa", [], [], [("raster_width", 64, "pixels")])
    row = answers.answer(p, f).first()
    assert row.status == "no_data" and row.answer is None


def test_substitute_index_answers_and_composition_fallback(spark):
    p, f = plans_and_facts(spark, "NDVI?", "index_analysis", [], ["NDVI"], [("vari_mean", 0.2, None)])
    assert answers.answer(p, f).first().primary_fact == "vari_mean"
    p, f = plans_and_facts(spark, "so?", "vqa", [], [], [("water_fraction", 0.2, "fraction"), ("bare_soil_fraction", 0.7, "fraction"), ("built_up_fraction", 0.01, "fraction")])
    assert [r.fact_key for r in answers.resolve_answers(p, f).orderBy("rank").collect()] == ["bare_soil_fraction", "water_fraction"]


@pytest.mark.parametrize("task", ["change_detection", "optical_sar_fusion", "time_series", "landcover"])
def test_narration_states_only_facts(spark, task):
    rows = [("change_fraction", 0.1234, "fraction"), ("change_area_km2", 55.5, "km2"), ("change_threshold", 0.0812, None), ("water_delta_area_km2", -7.25, "km2"),
            ("fusion_iou", 0.813, None), ("fusion_optical_water_fraction", 0.21, "fraction"), ("fusion_sar_water_fraction", 0.25, "fraction"),
            ("fusion_water_fraction", 0.27, "fraction"), ("ts_observations", 7, "dates"), ("ts_first", 0.31, None), ("ts_last", 0.35, None), ("ts_net_change", 0.04, None),
            ("ts_slope_per_year", 0.0125, None), ("ts_r2", 0.64, None), ("water_fraction", 0.4, "fraction"), ("bare_soil_fraction", 0.35, "fraction"),
            ("ndvi_mean", 0.2211, None), ("ndvi_p10", 0.1, None), ("ndvi_p90", 0.5, None), ("scene_area_km2", 11614, "km2"), ("raster_width", 64, "pixels")]
    p, f = plans_and_facts(spark, "q", task, ["water"], [], rows)
    f = f.unionByName(spark.createDataFrame([(1, 99, "ts_index", "Index", None, "NDVI", None)], f.schema))
    req = p.withColumns({"source": F.lit("the archive"), "place": F.lit("Patna"), "dates": F.array(F.lit(TODAY)), "width": F.lit(64), "height": F.lit(64), "in_domain": F.lit(True)})
    told = answers.narrate(req, f)
    assert told.first().text.startswith("The analysis used the archive over Patna")
    audit = grounding.match_claims(grounding.extract_claims(told), f).collect()
    assert len(audit) >= 4 and all(r.verified for r in audit)


def test_digest_never_places_an_unlocated_image(spark):
    p, f = plans_and_facts(spark, "q", "landcover", [], [], [("water_fraction", 0.4, "fraction")])
    req = p.withColumns({
        "source": F.lit("upload"), "place": F.lit("Body"), "dates": F.array().cast("array<date>"), "width": F.lit(8), "height": F.lit(8), "in_domain": F.lit(True),
        "status": F.lit("ok"), "bands": F.array(F.lit("red")), "warnings": F.array().cast("array<string>"), "checked": F.lit(0), "verified": F.lit(0), "is_upload": F.lit(True),
        "interpretation": F.lit("Analyse."), "confidence": F.lit(0.8), **{c: F.lit(None).cast("double") for c in ("west", "south", "east", "north")}})
    rows = {r.kind: r.points for r in answers.summarise(req, f).collect()}
    assert "location" not in rows and not any("Body" in s for pts in rows.values() for s in pts) and rows["findings"] == ["Water: 40.0%"]


def test_equal_texts_are_read_once(spark, monkeypatch):
    rows = [(1, "NDVI of Delhi in 2021"), (2, "NDVI of Delhi in 2021"), (3, None), (4, ""), (5, None), (6, "NDVI of Delhi in 2021")]
    df = spark.createDataFrame(rows, "question_id int, text string")
    read, plain = [], lexicon.extract_dates

    def counted(texts, *others):
        read.append(texts.count())
        return plain(texts, *others)

    monkeypatch.setattr(lexicon, "extract_dates", counted)
    out = {r.question_id: r for r in lexicon.annotate_queries(df, catalog.gazetteer(spark), F.lit(TODAY)).collect()}
    assert read == [3] and len(out) == 6
    assert [out[i].aoi_name for i in (1, 2, 6)] == ["Delhi"] * 3 and out[1].interpretation == out[6].interpretation
    assert [out[i].text for i in (3, 4, 5)] == [None, "", None] and {out[i].task for i in (3, 4, 5)} == {"caption"}


def test_answers_send_no_table_of_requests_through_the_driver(spark):
    from skyframe.session import materialise

    plans = materialise(spark.range(50).selectExpr("id AS request_id", "'How much water is there?' AS text", "array('water') AS target_classes", "array() AS indices", "'vqa' AS task")
                        .withColumn("indices", F.col("indices").cast("array<string>")), "plans")
    facts_ = materialise(spark.range(50).selectExpr("id AS request_id", "0 AS ord", "'water_fraction' AS fact_key", "'Water share' AS label", "0.25D AS value_num",
                                                    "string(null) AS value_str", "'fraction' AS unit"), "facts")
    for out in (answers.resolve_answers(plans, facts_), answers.answer(plans, facts_)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.answer for r in out.collect()} == {"Water share: 25.00%."}


def test_digest_is_compiled_and_takes_the_latest_facts(spark):
    schema = "request_id int, ord int, fact_key string, label string, value_num double, value_str string, unit string"
    f = spark.createDataFrame([(1, 0, "water_fraction", "w", 0.9, None, None), (1, 3, "water_fraction", "w", 0.4, None, None), (1, 1, "bare_soil_fraction", "b", 0.4, None, None),
                               (1, 2, "built_up_fraction", "u", 0.02, None, None), (1, 4, "ts_index", "i", None, "NDWI", None), (1, 5, "ts_index", "i", None, "NDVI", None),
                               (1, 6, "ts_observations", "n", 7.0, None, None), (2, 0, "raster_width", "r", 64.0, None, None)], schema)
    req = spark.createDataFrame([(1, "time_series"), (2, "landcover")], "request_id int, task string").withColumns({
        "source": F.lit("s"), "place": F.lit("Goa"), "dates": F.array(F.lit(TODAY)), "width": F.lit(8), "height": F.lit(8), "status": F.lit("ok"), "bands": F.array(F.lit("red")),
        "warnings": F.array().cast("array<string>"), "checked": F.lit(0), "verified": F.lit(0), "is_upload": F.lit(False), "target_classes": F.array().cast("array<string>"),
        "interpretation": F.lit("Analyse."), "confidence": F.lit(0.8), **{c: F.lit(None).cast("double") for c in ("west", "south", "east", "north")}})
    out = answers.summarise(req, f)
    rows = {(r.request_id, r.kind): r.points for r in out.collect()}
    assert rows[1, "findings"] == ["NDVI across 7 usable dates", "Water: 40.0%", "Bare soil: 40.0%"] and rows[1, "detected"] == ["Water (40%)", "Bare soil (40%)"]
    assert (2, "findings") not in rows and rows[2, "geo"] == ["No geographic metadata in this image", "Sizes reported in pixels, not km²"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    # sections are not evaluated inside the generator, nor a second time by a filter, and numbers need no sort
    assert "inline(array(" not in plan and "size(array(struct" not in plan
    assert all("max_by(value_num" not in line for line in plan.splitlines() if "SortAggregate" in line)
    assert any("max_by(value_num" in line for line in plan.splitlines() if "HashAggregate" in line)
