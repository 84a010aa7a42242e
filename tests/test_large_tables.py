"""Plans and tasks that stay whole and bounded on larger tables."""

import contextlib
import io

import numpy as np

from helpers import half_water, raster
from pyspark.sql import functions as F
from skyframe.operators import landcover, radar
from skyframe.sources import tiff
from workload import ingest_queries


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_files_are_divided_and_pixels_meet_no_band_key(spark, tmp_path):
    cube = np.random.default_rng(5).integers(1, 60_000, (400, 500, 5)).astype("u2")
    for k in range(6):
        (tmp_path / f"{k}.tif").write_bytes(tiff.encode(cube))
    _, px = tiff.scan_tiff(spark, str(tmp_path))
    assert px.rdd.getNumPartitions() >= 6
    named = ingest_queries.named_bands(px.where("valid"))
    assert "hashpartitioning" not in plan_of(named)
    counts = {(r["scene_id"], r["band"]): r["count"] for r in named.groupBy("scene_id", "band").count().collect()}
    assert len(counts) == 30 and set(counts.values()) == {cube[..., 0].size}


def test_pixels_are_routed_without_a_shuffle(spark):
    px = raster(spark, half_water(32))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # what Catalyst sees of a table whose pixels are many
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labels = landcover.segment_any(px)
        assert "BroadcastHashJoin" in plan_of(labels)
        assert {r["class"]: r["count"] for r in labels.groupBy("class").count().collect()}["water"] == 512
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scores_are_rounded_once(spark, monkeypatch):
    plans = []
    quantiles = radar.exact_quantiles
    monkeypatch.setattr(radar, "exact_quantiles", lambda df, *a, **k: plans.append(plan_of(df)) or quantiles(df, *a, **k))
    gray = np.random.default_rng(6).random((32, 32))
    cells = raster(spark, {"gray": gray}).withColumns({"width": F.lit(32), "height": F.lit(32)})
    out, _ = radar.sar_segment(cells)
    assert len(plans) == 2 and "round(" not in plans[1] and "round(" not in plan_of(out)
    assert out.count() == 1024


def test_a_split_computes_its_rows_once(spark):
    from skyframe.operators import learn

    seen = spark.sparkContext.accumulator(0)

    def features(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(40).selectExpr("id AS tile_id", "id % 2 AS label").mapInArrow(features, "tile_id long, label long")
    assert learn.stratified_split(rows, "label", "tile_id").groupBy("label").count().count() == 2
    assert seen.value == 40
