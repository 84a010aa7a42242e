"""Tiles that are measured together, and classes of scenes without repeated work."""

import numpy as np
import pytest
from helpers import raster
from pyspark.sql import functions as F
from skyframe.operators import learn, tiles
from skyframe.plans import classification

RNG = np.random.default_rng(31)


@pytest.fixture
def no_small_tables(spark):
    """What Catalyst sees of tables that are large."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(bands, present, name, h, w):
    return [(name, int(r), int(c), h, w, *(None if np.isnan(v) else float(v) for v in bands[:, r, c])) for r, c in zip(*np.nonzero(present), strict=True)]


@pytest.mark.parametrize("block", [1, 150, 1 << 16])
def test_tiles_of_a_block_do_not_touch_each_other(spark, monkeypatch, block):
    monkeypatch.setattr(tiles, "BLOCK", block)
    rows, alone = [], {}
    for k, (h, w) in enumerate([(8, 8)] * 9 + [(5, 7)] * 4 + [(16, 16)] * 2):
        bands, present = RNG.random((3, h, w)), RNG.random((h, w)) < (1.0 if k % 3 == 0 else 0.7)
        present[0, 0] = True
        bands[:, ~present] = np.nan
        bands[1, 0, 0] = np.nan if k % 2 else 0.5
        name = None if k == 4 else f"t{k}"
        rows += rows_of(bands, present, name, h, w)
        alone[name] = tiles.tile_values(bands[None], present[None])[0]
    df = spark.createDataFrame([rows[i] for i in RNG.permutation(len(rows))], "tile_id string, r int, c int, height int, width int, red double, green double, blue double")
    out = tiles.patch_features(df.repartition(3))
    assert "FlatMapGroups" not in plan_of(out)
    got = {r["tile_id"]: r["features"] for r in out.collect()}
    assert got.keys() == alone.keys()
    assert all(np.array_equal(got[k], alone[k]) for k in alone)


@pytest.mark.parametrize(("tile", "stride"), [(8, 8), (8, 11), (5, 5), (8, 5)])
def test_pixels_meet_their_tiles_without_a_shuffle(spark, no_small_tables, tile, stride):
    h, w = 23, 30
    cells = spark.range(-w, (h + 2) * w).selectExpr("'s' AS scene_id", f"int(floor(id / {w})) AS r", f"int(pmod(id, {w})) AS c")
    out = tiles.tile_pixels(cells, spark.createDataFrame([("s", w, h)], "scene_id string, width int, height int"), tile, stride)
    plan = plan_of(out)
    assert "Exchange hashpartitioning" not in plan and ("Generate" in plan) == (stride < tile)
    want = {(r, c, y, x) for y in range(0, h - tile + 1, stride) for x in range(0, w - tile + 1, stride) for r in range(y, y + tile) for c in range(x, x + tile)}
    got = [tuple(r) for r in out.select("r", "c", "tile_r", "tile_c").collect()]
    assert len(got) == len(want) and set(got) == want


def test_split_rows_are_not_shuffled(spark, no_small_tables):
    rows = spark.range(400).selectExpr("id AS tile_id", "id % 3 AS label", "array(double(id)) AS features")
    split = learn.stratified_split(rows, "label", "tile_id", in_place=True)
    assert "Exchange hashpartitioning" not in plan_of(split)
    assert split.count() == 400 and not split.exceptAll(learn.stratified_split(rows, "label", "tile_id")).count()


def test_tiles_are_classified_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def predicted(model, rows):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        named = rows.select("tile_id", F.lit("Forest").alias("predicted"), F.lit(0.5).alias("confidence"))
        return named.mapInArrow(run, named.schema)

    monkeypatch.setattr(learn, "predict", predicted)
    cells = raster(spark, {b: RNG.random((32, 32)) for b in ("red", "green", "blue")}).where("NOT (r < 8 AND c < 4) AND NOT (r < 8 AND c >= 24 AND c < 28)")
    grid = spark.createDataFrame([("s", 32, 32, 70.0, 20.0, 71.0, 21.0)], "scene_id string, width int, height int, west double, south double, east double, north double")
    out = classification.classify_scenes(cells, grid, None, tile=8)
    assert [(r["tiles"], r["dominant_class"]) for r in out.collect()] == [(14, "Forest")]
    assert out.count() == 1 and seen.value == 16
    # a limit leaves only the chosen tiles to be measured
    few = classification.classify_scenes(cells, grid, None, tile=8, max_tiles=5)
    assert few.first()["tiles"] == 5 and seen.value == 21
