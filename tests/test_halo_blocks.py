"""Tiles with a halo and block-wise components: results do not depend on where an image is cut."""

import re

import numpy as np
import pytest
from helpers import grid, raster, scene_row
from pyspark.sql import functions as F
from test_spatial import cells, flood, padded_box, sized, square

from skyframe.operators import components, focal, halo

RNG = np.random.default_rng(5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("tile", [7, 16])
def test_cut_does_not_change_any_value(spark, monkeypatch, tile):
    a, m = RNG.random((40, 53)), RNG.random((40, 53)) < 0.6
    px = sized(raster(spark, {"v": a, "w": m.astype(float)}), 40, 53).withColumn("m", F.col("w") > 0.5)

    def results():
        layers = focal.despeckled_texture(px, "v")
        std = focal.local_std(px, "v", {"s3": 3, "s15": 15})
        slope = focal.gradient(px, "v")
        mask = focal.morphology(px, "m").withColumn("m", F.col("m").cast("int"))
        return [grid(df, v, a.shape) for df, v in ((layers, "filtered"), (layers, "texture"), (std, "s3"), (std, "s15"), (slope, "gy"), (slope, "gx"), (mask, "m"))]

    whole = results()
    monkeypatch.setattr(halo, "TILE", tile)
    for x, y in zip(whole, results(), strict=True):
        assert np.array_equal(x, y) and not np.isnan(x).any()


def test_lee_then_texture_is_one_shuffle_of_pixels(spark):
    px = sized(raster(spark, {"v": RNG.random((6, 6))}), 6, 6).withColumn("label", F.lit("x"))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(focal.despeckled_texture(px, "v")))
    # pixels to tiles, values of images to tiles, and the map-combined sums of images
    assert len(exchanges) == 3 and sum("_tr" in e for e in exchanges) == 2
    assert len(re.findall("Exchange hashpartitioning", plan(focal.morphology(px.withColumn("m", F.lit(True)), "m")))) == 1


def test_cells_without_a_row_read_zero(spark):
    a = np.where(RNG.random((20, 31)) < 0.5, RNG.random((20, 31)), 0.0)
    px = sized(raster(spark, {"v": a}), 20, 31)
    dense, sparse = focal.lee_filter(px, "v"), focal.lee_filter(px.where("v > 0"), "v")
    want = grid(dense, "filtered", a.shape)
    assert np.allclose(grid(sparse, "filtered", a.shape)[a > 0], want[a > 0], atol=1e-12)
    box = padded_box(a, 5, "symmetric")
    mean, var = box.mean((2, 3)), box.var((2, 3))
    assert np.allclose(want, mean + var / np.maximum(var + a.var(), 1e-6) * (a - mean))


def test_nulls_and_empty_tables(spark):
    px = sized(raster(spark, {"v": np.ones((4, 4))}), 4, 4).withColumn("v", F.when(F.col("c") > 1, F.col("v")))
    # nulls read 0
    assert grid(focal.box_mean(px, "v", 3, "m"), "m", (4, 4))[1].tolist() == pytest.approx([0.0, 1 / 3, 2 / 3, 1.0])
    assert focal.despeckled_texture(px.limit(0), "v").collect() == []
    assert focal.smooth_cells(px.limit(0), scene_row(spark, 4, 4)).collect() == []


@pytest.mark.parametrize("tile", [9, 256])
def test_smooth_cells_equal_four_plain_steps(spark, monkeypatch, tile):
    monkeypatch.setattr(halo, "TILE", tile)
    m = RNG.random((30, 27)) < 0.6
    want = square(square(square(square(m, True), False), False), True)
    got = np.zeros_like(m)
    for row in focal.smooth_cells(cells(spark, m), scene_row(spark, 30, 27)).collect():
        assert not got[row.r, row.c]
        got[row.r, row.c] = True
    assert np.array_equal(got, want)


@pytest.mark.parametrize(("block", "fan", "density"), [(4, 2, 0.3), (8, 2, 0.5), (5, 3, 0.62), (16, 4, 0.45)])
def test_components_cut_into_blocks(spark, monkeypatch, block, fan, density):
    monkeypatch.setattr(components, "BLOCK", block)
    monkeypatch.setattr(components, "FAN", fan)
    m = RNG.random((70, 90)) < density
    got = components.connected_components(cells(spark, m), ["scene_id"]).collect()
    assert len(got) == m.sum()
    assert {(r.r, r.c): (r.component >> 32, r.component & 0xFFFFFFFF) for r in got} == {k: tuple(map(int, v)) for k, v in flood(m).items()}


def test_spiral_through_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", 4)
    monkeypatch.setattr(components, "FAN", 2)
    n = 41
    m = np.zeros((n, n), bool)
    lo, hi = 0, n - 1
    while lo <= hi:
        m[lo, lo:hi + 1] = m[lo:hi + 1, hi] = m[hi, lo:hi + 1] = True
        m[lo + 2:hi + 1, lo] = True
        m[lo + 2, lo:lo + 2] = True
        lo, hi = lo + 2, hi - 2
    got = components.connected_components(cells(spark, m), ["scene_id"])
    assert got.select("component").distinct().count() == len(set(flood(m).values())) == 1


def test_a_comb_with_a_hundred_thousand_teeth(spark):
    """One component over a whole image side: no group holds more than a block or its border lines."""
    n = 100_000
    comb = spark.range(2 * n).select(F.lit("s").alias("scene_id"), F.lit(0).alias("r"), F.col("id").cast("int").alias("c")).unionByName(
        spark.range(n).select(F.lit("s").alias("scene_id"), F.lit(1).alias("r"), (2 * F.col("id")).cast("int").alias("c")))
    runs = components.connected_runs(comb, ["scene_id"])
    assert runs.select("component").distinct().collect() == [(0,)]
    assert runs.agg(F.sum(F.expr("c1 - c0 + 1"))).first()[0] == 3 * n
    # a block of 256 columns holds two lines of it
    assert comb.groupBy(F.expr("c div 256")).count().agg(F.max("count")).first()[0] <= 2 * 256


def test_labels_of_one_block():
    r, c0, c1, label, _, _, _ = components.label_cells(np.array([0, 0, 0, 1, 5, 5, 0]), np.array([0, 1, 3, 2, 7, 8, 0]))
    assert list(zip(r, c0, c1, label)) == [(0, 0, 1, 0), (0, 3, 3, 0), (1, 2, 2, 0), (5, 7, 8, 5 * 2**32 + 7)]
