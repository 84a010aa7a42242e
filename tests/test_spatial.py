from collections import deque

import numpy as np
import pytest
from helpers import BANDS, grid, half_water, raster, scene_row
from pyspark.sql import functions as F

from skyframe.functions.indices import index_expr
from skyframe.operators import change, components, focal, pairing, radar
from skyframe.plans import change_analysis, regions
from skyframe.sources import sinks

RNG = np.random.default_rng(11)


def sized(px, h, w):
    return px.withColumns({"height": F.lit(h), "width": F.lit(w)})


def padded_box(a, k, mode):
    p = np.pad(a, k // 2, mode=mode)
    return np.array([[p[i:i + k, j:j + k] for j in range(a.shape[1])] for i in range(a.shape[0])])


@pytest.mark.parametrize("k", [3, 5, 7])
def test_box_mean_repeats_the_edge(spark, k):
    a = RNG.random((9, 12))
    out = focal.box_mean(sized(raster(spark, {"v": a}), 9, 12), "v", k, "m")
    assert np.allclose(grid(out, "m", a.shape), padded_box(a, k, "symmetric").mean((2, 3)))


@pytest.mark.parametrize("k", [3, 7, 15])
def test_local_std_reflects_without_repeating(spark, k):
    a = RNG.random((16, 11))
    out = focal.local_std(sized(raster(spark, {"v": a}), 16, 11), "v", {"sd": k, "other": 5})
    assert np.allclose(grid(out, "sd", a.shape), padded_box(a, k, "reflect").std((2, 3)), atol=1e-7)


def test_gradient_matches_numpy(spark):
    a = RNG.random((6, 7))
    out = focal.gradient(raster(spark, {"v": a}), "v")
    gy, gx = np.gradient(a)
    assert np.allclose(grid(out, "gy", a.shape), gy) and np.allclose(grid(out, "gx", a.shape), gx)


def test_lee_filter_uses_the_whole_image(spark):
    a = RNG.random((10, 10))
    out = focal.lee_filter(sized(raster(spark, {"v": a}), 10, 10), "v")
    box = padded_box(a, 5, "symmetric")
    m, var = box.mean((2, 3)), box.var((2, 3))
    assert np.allclose(grid(out, "filtered", a.shape), m + var / np.maximum(var + a.var(), 1e-6) * (a - m))


def square(mask, grow):
    p = np.pad(mask, 1, constant_values=False)
    win = np.array([[p[i:i + 3, j:j + 3] for j in range(mask.shape[1])] for i in range(mask.shape[0])])
    return win.any((2, 3)) if grow else win.all((2, 3))


def test_morphology_equals_four_plain_steps(spark):
    m = RNG.random((20, 17)) < 0.6
    want = square(square(square(square(m, True), False), False), True)
    px = sized(raster(spark, {"v": m.astype(float)}), 20, 17).withColumn("m", F.col("v") > 0.5)
    got = grid(focal.morphology(px, "m").withColumn("m", F.col("m").cast("int")), "m", m.shape)
    assert np.array_equal(got.astype(bool), want)


def flood(mask):
    """First-cell label of every 8-connected component."""
    out = {}
    for start in zip(*np.nonzero(mask)):
        if start in out:
            continue
        queue, out[start] = deque([start]), start
        while queue:
            y, x = queue.popleft()
            for n in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n] and n not in out:
                    out[n] = start
                    queue.append(n)
    return out


def cells(spark, mask, scene="s"):
    rows = [(scene, int(r), int(c)) for r, c in zip(*np.nonzero(mask))]
    return spark.createDataFrame(rows, "scene_id string, r int, c int")


@pytest.mark.parametrize("density", [0.2, 0.45, 0.7])
def test_components_against_flood_fill(spark, density):
    m = RNG.random((40, 150)) < density
    got = components.connected_components(cells(spark, m), ["scene_id"]).collect()
    assert {(r.r, r.c): (r.component >> 32, r.component & 0xFFFFFFFF) for r in got} == {
        k: tuple(map(int, v)) for k, v in flood(m).items()}


def test_components_of_a_spiral_and_of_separate_scenes(spark):
    m = np.zeros((21, 21), bool)
    y = x = 0
    dy, dx, step = 0, 1, 20
    m[0, 0] = True
    for leg in range(20):
        for _ in range(step):
            y, x = y + dy, x + dx
            m[y, x] = True
        dy, dx = dx, -dy
        if leg % 2 == 0 and leg > 0:
            step -= 2
        if step <= 0:
            break
    both = cells(spark, m, "a").unionByName(cells(spark, m, "b"))
    assert components.connected_components(both, ["scene_id"]).select("scene_id", "component").distinct().count() == 2


def test_two_squares_are_two_located_regions(spark):
    m = np.zeros((40, 40), bool)
    m[5:15, 5:15] = m[25:35, 25:35] = True
    ranked = components.rank_regions(components.region_stats(components.connected_runs(cells(spark, m), ["scene_id"]), ["scene_id"]), ["scene_id"])
    rows = components.locate_regions(ranked, scene_row(spark, 40, 40, box=(70.0, 20.0, 71.0, 21.0)), ["scene_id"]).collect()
    assert len(rows) == 2 and all(r.pixels == 100 and r.fill_ratio == 1.0 for r in rows)
    assert all(70 < r.lon < 71 and 20 < r.lat < 21 and r.area_km2 > 0 for r in rows)


def test_no_coordinates_are_invented(spark):
    m = np.ones((8, 8), bool)
    ranked = components.rank_regions(components.region_stats(components.connected_runs(cells(spark, m), ["scene_id"]), ["scene_id"]), ["scene_id"])
    located = components.locate_regions(ranked, scene_row(spark, 8, 8), ["scene_id"])
    row = located.first()
    assert row.lon is None and row.area_km2 is None and row.unit == "pixels"
    assert sinks.geojson(located, "x").isEmpty()


def test_speckle_only_mask_stays_raw(spark):
    m = np.zeros((20, 20), bool)
    m[3, 3] = m[10, 12] = True
    runs = regions.clean_mask(cells(spark, m), scene_row(spark, 20, 20), ["scene_id"])
    assert runs.count() == 2 and runs.first().unfiltered


def change_pair(spark, planted=True):
    before = half_water()
    after = {b: v.copy() for b, v in before.items()}
    if planted:
        after["nir"][50:60, 10:30], after["red"][50:60, 10:30] = 0.05, 0.30
    px = raster(spark, before, "a").unionByName(raster(spark, after, "b"))
    pairs = spark.createDataFrame([("p", "a", "b")], "pair_id string, first_id string, second_id string")
    return px, pairs


def test_planted_change_is_found_with_its_direction(spark):
    px, pairs = change_pair(spark)
    out = change_analysis.change_analysis(px, pairs, scene_row(spark, 64, 64, "p", (70.0, 20.0, 71.0, 21.0), "pair_id"), list(BANDS))
    summary = out["summary"].first()
    assert summary.changed_pixels >= 180 and summary.overlap == 1.0
    ndvi = out["delta_stats"].where("metric = 'NDVI'").first()
    assert ndvi["mean"] < 0
    region = out["regions"].first()
    assert region.direction == "decrease" and region.pixels == 200
    facts = {r.fact_key: r.value_num for r in out["facts"].collect()}
    assert facts["change_pixels"] == summary.changed_pixels and facts["coobserved_pixels"] == 4096


def test_identical_dates_show_no_change(spark):
    px, pairs = change_pair(spark, planted=False)
    both = pairing.co_observe(px, pairs, list(BANDS))
    out, _ = change.change_vector_analysis(both, list(BANDS))
    assert out.where("changed").isEmpty()


def test_radar_water_share(spark):
    a = np.full((64, 64), 180.0)
    a[:20] = 8
    px = sized(raster(spark, {"gray": a / 255}), 64, 64)
    out, _ = radar.sar_segment(px)
    assert abs(radar.sar_stats(out).first().water_fraction - 20 / 64) < 0.08


def test_fusion_counts_water_under_cloud(spark):
    r = np.arange(32)[:, None] * np.ones((32, 32))
    flags = raster(spark, {"r0": r}).select(
        "scene_id", "r", "c", (F.col("r") < 10).alias("optical_water"), ((F.col("r") < 10) | F.col("r").between(20, 23)).alias("sar_water"),
        F.col("r").between(20, 23).alias("cloud"))
    km2 = spark.createDataFrame([("s", 0.01)], "scene_id string, pixel_km2 double")
    s = radar.fusion_stats(radar.fuse_water(flags), km2).first()
    assert s.cloud_recovered_pixels == 4 * 32 and s.fused_water_pixels == 14 * 32 and 0 < s.iou < 1


def test_region_direction_counts_the_box(spark):
    m = np.zeros((12, 12), bool)
    m[0, :10] = m[:10, 0] = True
    m[5, 5] = True
    px = cells(spark, m).withColumn("delta", F.when((F.col("r") == 5) & (F.col("c") == 5), 19.0).otherwise(-1.0))
    out = regions.change_regions(px, scene_row(spark, 12, 12), ["scene_id"], min_pixels=5).first()
    assert out.mean_delta == pytest.approx(0.0) and out.component_delta == -1.0
    assert index_expr("NDVI") is not None
