"""Which scenes are fused, and why others are not."""

import numpy as np
from helpers import half_water, raster, scene_row
from pyspark.sql import functions as F

from skyframe.plans import fusion

BOX = (70.0, 20.0, 71.0, 21.0)


def radar_of(spark, name, n=64, share=1.0):
    a = np.where(np.arange(n)[:, None] < n // 2, 0.03, 0.6) * np.ones((n, n))
    px = raster(spark, {"gray": a}, name).withColumns({"width": F.lit(n), "height": F.lit(n)})
    return px.where(F.col("r") < int(n * share))


def test_refusals_and_results(spark):
    optical = raster(spark, half_water(), "ok")
    for name in ("thin", "moved", "size", "alone"):
        optical = optical.unionByName(raster(spark, half_water(), name))
    radar = radar_of(spark, "ok").unionByName(radar_of(spark, "thin", share=0.016)).unionByName(radar_of(spark, "moved")).unionByName(radar_of(spark, "size", 32)).unionByName(
        radar_of(spark, "lost"))
    optical_scenes = scene_row(spark, 64, 64, "ok", BOX)
    for name in ("thin", "moved", "size", "alone"):
        optical_scenes = optical_scenes.unionByName(scene_row(spark, 64, 64, name, BOX))
    radar_scenes = scene_row(spark, 64, 64, "ok", BOX).unionByName(scene_row(spark, 64, 64, "thin", BOX)).unionByName(
        scene_row(spark, 64, 64, "moved", (70.1, 20.0, 71.1, 21.0))).unionByName(scene_row(spark, 32, 32, "size", BOX)).unionByName(scene_row(spark, 64, 64, "lost", BOX))
    out = fusion.fuse_scenes(optical, radar, optical_scenes, radar_scenes)
    status = {r["scene_id"]: (r["status"], r["reason"]) for r in out["status"].collect()}
    assert status == {"ok": ("ok", None), "thin": ("no_data", "both sensors observed only 1.6 % of the grid"), "moved": ("error", "corners lie apart by 0.100000 degrees"),
                      "size": ("error", "grids of different size"), "alone": ("skipped", "no radar scene"), "lost": ("skipped", "no optical scene")}
    assert {r["scene_id"] for r in out["stats"].collect()} == {"ok"}
    region = out["regions"].first()
    assert region["scene_id"] == "ok" and abs(region["pixels"] - 2048) < 150 and 70 < region["lon"] < 71
    facts = {r["fact_key"]: r["value_num"] for r in out["facts"].collect()}
    assert facts["fusion_coobserved_pixels"] == 4096 and facts["fusion_iou"] > 0.9


def test_no_scene_fits(spark):
    optical, radar = raster(spark, half_water(), "a"), radar_of(spark, "b")
    out = fusion.fuse_scenes(optical, radar, scene_row(spark, 64, 64, "a", BOX), scene_row(spark, 64, 64, "b", BOX))
    assert out["stats"].collect() == [] and out["regions"].collect() == [] and out["facts"].collect() == []
