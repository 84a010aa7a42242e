"""Optical and radar water evidence in one decision surface (C10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import pixel_area_km2
from ..operators import components
from ..operators.landcover import segment_any
from ..operators.pairing import check_coregistration
from ..operators.radar import fuse_water, fusion_stats, sar_segment
from ..operators.stats import attach
from ..session import materialise
from .regions import clean_mask
from .tool_facts import fusion_facts

KEY = ["scene_id"]
#: Share of the grid that both sensors must have observed.
MIN_OVERLAP = 0.02


def optical_sar_fusion(optical: DataFrame, radar_cells: DataFrame, pixel_km2: DataFrame,
                       prefer_sar_under_cloud: bool = True) -> tuple[DataFrame, DataFrame]:
    """(fused cells, stats per scene) for scene ids that both sensors share; visible-only scenes take part."""
    labels = segment_any(optical)
    seen = labels.select("scene_id", "r", "c", (F.col("class") == "water").alias("optical_water"),
                         (F.col("class") == "cloud_or_snow").alias("cloud"))
    cells, _ = sar_segment(radar_cells)
    both = seen.join(cells.select("scene_id", "r", "c", F.col("water").alias("sar_water")), ["scene_id", "r", "c"])
    fused = fuse_water(both, prefer_sar_under_cloud)
    return fused, fusion_stats(fused, pixel_km2)


def fusion_status(optical: DataFrame, radar_cells: DataFrame, optical_scenes: DataFrame, radar_scenes: DataFrame) -> DataFrame:
    """(scene_id, status, reason, max_corner_offset_deg, overlap) of every scene of either sensor.

    ``skipped`` without the other sensor, ``error`` on grids that do not lie on each other, ``no_data`` where both sensors
    observed less than MIN_OVERLAP of the grid, else ``ok``. Pixels are compared for scenes on a common grid only.
    """
    side = ["width", "height", "west", "south", "east", "north"]
    first = optical_scenes.select(*KEY, F.lit(True).alias("_optical"), *[F.col(c).alias(f"first_{c}") for c in side])
    second = radar_scenes.select(*KEY, F.lit(True).alias("_radar"), *[F.col(c).alias(f"second_{c}") for c in side])
    paired = materialise(check_coregistration(first.join(second, KEY, "full")), "fusion-pairs")
    same = paired.where("_optical AND _radar AND co_registered").select(*KEY, "first_width", "first_height")
    usable = [attach(px.where(valid).select(*KEY, "r", "c"), same.select(*KEY), KEY) for px, valid in ((optical, optical_valid(optical)), (radar_cells, "valid"))]
    shared = usable[0].join(usable[1], [*KEY, "r", "c"]).groupBy(*KEY).agg(F.count("*").alias("n"))
    overlap = F.coalesce("n", F.lit(0)) / (F.col("first_width").cast("double") * F.col("first_height"))
    out = paired.join(materialise(same.join(shared, KEY, "left").select(*KEY, overlap.alias("overlap")), "fusion-overlap"), KEY, "left")
    percent = F.format_string("%.1f", F.col("overlap") * 100)
    reason = (
        F.when(F.col("_optical").isNull(), "no optical scene").when(F.col("_radar").isNull(), "no radar scene")
        .when(~F.col("same_shape"), "grids of different size").when(~F.col("co_registered"), F.concat(F.lit("corners lie apart by "), F.format_string("%.6f", "max_corner_offset_deg"), F.lit(" degrees")))
        .when(F.col("overlap") < MIN_OVERLAP, F.concat(F.lit("both sensors observed only "), percent, F.lit(" % of the grid"))))
    status = (F.when(F.col("_optical").isNull() | F.col("_radar").isNull(), "skipped").when(~F.col("co_registered"), "error")
              .when(F.col("overlap") < MIN_OVERLAP, "no_data").otherwise("ok"))
    both = F.col("_optical") & F.col("_radar")
    return out.select(*KEY, status.alias("status"), reason.alias("reason"), F.when(both, F.col("max_corner_offset_deg")).alias("max_corner_offset_deg"), "overlap")


def optical_valid(optical: DataFrame):
    return F.col("valid") if "valid" in optical.columns else F.lit(True)


def fuse_scenes(optical: DataFrame, radar_cells: DataFrame, optical_scenes: DataFrame, radar_scenes: DataFrame, prefer_sar_under_cloud: bool = True,
                min_pixels: int = 40, max_regions: int = 6, min_size: int = 20) -> dict[str, DataFrame]:
    """``status`` of every scene; ``cells``, ``stats``, ``regions`` of the fused water and ``facts`` of those with status ok."""
    status = materialise(fusion_status(optical, radar_cells, optical_scenes, radar_scenes), "fusion-status")
    fit = status.where("status = 'ok'").select(*KEY)
    scenes = optical_scenes.join(fit, KEY, "left_semi")
    km2 = scenes.select(*KEY, pixel_area_km2().alias("pixel_km2"))
    cells, stats = optical_sar_fusion(attach(optical.where(optical_valid(optical)), fit, KEY), attach(radar_cells, fit, KEY), km2, prefer_sar_under_cloud)
    cells = materialise(cells, "fused-cells")
    stats = materialise(fusion_stats(cells, km2), "fusion-stats")
    runs = clean_mask(cells.where("fused").select(*KEY, "r", "c"), scenes, KEY, min_size)
    ranked = components.rank_regions(components.region_stats(runs, KEY), KEY, min_pixels, max_regions)
    return {"status": status, "cells": cells, "stats": stats, "regions": components.locate_regions(ranked, scenes, KEY), "facts": fusion_facts(stats)}
