"""Located regions of a class or of change (C5, G3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CLASS_LABELS
from ..operators import components
from ..operators.facts import to_facts
from ..operators.focal import smooth_cells
from ..session import materialise


def clean_mask(cells: DataFrame, scenes: DataFrame, by: list[str], min_size: int = 12) -> DataFrame:
    """Runs of the mask after closing, opening and area opening.

    A scene whose every component is smaller than ``min_size`` keeps its raw mask,
    marked ``unfiltered``.
    """
    smooth = smooth_cells(cells, scenes, 1, by)
    kept = materialise(components.area_open(smooth, by, min_size).withColumn("unfiltered", F.lit(False)), "clean-runs")
    lost = cells.select(*by).distinct().join(kept.select(*by).distinct(), by, "left_anti")
    lost = materialise(lost, "unfiltered-scenes")
    if lost.isEmpty():
        return kept
    raw = components.connected_runs(cells.select(*by, "r", "c").join(lost, by, "left_semi"), by)
    return kept.unionByName(raw.withColumn("unfiltered", F.lit(True)), allowMissingColumns=True)


def ground_regions(labels: DataFrame, scenes: DataFrame, target: str, max_regions: int = 6, min_pixels: int = 40,
                   min_size: int = 12) -> dict[str, DataFrame]:
    """Regions of one land-cover class, ranked and located, with facts."""
    by = ["scene_id"]
    runs = clean_mask(labels.where(F.col("class") == target), scenes, by, min_size)
    ranked = components.rank_regions(components.region_stats(runs, by), by, min_pixels, max_regions)
    regions = components.locate_regions(ranked, scenes, by).withColumn("confidence", F.lit(0.8))
    totals = runs.groupBy(*by).agg(F.sum(F.expr("c1 - c0 + 1")).alias("pixels"))
    found = regions.groupBy(*by).agg(F.count("*").alias("regions")).join(totals, by).join(scenes, by)
    from ..functions.geo import area_of

    name = CLASS_LABELS[target]
    facts = to_facts(found.withColumn("area", area_of(F.col("pixels"))), [
        ("regions", f"grounded_{target}_regions", f"{name} regions found", "regions", f"8-connected components of at least {min_pixels} px"),
        ("pixels", f"grounded_{target}_pixels", f"{name} pixels", "pixels", f"pixels labelled {target}"),
        ("area", f"grounded_{target}_area_km2", f"Total {name.lower()} area", "km2", "pixels by ground area per pixel")],
        "region_grounder", by="scene_id")
    return {"regions": regions, "totals": totals, "facts": facts}


def change_regions(changed: DataFrame, scenes: DataFrame, by: list[str], value: str = "delta", max_regions: int = 6,
                   min_pixels: int = 40) -> DataFrame:
    """Largest connected regions of change with their direction."""
    runs = materialise(components.connected_runs(changed.select(*by, "r", "c"), by), "change-runs")
    ranked = components.rank_regions(components.region_stats(runs, by), by, min_pixels, max_regions)
    cells = components.run_cells(runs, by).join(changed.select(*by, "r", "c", value), [*by, "r", "c"])
    directed = components.region_direction(ranked, cells, by, value).select(*by, "rank", "direction", "mean_delta", "component_delta")
    return components.locate_regions(ranked, scenes, by).join(directed, [*by, "rank"])
