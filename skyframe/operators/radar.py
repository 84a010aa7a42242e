"""Radar backscatter analysis and optical-radar fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indices import clamp
from ..functions.numbers import half_even
from ..session import materialise
from .focal import despeckled_texture
from .otsu import otsu
from .stats import attach, exact_quantiles, melt, wide

KEY = ["scene_id"]
DIGITS = 9  # layers are rounded here, so that sums taken in any order rank alike


def backscatter_layers(cells: DataFrame, value: str = "gray", despeckle: bool = True) -> DataFrame:
    """Despeckled backscatter and its texture; needs width and height, and cells without a row read 0."""
    return despeckled_texture(cells, value, despeckle, DIGITS)


def _stretched(name: str) -> Column:
    lo, hi = F.col(f"{name}_p02"), F.col(f"{name}_p98")
    return clamp((F.col(name) - lo) / F.greatest(hi - lo, F.lit(1e-6)), 0.0, 1.0)


def sar_segment(grid: DataFrame, despeckle: bool = True, builtup_percentile: float = 80.0) -> tuple[DataFrame, DataFrame]:
    """(valid cells with water and built_up, cuts per scene).

    Water is the dark mode below a clamped Otsu cut; built-up is the top of the land
    when ranked by stretched brightness and texture in equal parts.
    """
    layers = materialise(
        backscatter_layers(grid, despeckle=despeckle).where("valid").select(*KEY, "r", "c", "filtered", "texture"), "radar-layers")
    water_cut = otsu(layers, KEY, "filtered").select(*KEY, clamp(F.col("threshold"), 0.06, 0.42).alias("t_water"))
    cuts = materialise(water_cut, "radar-water")
    marked = attach(layers, cuts, KEY).withColumn("water", F.col("filtered") < F.col("t_water"))

    land = melt(marked.where("NOT water"), KEY, {"filtered": F.col("filtered"), "texture": F.col("texture")})
    spread = wide(exact_quantiles(land, [*KEY, "metric"], "v", {"p02": 0.02, "p98": 0.98}), KEY, "metric",
                  ["filtered", "texture"], ["p02", "p98"])
    cuts = materialise(cuts.join(spread, KEY, "left"), "radar-spread")
    scored = attach(layers, cuts, KEY).withColumn("water", F.col("filtered") < F.col("t_water")).withColumn(
        "score", F.round(0.5 * _stretched("filtered") + 0.5 * _stretched("texture"), DIGITS))
    # written: rounding is dear, and the quantiles would repeat it in every pass, test and bucket
    scored = materialise(scored.select(*KEY, "r", "c", "filtered", "texture", "water", "score"), "radar-scores")
    built = exact_quantiles(scored.where("NOT water"), KEY, "score", {"t_built": builtup_percentile / 100.0}, 4096.0)
    cuts = materialise(cuts.join(built, KEY, "left").withColumn("t_built", F.coalesce("t_built", F.lit(1.0))), "radar-cuts")
    out = attach(scored, cuts.select(*KEY, "t_built"), KEY).withColumn(
        "built_up", ~F.col("water") & F.coalesce(F.col("score") > F.col("t_built"), F.lit(False)))
    return out.select(*KEY, "r", "c", "filtered", "texture", "score", "water", "built_up"), cuts


def sar_stats(cells: DataFrame) -> DataFrame:
    """Backscatter distribution, texture, and water, land and built-up shares per scene."""
    n, land = F.count("*"), F.count_if(~F.col("water"))
    direct = cells.groupBy(*KEY).agg(
        F.avg("filtered").alias("mean_backscatter"), F.stddev_pop("filtered").alias("std_backscatter"),
        F.avg("texture").alias("mean_texture"), F.count_if("water").alias("water_pixels"),
        F.count_if("built_up").alias("builtup_pixels"), n.alias("valid_pixels"),
        (F.count_if("water") / n).alias("water_fraction"), (land / n).alias("land_fraction"),
        (F.count_if("built_up") / n).alias("builtup_fraction"),
        F.when(land > 0, F.count_if("built_up") / land).otherwise(0.0).alias("builtup_fraction_of_land"))
    q = exact_quantiles(cells, KEY, "filtered", {"median_backscatter": 0.5, "p10_backscatter": 0.1, "p90_backscatter": 0.9})
    t = exact_quantiles(cells, KEY, "texture", {"texture_threshold": 0.75})
    return direct.join(q, KEY).join(t, KEY)


def fuse_water(both: DataFrame, prefer_sar_under_cloud: bool = True) -> DataFrame:
    """Adds both/optical_only/sar_only/fused for cells with optical_water, sar_water, cloud."""
    o, s = F.col("optical_water"), F.col("sar_water")
    fused = F.when(F.col("cloud"), s).otherwise(o | s) if prefer_sar_under_cloud else o | s
    recovered = F.col("cloud") & s & ~o if prefer_sar_under_cloud else F.lit(False)
    return both.withColumns({"both": o & s, "optical_only": o & ~s, "sar_only": s & ~o, "fused": fused, "recovered": recovered})


def fusion_stats(fused: DataFrame, pixel_km2: DataFrame) -> DataFrame:
    names = {"optical_water": "optical_water", "sar_water": "sar_water", "both": "agreement", "optical_only": "optical_only",
             "sar_only": "sar_only", "fused": "fused_water", "recovered": "cloud_recovered"}
    agg = fused.groupBy(*KEY).agg(*[F.count_if(c).alias(f"{n}_pixels") for c, n in names.items()],
                                  F.count("*").alias("valid_pixels"))
    union = F.col("agreement_pixels") + F.col("optical_only_pixels") + F.col("sar_only_pixels")
    out = agg.join(pixel_km2, KEY, "left").withColumn(
        "iou", half_even(F.when(union > 0, F.col("agreement_pixels") / union).otherwise(1.0), 4))
    for n in ("optical_water", "sar_water", "fused_water"):
        out = out.withColumn(f"{n}_fraction", F.col(f"{n}_pixels") / F.col("valid_pixels"))
    for n in ("optical_water", "sar_water", "fused_water", "cloud_recovered"):
        out = out.withColumn(f"{n}_km2", half_even(F.col(f"{n}_pixels") * F.col("pixel_km2"), 4))
    return out.drop("pixel_km2")
