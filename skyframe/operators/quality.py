"""Scene quality, empty-scene rejection and cube assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indices import is_cloud_rgb, rgb_mean
from ..functions.numbers import half_even
from .stats import attach


def scene_quality(pixels: DataFrame, scenes: DataFrame) -> DataFrame:
    """Coverage, cloud, darkness and usability per scene; a scene never seen scores 0/1/1."""
    seen = pixels.where("valid") if "valid" in pixels.columns else pixels
    bright = rgb_mean()
    agg = seen.groupBy("scene_id").agg(
        F.count("*").alias("n"), F.avg(is_cloud_rgb().cast("double")).alias("cloud"),
        F.avg((bright < 0.02).cast("double")).alias("dark"), F.avg(bright).alias("mean"))
    cov = F.coalesce(F.col("n") / (F.col("width") * F.col("height")), F.lit(0.0))
    cloud, dark = F.coalesce("cloud", F.lit(1.0)), F.coalesce("dark", F.lit(1.0))
    return scenes.select("scene_id", "width", "height").join(agg, "scene_id", "left").select(
        "scene_id", half_even(cov, 4).alias("coverage"), half_even(cloud, 4).alias("cloud_fraction"),
        half_even(dark, 4).alias("dark_fraction"), half_even(F.coalesce("mean", F.lit(0.0)), 4).alias("mean_brightness"),
        half_even(cov * (1 - cloud), 4).alias("clear_fraction"),
        half_even(cov * (1 - cloud) * (1 - dark), 4).alias("usable_fraction"))


def usable_scenes(pixels: DataFrame, scenes: DataFrame, min_coverage: float = 0.02) -> DataFrame:
    """Scene ids that were covered and hold imagery."""
    bright = rgb_mean()
    agg = pixels.groupBy("scene_id").agg(
        F.count("*").alias("n"), F.avg(bright).alias("mean"), F.avg((bright < 0.02).cast("double")).alias("dark"))
    return scenes.join(agg, "scene_id").where(
        (F.col("n") / (F.col("width") * F.col("height")) >= min_coverage)
        & ~((F.col("mean") < 0.035) | (F.col("dark") > 0.97))).select("scene_id")


def reject_empty_scenes(pixels: DataFrame, scenes: DataFrame, min_coverage: float = 0.02) -> DataFrame:
    return attach(pixels, usable_scenes(pixels, scenes, min_coverage), ["scene_id"])


def build_cube(true_color: DataFrame, infrared: DataFrame) -> DataFrame:
    """Stack two co-registered composites; the true-colour one owns ``red``.

    Both carry (aoi, acq_date, sensor, pref, r, c). Sensors missing either composite
    drop out, and of the rest the most preferred one serves the area and date.
    """
    key = ["aoi", "acq_date", "sensor"]
    best = (
        true_color.select(*key, "pref").distinct().join(infrared.select(*key).distinct(), key)
        .groupBy("aoi", "acq_date").agg(F.min_by("sensor", "pref").alias("sensor")))
    ir = infrared.select(*key, "r", "c", "swir2", "nir", F.col("red").alias("red_ir"))
    return (
        attach(true_color.join(ir, [*key, "r", "c"]), best, key)
        .select(*key, "r", "c", "blue", "green", F.coalesce("red", "red_ir").alias("red"), "nir", "swir2"))
