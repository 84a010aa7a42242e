"""Dimension tables: layers, indices, classes, places, and scene listings."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.geo import bbox_area_km2
from ..functions.numbers import half_even
from ..functions.text import fold_key


def layer_catalog(spark: SparkSession) -> DataFrame:
    rows = [(*r[:6], list(r[6]), r[7], datetime.date.fromisoformat(r[8]), r[9]) for r in V.LAYERS]
    return spark.createDataFrame(
        rows, "layer_key string, layer_id string, modality string, platform string, instrument string, "
              "resolution_m double, bands array<string>, cadence_days int, start date, colorised boolean")


def index_catalog(spark: SparkSession) -> DataFrame:
    rows = [(k, *V.INDEX_INFO[k], list(need), V.INDEX_PALETTE[k]) for k, need in V.INDEX_BANDS.items()]
    return spark.createDataFrame(
        rows, "index_name string, long_name string, reads string, reference string, required_bands array<string>, palette string")


def class_catalog(spark: SparkSession) -> DataFrame:
    rows = [(i, k, V.CLASS_LABELS[k], *V.CLASS_COLORS[k]) for i, k in enumerate(V.CLASS_LABELS)]
    return spark.createDataFrame(rows, "ord int, class string, label string, cr int, cg int, cb int")


def gazetteer(spark: SparkSession) -> DataFrame:
    """Places with their boxes and areas, in resolution order."""
    rows = [(i, *p[:7], list(p[7])) for i, p in enumerate(V.PLACES)]
    places = spark.createDataFrame(
        rows, "ord int, name string, west double, south double, east double, north double, kind string, "
              "country string, aliases array<string>")
    return places.withColumn("area_km2", F.round(bbox_area_km2(), 1))


def place_keys(places: DataFrame) -> DataFrame:
    """(key, place …): one row per folded name or alias; a repeated key belongs to its last place."""
    keyed = places.select("*", F.posexplode(F.concat(F.array("name"), F.col("aliases"))).alias("_pos", "_alias")).withColumn(
        "key", fold_key(F.col("_alias")))
    others = [c for c in places.columns if c != "aliases"]
    seen = F.col("ord") * 1000 + F.col("_pos")
    return keyed.groupBy("key").agg(
        F.min(seen).alias("first_seen"), F.max_by(F.struct(*others), seen).alias("p")).select("key", "first_seen", "p.*")


def scene_listing(scenes: DataFrame, pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Per scene: grid size, bands present, band count, validity and position."""
    present = [F.when(F.count(b) > 0, F.lit(b)) for b in bands]
    valid = F.count_if(F.col("valid")) if "valid" in pixels.columns else F.count("*")
    per_scene = pixels.groupBy("scene_id").agg(
        F.array_sort(F.array_compact(F.array(*present))).alias("bands"), valid.alias("valid_pixels"))
    return scenes.join(per_scene, "scene_id").withColumns({
        "band_count": F.size("bands"),
        "valid_fraction": half_even(F.col("valid_pixels") / (F.col("width") * F.col("height")), 4),
        "georeferenced": F.col("west").isNotNull(),
    })
