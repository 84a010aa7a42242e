"""Tile-wise classification of whole scenes (C11)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import gsd_m
from ..operators import learn, tiles
from ..operators.boosting import BoostedModel
from ..session import materialise
from ..sources.scenes import domain_check


def classify_tiles(pixels: DataFrame, scenes: DataFrame, model: PipelineModel | BoostedModel, tile: int = 64, stride: int | None = None,
                   max_tiles: int | None = None, min_valid: float = 0.6) -> DataFrame:
    """(scene_id, tile_r, tile_c, predicted, confidence, coarse_class) for every tile, or ``max_tiles`` even ones of each scene."""
    covered = tiles.tile_pixels(pixels, scenes, tile, stride)
    usable = tiles.tile_scenes(covered, tile, min_valid)
    chosen = (usable if max_tiles is None else tiles.sample_evenly(usable, max_tiles)).select("scene_id", "tile_r", "tile_c")
    key = F.concat_ws("/", "scene_id", "tile_r", "tile_c")
    # all tiles are measured where all usable ones are wanted: the join below leaves out the others, and pixels are shuffled once
    measured = covered if max_tiles is None else covered.join(chosen, ["scene_id", "tile_r", "tile_c"])
    patches = measured.select(
        key.alias("tile_id"), (F.col("r") - F.col("tile_r")).alias("r"), (F.col("c") - F.col("tile_c")).alias("c"),
        F.lit(tile).alias("height"), F.lit(tile).alias("width"), "red", "green", "blue")
    labelled = learn.predict(model, tiles.patch_features(patches))
    return chosen.withColumn("tile_id", key).join(labelled.select("tile_id", "predicted", "confidence"), "tile_id").drop("tile_id").withColumn(
        "coarse_class", learn.map_coarse(F.col("predicted")))


def classify_scenes(pixels: DataFrame, scenes: DataFrame, model: PipelineModel | BoostedModel, tile: int = 64, stride: int | None = None,
                    max_tiles: int | None = None) -> DataFrame:
    """Dominant class per scene with its share, confidence and domain check; the classes of tiles are written, as every figure reads them."""
    labelled = materialise(classify_tiles(pixels, scenes, model, tile, stride, max_tiles), "tile-classes")
    summary = learn.scene_classes(labelled, ["scene_id"]).join(scenes.withColumn("gsd", gsd_m()).select("scene_id", "gsd"), "scene_id")
    out = domain_check(summary, "gsd", "mean_confidence")
    return out.select("scene_id", "tiles", "dominant_class", F.round("dominant_fraction", 4).alias("dominant_fraction"), F.round("mean_confidence", 4).alias("mean_confidence"),
                      F.round("min_confidence", 4).alias("min_confidence"), "out_of_domain", "narrated")
