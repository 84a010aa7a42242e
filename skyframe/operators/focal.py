"""Neighbourhood operators over images given as rows (key…, r, c, value).

All run on tiles with a halo (``halo``): one shuffle of pixels for any chain of steps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import halo as tiles

IMAGE = ["scene_id"]


def densify(pixels: DataFrame, scenes: DataFrame, fill: dict, key: list[str] | None = None) -> DataFrame:
    """Every grid cell of every scene with the grid size; cells never observed get ``fill``.

    For results that list empty cells; the operators below fill empty cells by themselves.
    """
    key = key or IMAGE
    cells = scenes.select(*key, "width", "height", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("r"))
    # the lines of the few scenes are dealt out before each becomes a line of cells
    cells = cells.repartition(*key, "r").select(
        *key, "width", "height", "r", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("c"))
    return cells.join(pixels, [*key, "r", "c"], "left").na.fill(fill)


def box_mean(df: DataFrame, value: str, k: int, out: str, edge: str = "symmetric", key: list[str] | None = None) -> DataFrame:
    """Mean of the k x k box; ``symmetric`` repeats the edge line, ``reflect`` does not."""
    def kernel(a, present, image):
        return {out: tiles.box_sum(a[value], k // 2, edge) / float(k * k)}

    return tiles.over_tiles(df, key or IMAGE, [value], [out], k // 2, kernel)


def local_std(df: DataFrame, value: str, sides: dict[str, int], key: list[str] | None = None) -> DataFrame:
    """Box standard deviations (name -> side) with mirrored borders that do not repeat the edge."""
    def kernel(a, present, image):
        return {name: np.sqrt(tiles.box_moments(a[value], k, "reflect")[1]) for name, k in sides.items()}

    return tiles.over_tiles(df, key or IMAGE, [value], list(sides), max(sides.values()) // 2, kernel)


def whole_variance(df: DataFrame, value: str, key: list[str]) -> DataFrame:
    """(key…, width, height, whole): population variance over every cell of each image, cells without a row being 0."""
    n = F.max("width").cast("double") * F.max("height")
    v = F.coalesce(F.col(value), F.lit(0.0))
    mean = F.sum(v) / n
    return df.groupBy(*key).agg(F.max("width").alias("width"), F.max("height").alias("height"), F.greatest(F.sum(v * v) / n - mean * mean, F.lit(0.0)).alias("whole"))


def lee_filter(df: DataFrame, value: str, out: str = "filtered", k: int = 5, key: list[str] | None = None) -> DataFrame:
    """Adaptive speckle filter; the scene variance covers every cell of the image. Needs width and height."""
    def kernel(a, present, image):
        return {out: tiles.lee(a[value], image["whole"], k)}

    key = key or IMAGE
    return tiles.over_tiles(df, key, [value], [out], k // 2, kernel, whole_variance(df, value, key))


def local_texture(df: DataFrame, value: str, out: str = "texture", k: int = 7, key: list[str] | None = None) -> DataFrame:
    """Local coefficient of variation."""
    def kernel(a, present, image):
        return {out: tiles.variation(a[value], k)}

    return tiles.over_tiles(df, key or IMAGE, [value], [out], k // 2, kernel)


def despeckled_texture(df: DataFrame, value: str, despeckle: bool = True, digits: int = 9, lee_side: int = 5, texture_side: int = 7,
                       key: list[str] | None = None) -> DataFrame:
    """``filtered`` and the ``texture`` of it, both rounded, in one pass over tiles. Needs width and height.

    The value filtered in a cell without a row is computed too, as its neighbours' texture needs it.
    """
    key = key or IMAGE

    def kernel(a, present, image):
        filtered = np.round(tiles.lee(a[value], image["whole"], lee_side) if despeckle else a[value], digits)
        return {"filtered": filtered, "texture": np.round(tiles.variation(filtered, texture_side), digits)}

    reach = texture_side // 2 + (lee_side // 2 if despeckle else 0)
    return tiles.over_tiles(df, key, [value], ["filtered", "texture"], reach, kernel, whole_variance(df, value, key) if despeckle else None)


def gradient(df: DataFrame, value: str, key: list[str] | None = None) -> DataFrame:
    """Central differences inside, one-sided at the borders: columns gy, gx."""
    def kernel(a, present, image):
        return {name: tiles.slopes(a[value], present, axis) for name, axis in (("gy", 0), ("gx", 1))}

    return tiles.over_tiles(df, key or IMAGE, [value], ["gy", "gx"], 1, kernel)


def morphology(df: DataFrame, mask: str, radius: int = 1, key: list[str] | None = None) -> DataFrame:
    """Closing then opening of a mask with a row per cell; cells outside the image count as off."""
    def kernel(a, present, image):
        return {"_on": tiles.smooth(a["_m"] > 0, present, radius).astype(float)}

    flag = df.withColumn("_m", F.coalesce(F.col(mask), F.lit(False)).cast("double"))
    kept = [c for c in df.columns if c != mask]
    out = tiles.over_tiles(flag.select(*kept, "_m"), key or IMAGE, ["_m"], ["_on"], 4 * radius, kernel)
    return out.select(*kept, (F.col("_on") > 0).alias(mask))


def smooth_cells(cells: DataFrame, images: DataFrame, radius: int = 1, key: list[str] | None = None) -> DataFrame:
    """(key…, r, c): closing then opening of masks given by their cells that are on; cells that are off are never rows."""
    def kernel(on):
        return tiles.smooth(on, np.ones_like(on), radius)

    return tiles.mask_over_tiles(cells, images, key or IMAGE, 4 * radius, kernel)
