"""Image files: validation, decoding to pixel rows, labelled patches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V

ROWS_PER_BATCH = 1 << 18
PIXEL_SCHEMA = "path string, r int, c int, channels int, ch0 int, ch1 int, ch2 int, alpha int"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def sniff_format(head: Column) -> Column:
    """Container named by the leading bytes, given as upper-case hex."""
    out = F.when(head.startswith(V.RIFF_HEX) & (F.substring(head, 17, 8) == V.WEBP_HEX), "WebP")
    for magic, name in V.MAGIC:
        out = out.when(head.startswith(magic), name)
    return out


def validate_files(files: DataFrame, max_mb: float = V.MAX_UPLOAD_MB, keep: list[str] | None = None) -> DataFrame:
    """(path, status, reason, container) for rows of (path, length, content); the first failed check is reported."""
    ext, found = extension(F.col("path")), sniff_format(F.hex(F.substring("content", 1, 16)))
    reason = (
        F.when(~ext.isin(*V.SUPPORTED_EXTENSIONS), "unsupported extension")
        .when(F.col("length") == 0, "empty file")
        .when(F.col("length") < 32, "too small to be an image")
        .when(F.col("length") > max_mb * 1024 * 1024, "over the size limit")
        .when(found.isNull(), "contents are not an image")
        .when(ext.isin(*V.TIFF_EXTENSIONS) & ~found.endswith("TIFF"), F.concat(F.lit("named TIFF but contains "), found)))
    return files.select("path", *(keep or []), F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"), reason.alias("reason"),
                        found.alias("container"))


def _explode_images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decoded rasters to one row per pixel, a bounded block of image rows at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            image = batch.slice(i, 1).to_pylist()[0]
            h, w, n = image["height"], image["width"], image["nChannels"]
            if h <= 0:
                continue
            cube = np.frombuffer(image["data"], dtype=np.uint8).reshape(h, w, n)
            step = max(1, ROWS_PER_BATCH // w)
            for top in range(0, h, step):
                block = cube[top:top + step]
                rows, cols = np.indices(block.shape[:2], dtype=np.int32)
                size = rows.size
                none = pa.nulls(size, pa.int32())
                # stored blue, green, red (, alpha); single channel stays single
                planes = [pa.array(block[..., k].ravel().astype(np.int32)) for k in range(n)]
                ch = planes[2::-1] if n >= 3 else [planes[0], none, none]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([image["path"]] * size), pa.array(rows.ravel() + top), pa.array(cols.ravel()),
                     pa.array(np.full(size, n, dtype=np.int32)), *ch, planes[3] if n == 4 else none],
                    ["path", "r", "c", "channels", "ch0", "ch1", "ch2", "alpha"])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """The image source with normalised paths and broken files marked by height -1."""
    return spark.read.format("image").option("dropInvalid", False).load(path).select(
        F.regexp_replace("image.origin", "^file:///", "file:/").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")


def explode_images(images: DataFrame) -> DataFrame:
    """Pixels of decoded images (path, height, width, nChannels, data in BGR(A) order).

    Bands are in 0..1 and named by channel count, alpha is validity. Pixel blocks
    leave Python as they are decoded, so a task never holds an exploded image.
    """
    raw = images.where("height > 0").mapInArrow(_explode_images, PIXEL_SCHEMA)
    colour = F.col("channels") >= 3

    def unit(c: str) -> Column:
        return F.col(c) / 255.0

    return raw.select(
        F.col("path").alias("scene_id"), "r", "c", F.coalesce(F.col("alpha") > V.ALPHA_VALID_ABOVE, F.lit(True)).alias("valid"),
        F.when(colour, unit("ch0")).alias("red"), F.when(colour, unit("ch1")).alias("green"), F.when(colour, unit("ch2")).alias("blue"),
        F.when(~colour, unit("ch0")).alias("gray"))


def scan_images(spark: SparkSession, path: str, max_pixels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(scenes, pixels); every image has a scene row, whose status says why it gives no pixels.

    Pixels leave in blocks, so there is no limit unless ``max_pixels`` sets one.
    """
    images = read_images(spark, path)
    over = F.lit(False) if max_pixels is None else F.col("height").cast("bigint") * F.col("width") > max_pixels
    reason = F.when(F.col("height") <= 0, "unreadable").when(over, "over the pixel budget")
    scenes = images.select("path", "height", "width", F.col("nChannels").alias("channels"), (F.col("height") > 0).alias("readable"),
                           F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"), reason.alias("reason"))
    return scenes, explode_images(images.where(~over))


def sample_labelled(files: DataFrame, limit_per_class: int, seed: int = 42, labels=tuple(V.EUROSAT_TO_COARSE)) -> DataFrame:
    """At most N files per known label (the parent folder), in a seeded random order.

    Ranks are taken per (label, hash slice) first, so one very common label is thinned
    in parallel before its final ranking.
    """
    key = F.md5(F.concat(F.col("path"), F.lit(f"#{seed}")))
    labelled = files.withColumn("label", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).where(F.col("label").isin(*labels)).withColumn("_k", key)
    thinned = labelled.selectExpr("*", "row_number() OVER (PARTITION BY label, right(_k, 2) ORDER BY _k) AS _i").where(
        F.col("_i") <= limit_per_class)
    return thinned.selectExpr("*", "row_number() OVER (PARTITION BY label ORDER BY _k) AS _n").where(
        F.col("_n") <= limit_per_class).drop("_k", "_i", "_n")
