"""Scene-level checks: bands, modality, validity, capabilities, archive range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.indices import available_indices
from .catalog import layer_catalog


def _has(bands: Column, *names: str) -> Column:
    return F.size(F.array_intersect(bands, F.array(*map(F.lit, names)))) == len(names)


def infer_modality(name: Column, bands: Column) -> Column:
    """First match wins: file name, polarisation bands, then band count."""
    lower = F.lower(name)
    named = F.lit(False)
    for token in V.SAR_NAME_TOKENS:
        named = named | F.contains(lower, F.lit(token))
    polarised = F.arrays_overlap(bands, F.array(*map(F.lit, ("vv", "vh", "hh", "hv"))))
    return (
        F.when(named | polarised, "sar").when(F.size(bands) == 1, "derived")
        .when(F.size(bands) >= 4, "multispectral").otherwise("optical")
    )


def check_scene(scenes: DataFrame, needs: list[str]) -> DataFrame:
    """Issues block the analysis; warnings travel with it."""
    missing = F.array_except(F.array(*map(F.lit, needs)), F.col("bands"))
    share = F.col("valid_fraction")
    issues = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("needs band(s) "), F.array_join(missing, ", "))),
        F.when(share < 0.05, "fewer than 5% of pixels are valid")))
    warnings = F.array_compact(F.array(
        F.when((share >= 0.05) & (share < 0.6), F.format_string("only %.0f%% of pixels are valid", share * 100)),
        F.when(~F.col("georeferenced"), "no georeferencing: sizes are in pixels")))
    return scenes.withColumns({"missing_bands": missing, "issues": issues, "warnings": warnings}).withColumn(
        "compatible", F.size("issues") == 0)


def capabilities(scenes: DataFrame) -> DataFrame:
    """What a scene's bands and position support, and reasons for what they do not."""
    bands, geo = F.col("bands"), F.col("georeferenced")
    spectral, rgb = _has(bands, "nir", "red"), _has(bands, "red", "green", "blue")
    reasons = F.array_compact(F.array(
        F.when(~geo, "area in km2: no map projection"),
        F.when(~geo, "map overlay: no coordinates"),
        F.when(~geo, "archive comparison: position unknown"),
        F.when(~spectral, "NDVI, NDWI, MNDWI, NBR, NDBI: no infrared band"),
        F.when(~rgb, "scene classification: needs red, green and blue")))
    return scenes.withColumns({
        "band_basis": F.when(spectral, "multispectral").when(rgb, "rgb").otherwise("single_band"),
        "spatial_reference": F.when(geo, "georeferenced").otherwise("pixel_space"),
        "land_cover_segmentation": spectral | rgb,
        "scene_classification": rgb,
        "region_grounding": spectral | rgb,
        "spectral_indices": F.array_sort(available_indices(bands)),
        "unavailable": reasons,
    })


def domain_check(scenes: DataFrame, gsd: str, confidence: str) -> DataFrame:
    """Classifier output far from its training resolution counts less and is not narrated."""
    far = F.coalesce(F.col(gsd) > V.DOMAIN_GSD_LIMIT_M, F.lit(False))
    return scenes.withColumns({
        "out_of_domain": far, "narrated": ~far,
        confidence: F.col(confidence) * F.when(far, V.OUT_OF_DOMAIN_SCALE).otherwise(1.0)})


def archive_range(requests: DataFrame, layer: str, requested: str) -> DataFrame:
    """``no_data`` for dates before the layer's first observation."""
    layers = layer_catalog(requests.sparkSession).select(F.col("layer_key").alias(layer), F.col("start").alias("archive_start"))
    return requests.join(layers, layer).withColumn(
        "status", F.when(F.col(requested) < F.col("archive_start"), "no_data").otherwise("ok"))
