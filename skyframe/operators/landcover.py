"""Threshold land cover for many scenes at once.

Each stage finds per-scene cuts on the pixels left by the stage before it. The
cuts are one narrow row per scene; they are written out between stages so that
the pixel scan is never nested, and only columns the stage needs are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (BIMODALITY_MIN, BUILTUP_GAP_MIN, BUILTUP_SEPARABILITY_MIN, CLASSES,
                            RGB_WATER_MIN_BLUENESS, WATER_INDEX_FLOOR)
from ..functions.indices import clamp, index_expr, nd, rgb_mean, saturation
from ..session import materialise
from .otsu import otsu
from .stats import attach, exact_quantiles, melt, wide

KEY = ["scene_id"]


def _cuts(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Per scene, threshold/eta/n of each metric as columns metric_threshold …"""
    long = melt(df, KEY, metrics)
    return wide(otsu(long, [*KEY, "metric"], "v"), KEY, "metric", list(metrics), ["threshold", "eta", "n"])


def has_multispectral() -> Column:
    return F.col("nir").isNotNull() & F.col("red").isNotNull()


def has_rgb() -> Column:
    return F.col("red").isNotNull() & F.col("green").isNotNull() & F.col("blue").isNotNull()


def with_layers(px: DataFrame) -> DataFrame:
    """Valid pixels with the derived layers the multispectral path reads."""
    ndvi = index_expr("NDVI")
    return px.withColumns({
        "ndvi": ndvi,
        "ndbi": index_expr("NDBI"),
        "water_index": F.coalesce(index_expr("MNDWI"), index_expr("NDWI"), -ndvi),
        "brightness": rgb_mean(),
    }).withColumn("is_cloud", (F.col("brightness") > 0.82) & (F.col("ndvi") < 0.25))


def _is_water() -> Column:
    return (
        ~F.col("is_cloud") & (F.col("water_index") > F.col("t_water")) & (F.col("ndvi") < 0.20)
        & F.coalesce(F.col("nir") < F.col("nir_cut"), F.lit(False))
    )


def multispectral_thresholds(px: DataFrame, adaptive: bool = True) -> DataFrame:
    """One row per scene with every cut of the near-infrared path."""
    layered = with_layers(px)

    first = _cuts(layered, {"w": F.col("water_index"), "nir": F.when(~F.col("is_cloud"), F.col("nir"))})
    if adaptive:
        t_water = F.when(F.col("w_eta") < BIMODALITY_MIN, 0.10).otherwise(
            clamp(F.col("w_threshold"), WATER_INDEX_FLOOR, 0.45))
    else:
        t_water = F.lit(0.0)
    cuts = materialise(first.select(
        *KEY, t_water.alias("t_water"), F.col("w_eta").alias("eta_water"), F.col("w_n").alias("n_valid"),
        F.col("nir_threshold"), F.col("nir_eta")), "water-cuts")

    # scenes whose near-infrared has one mode are confirmed against its darkest 35 %
    single = cuts.where(F.col("nir_eta") < BIMODALITY_MIN).select(*KEY)
    dark = exact_quantiles(
        attach(layered.where(~F.col("is_cloud")).select(*KEY, "nir"), single, KEY), KEY, "nir", {"p35": 0.35})
    cuts = materialise(
        cuts.join(dark, KEY, "left")
        .withColumn("nir_cut", F.coalesce("p35", "nir_threshold")).drop("p35", "nir_threshold"), "nir-cuts")

    land = attach(layered.select(*KEY, "is_cloud", "water_index", "ndvi", "ndbi", "nir"), cuts, KEY)
    land = land.where(~F.col("is_cloud") & ~_is_water()).select(*KEY, "ndvi", "ndbi")
    if adaptive:
        vegetation = _cuts(land, {"land": F.col("ndvi")})
        big = F.col("land_n") > 256
        vegetation = vegetation.select(
            *KEY, F.when(big, clamp(F.col("land_threshold"), 0.04, 0.40)).otherwise(0.15).alias("t_veg"),
            big.alias("split_veg"))
    else:
        vegetation = land.select(*KEY).distinct().select(*KEY, F.lit(0.15).alias("t_veg"), F.lit(False).alias("split_veg"))
    cuts = materialise(cuts.join(vegetation, KEY, "left"), "vegetation-cuts")

    cover = attach(land, cuts.select(*KEY, "t_veg", "split_veg"), KEY)
    low = F.col("ndvi") < F.col("t_veg")
    third = _cuts(cover, {
        "veg": F.when(F.col("split_veg") & ~low, F.col("ndvi")),
        "low": F.when(low, F.col("ndbi"))})
    t_dense = F.when(~F.col("split_veg"), 0.35).when(
        F.col("veg_n") > 128, clamp(F.col("veg_threshold"), F.col("t_veg") + 0.02, 0.75)
    ).otherwise(F.col("t_veg") + 0.10)
    cuts = materialise(
        cuts.join(third, KEY, "left").select(
            *cuts.columns, t_dense.alias("t_dense"),
            F.when(F.col("low_n") > 256, clamp(F.col("low_threshold"), -0.05, 0.45)).alias("t_built"),
            F.when(F.col("low_n") > 256, F.col("low_eta")).alias("eta_built")), "dense-cuts")

    sides = (
        attach(cover.where(low), cuts.where(F.col("t_built").isNotNull()).select(*KEY, "t_built"), KEY)
        .groupBy(*KEY).agg(
            F.avg(F.when(F.col("ndbi") >= F.col("t_built"), F.col("ndbi"))).alias("_hi"),
            F.avg(F.when(F.col("ndbi") < F.col("t_built"), F.col("ndbi"))).alias("_lo")))
    return materialise(
        cuts.join(sides, KEY, "left")
        .withColumn("gap_built", F.when(F.col("t_built").isNotNull(), F.coalesce(F.col("_hi") - F.col("_lo"), F.lit(0.0))))
        .withColumn("split_built", F.coalesce(
            (F.col("eta_built") >= BUILTUP_SEPARABILITY_MIN) & (F.col("gap_built") >= BUILTUP_GAP_MIN), F.lit(False)))
        .drop("_hi", "_lo").withColumn("basis", F.lit("multispectral")), "landcover-cuts")


def _vegetation_class(index: str, bare: Column) -> Column:
    v = F.col(index)
    return (
        F.when(v >= F.col("t_dense"), "dense_vegetation")
        .when((v >= F.col("t_veg")) & (v < F.col("t_dense")), "sparse_vegetation")
        .otherwise(bare)
    )


def apply_multispectral(px: DataFrame, cuts: DataFrame) -> DataFrame:
    """Scene cuts back onto the pixels (J3): one join on scene_id, then one CASE."""
    low = F.when(F.col("split_built") & (F.col("ndbi") >= F.col("t_built")), "built_up").otherwise("bare_soil")
    label = (
        F.when(F.col("is_cloud"), "cloud_or_snow").when(_is_water(), "water")
        .otherwise(_vegetation_class("ndvi", low))
    )
    return attach(with_layers(px), cuts, KEY).withColumn("class", label).select(*px.columns, "class")


def _rgb_layers(px: DataFrame) -> DataFrame:
    return px.withColumns({
        "brightness": rgb_mean(), "blueness": nd(F.col("blue"), F.col("red")),
        "vari": index_expr("VARI"), "sat": saturation(),
    }).withColumn("is_cloud", (F.col("brightness") > 0.85) & (F.col("sat") < 0.15))


def _rgb_water() -> Column:
    return F.coalesce((F.col("blueness") > F.col("t_water")) & (F.col("brightness") < F.col("dark_cut")), F.lit(False))


def rgb_thresholds(px: DataFrame, adaptive: bool = True) -> DataFrame:
    """One row per scene with every cut of the visible-only path."""
    clear = _rgb_layers(px).where(~F.col("is_cloud"))
    scenes = px.select(*KEY).distinct()
    if adaptive:
        blue = _cuts(clear, {"b": F.col("blueness")})
        dark = exact_quantiles(clear, KEY, "brightness", {"dark_cut": 0.45})
        cuts = scenes.join(blue, KEY, "left").join(dark, KEY, "left").select(
            *KEY, F.when(F.col("b_eta") < BIMODALITY_MIN, 0.12)
            .otherwise(clamp(F.col("b_threshold"), RGB_WATER_MIN_BLUENESS, 0.45)).alias("t_water"),
            F.col("b_eta").alias("eta_water"), "dark_cut")
    else:
        none = F.lit(None).cast("double")
        cuts = scenes.select(*KEY, none.alias("t_water"), none.alias("eta_water"), none.alias("dark_cut"))
    cuts = materialise(cuts, "rgb-water-cuts")

    land = attach(clear, cuts, KEY).where(~_rgb_water()).select(*KEY, "vari", "brightness")
    first = _cuts(land, {"land": F.col("vari")})
    big = F.coalesce(F.col("land_n") > 256, F.lit(False)) & F.lit(adaptive)
    cuts = materialise(
        cuts.join(first, KEY, "left").select(
            *cuts.columns, F.when(big, clamp(F.col("land_threshold"), 0.02, 0.45)).otherwise(0.05).alias("t_veg"),
            big.alias("split_veg")), "rgb-vegetation-cuts")

    cover = attach(land, cuts.select(*KEY, "t_veg", "split_veg"), KEY)
    low = F.col("vari") < F.col("t_veg")
    second = _cuts(cover, {
        "veg": F.when(F.col("split_veg") & ~low, F.col("vari")),
        "low": F.when(low, F.col("brightness"))})
    t_dense = F.when(~F.col("split_veg"), 0.20).when(
        F.col("veg_n") > 128, clamp(F.col("veg_threshold"), F.col("t_veg") + 0.02, 0.8)
    ).otherwise(F.col("t_veg") + 0.10)
    tried = (F.col("low_n") > 256) & F.lit(adaptive)
    cuts = materialise(
        cuts.join(second, KEY, "left").select(
            *cuts.columns, t_dense.alias("t_dense"), F.when(tried, F.col("low_threshold")).alias("t_built"),
            F.when(tried, F.col("low_eta")).alias("eta_built")), "rgb-dense-cuts")

    sides = (
        attach(cover.where(low), cuts.where(F.col("t_built").isNotNull()).select(*KEY, "t_built"), KEY)
        .groupBy(*KEY).agg(
            F.avg(F.when(F.col("brightness") >= F.col("t_built"), F.col("brightness"))).alias("_hi"),
            F.avg(F.when(F.col("brightness") < F.col("t_built"), F.col("brightness"))).alias("_lo")))
    return materialise(
        cuts.join(sides, KEY, "left")
        .withColumn("gap_built", F.when(F.col("t_built").isNotNull(), F.coalesce(F.col("_hi") - F.col("_lo"), F.lit(0.0))))
        .withColumn("split_built", F.coalesce(
            (F.col("eta_built") >= BIMODALITY_MIN) & (F.col("gap_built") >= 0.08), F.lit(False)))
        .drop("_hi", "_lo").withColumn("basis", F.lit("rgb")), "rgb-cuts")


def apply_rgb(px: DataFrame, cuts: DataFrame) -> DataFrame:
    low = F.when(F.col("split_built") & (F.col("brightness") >= F.col("t_built")), "built_up").otherwise("bare_soil")
    label = (
        F.when(F.col("is_cloud"), "cloud_or_snow").when(_rgb_water(), "water")
        .otherwise(_vegetation_class("vari", low))
    )
    return attach(_rgb_layers(px), cuts, KEY).withColumn("class", label).select(*px.columns, "class")


def segment_landcover(px: DataFrame, adaptive: bool = True, visible_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pixels with ``class``, cuts per scene) for scenes with near-infrared bands.

    ``visible_only`` runs the RGB path instead. ``segment_any`` dispatches per scene.
    """
    valid = px.where(F.col("valid")) if "valid" in px.columns else px
    if visible_only:
        cuts = rgb_thresholds(valid, adaptive)
        return apply_rgb(valid, cuts), cuts
    cuts = multispectral_thresholds(valid, adaptive)
    return apply_multispectral(valid, cuts), cuts


def segment_any(px: DataFrame, adaptive: bool = True) -> DataFrame:
    """Dispatch on the bands each scene has; pixels gain ``class`` and ``basis``.

    A scene has a band where any of its pixels does, and goes one way as a whole: a pixel that lacks a band its scene
    needs is no valid pixel.
    """
    has = [F.first(b, ignorenulls=True).alias(b) for b in ("nir", "red", "green", "blue") if b in px.columns]
    # written, and met by its rows: every pass below reads the pixels through this join, and by the size of the pixels it would shuffle them each time
    kinds = materialise(px.groupBy(*KEY).agg(*has).select(*KEY, has_multispectral().alias("_spectral")), "scene-kinds")
    routed = attach(px, kinds, KEY, n=kinds.count())
    spectral, _ = segment_landcover(routed.where(F.col("_spectral") & has_multispectral()).drop("_spectral"), adaptive)
    visible, _ = segment_landcover(routed.where(~F.col("_spectral") & has_rgb()).drop("_spectral"), adaptive, visible_only=True)
    return spectral.withColumn("basis", F.lit("multispectral")).unionByName(
        visible.withColumn("basis", F.lit("rgb")))


def class_composition(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pixels and share of the labelled pixels for all six classes, zeros included."""
    by = by or KEY
    counts = labels.groupBy(*by, "class").agg(F.count("*").alias("pixels"))
    totals = counts.groupBy(*by).agg(F.sum("pixels").alias("valid_pixels"))
    spine = totals.withColumn("class", F.explode(F.array(*map(F.lit, CLASSES))))
    return (
        spine.join(counts, [*by, "class"], "left").na.fill(0, ["pixels"])
        .withColumn("fraction", F.col("pixels") / F.col("valid_pixels"))
        .select(*by, "class", "pixels", "valid_pixels", "fraction")
    )
