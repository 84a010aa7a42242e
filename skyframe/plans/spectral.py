"""Index statistics, histograms and facts for many scenes (C1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import INDEX_BANDS
from ..functions.indices import index_expr, substitute_indices
from ..operators.facts import to_facts
from ..operators.stats import attach, histogram, index_stats, melt

BY = ["scene_id", "metric"]
STATS = (("mean", "mean"), ("median", "median"), ("std", "standard deviation"), ("min", "minimum"), ("max", "maximum"),
         ("p10", "10th percentile"), ("p90", "90th percentile"))


def scene_bands(pixels: DataFrame, candidates: list[str]) -> DataFrame:
    """(scene_id, bands): a band exists where any pixel has a value."""
    return pixels.groupBy("scene_id").agg(F.array_compact(F.array(*[F.when(F.count(b) > 0, F.lit(b)) for b in candidates])).alias("bands"))


def spectral_index(pixels: DataFrame, requested: Column, bins: int = 40) -> dict[str, DataFrame]:
    """Stats, histogram and facts of the requested indices, or of their substitutes, per scene."""
    bands = [b for b in ("blue", "green", "red", "nir", "swir2") if b in pixels.columns]
    plan = scene_bands(pixels, bands).withColumn("requested", requested)
    chosen = substitute_indices(F.col("requested"), F.col("bands"))
    plan = plan.select("scene_id", *[v.alias(k) for k, v in chosen.items()])
    usable_names = {k: index_expr(k) for k, need in INDEX_BANDS.items() if set(need) <= set(bands)}
    wanted = attach(pixels, plan.select("scene_id", "computed"), ["scene_id"])
    long = melt(wanted, ["scene_id"], {k: F.when(F.array_contains("computed", k), v) for k, v in usable_names.items()})
    stats = index_stats(long, BY, "v")
    facts = to_facts(
        stats.withColumn("m", F.lower("metric")),
        [(s, "{m}_" + s, "{metric} " + name, None, name + " over {n} valid pixels") for s, name in STATS]
        + [("n", "{m}_valid_pixels", "{metric} valid pixel count", "pixels", "finite values inside the observed mask")],
        "spectral_index", by="scene_id")
    return {"plan": plan, "stats": stats, "histogram": histogram(long, BY, "v", bins), "facts": facts}
