"""Index series of many areas with trend and gaps (C8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indices import index_expr
from ..operators import series
from ..operators.facts import to_facts, to_text_facts
from ..operators.stats import attach, index_stats


def timeseries_analysis(pixels: DataFrame, areas: DataFrame, index: str = "NDVI", steps: int = 8, interval_days: int = 30,
                        min_coverage: float = 0.25) -> dict[str, DataFrame]:
    """Series, trend, summary and facts from pixels (aoi, d, bands) and areas (aoi, anchor, width, height).

    All dates of all areas are reduced in one aggregate; dates without a usable
    observation stay in the series with their status.
    """
    spine = series.date_spine(areas, "anchor", steps, interval_days)
    wanted = attach(pixels, spine.select("aoi", "d").distinct(), ["aoi", "d"]).select("aoi", "d", index_expr(index).alias("v"))
    stats = index_stats(wanted, ["aoi", "d"], "v").join(areas.select("aoi", "width", "height"), "aoi").withColumn(
        "coverage", F.col("n") / (F.col("width") * F.col("height"))).drop("width", "height")
    rows = series.time_series(spine.select("aoi", "d"), stats, "aoi", min_coverage)
    trend = series.ols_trend(rows, "aoi", interval_days)
    summary = series.series_summary(rows, "aoi").join(trend.drop("n"), "aoi")
    step = f"{index} trend per {interval_days}-day step"
    facts = to_facts(summary, [
        ("observations", "ts_observations", "Usable observations", "dates", "dates with enough valid coverage"),
        ("mean", "ts_mean", f"Mean {index} across the series", None, "mean of the scene means"),
        ("first", "ts_first", f"{index} at series start", None, "scene mean on the earliest usable date"),
        ("last", "ts_last", f"{index} at series end", None, "scene mean on the latest usable date"),
        ("net_change", "ts_net_change", f"Net {index} change over the series", None, "last minus first"),
        ("slope_per_step", "ts_slope_per_step", step, None, "least squares over the usable dates"),
        ("slope_per_year", "ts_slope_per_year", f"{index} trend per year", None, f"slope scaled by 365/{interval_days}"),
        ("r2", "ts_r2", "Trend fit R²", None, "coefficient of determination"),
        ("max", "ts_max", f"Highest {index}", None, "maximum of the scene means"),
        ("min", "ts_min", f"Lowest {index}", None, "minimum of the scene means")], "timeseries_analyzer", by="aoi")
    named = summary.where("observations > 0").withColumn("index_name", F.lit(index))
    texts = to_text_facts(named, [("index_name", "ts_index", "Index of the series", "the index that was asked for")], "timeseries_analyzer", by="aoi")
    facts = texts.unionByName(facts, allowMissingColumns=True)
    return {"series": rows, "trend": trend, "summary": summary, "facts": facts}
