"""Index time series over date spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_spine(areas: DataFrame, anchor: str, steps: int = 8, interval_days: int = 30) -> DataFrame:
    """``steps`` dates back from the anchor, ``interval_days`` apart."""
    back = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.date_sub(F.col(anchor), k * interval_days))
    return areas.withColumn("d", F.explode(back))


def sar_repeat_dates(requests: DataFrame, anchor: str, count: int = 6, cycle: int = 12, today: Column | None = None) -> DataFrame:
    out = requests.withColumn("d", F.explode(F.transform(
        F.sequence(F.lit(-count), F.lit(count)), lambda k: F.date_add(F.col(anchor), k * cycle))))
    return out if today is None else out.where(F.col("d") <= today)


def time_series(spine: DataFrame, observed: DataFrame, by: str, min_coverage: float = 0.25) -> DataFrame:
    """Every wanted date with its status; nothing is interpolated."""
    status = F.when(F.col("coverage").isNull(), "no_data").when(
        F.col("coverage") < min_coverage, "low_coverage").otherwise("ok")
    return spine.join(observed, [by, "d"], "left").withColumn("status", status)


def missing_dates(series: DataFrame, by: str) -> DataFrame:
    """Wanted dates without a usable observation."""
    ok = series.where("status = 'ok'").select(by, "d")
    return series.select(by, "d", "status").join(ok, [by, "d"], "left_anti")


def usable_position(series: DataFrame, by: str) -> DataFrame:
    """Usable dates with x = position among them, 0-based."""
    return series.where("status = 'ok'").selectExpr("*", f"row_number() OVER (PARTITION BY {by} ORDER BY d) - 1 AS x")


def ols_trend(series: DataFrame, by: str, interval_days: int = 30, minimum: int = 3) -> DataFrame:
    """Least-squares trend of the usable means, per step and per year.

    ``slope_per_day`` uses real day distances, so gaps do not bias it.
    """
    fit = usable_position(series, by).groupBy(by).agg(
        F.count("*").alias("n"), F.regr_slope("mean", "x").alias("slope_per_step"),
        F.regr_intercept("mean", "x").alias("intercept"), F.regr_r2("mean", "x").alias("_r2"),
        F.var_pop("mean").alias("_var"),
        F.regr_slope("mean", F.datediff("d", F.lit("1970-01-01").cast("date"))).alias("slope_per_day"))
    return fit.where(F.col("n") >= minimum).select(
        by, "n", "slope_per_step", "intercept", "slope_per_day",
        (F.col("slope_per_step") * (365.0 / interval_days)).alias("slope_per_year"),
        F.when(F.col("_var") * F.col("n") > 1e-12, F.col("_r2")).otherwise(0.0).alias("r2"))


def series_summary(series: DataFrame, by: str) -> DataFrame:
    """First, last, net change, extremes with their dates, and mean, in one aggregate."""
    ok = series.where("status = 'ok'")
    return ok.groupBy(by).agg(
        F.count("*").alias("observations"), F.avg("mean").alias("mean"),
        F.min_by("mean", "d").alias("first"), F.max_by("mean", "d").alias("last"),
        F.min(F.struct(F.col("mean").alias("v"), "d")).alias("_lo"),
        F.max(F.struct(F.col("mean").alias("v"), (-F.datediff("d", F.lit("1970-01-01").cast("date"))).alias("k"), "d")).alias("_hi"),
    ).select(by, "observations", "mean", "first", "last", (F.col("last") - F.col("first")).alias("net_change"),
             F.col("_hi.v").alias("max"), F.col("_hi.d").alias("max_date"), F.col("_lo.v").alias("min"),
             F.col("_lo.d").alias("min_date"),
             F.least(F.lit(0.9), 0.4 + 0.06 * F.col("observations")).alias("confidence"))
