"""Two-date change over co-observed pixels (columns b_<band>, a_<band>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import CHANGE_THRESHOLD_FLOOR, CLASSES
from ..functions.indices import index_expr
from ..functions.numbers import half_even
from .otsu import otsu
from .stats import attach, exact_quantiles, histogram

KEY = ["pair_id"]


def change_magnitude(bands: list[str]) -> Column:
    """Length of the change vector over the bands both dates have."""
    squares = [F.coalesce((F.col("a_" + b) - F.col("b_" + b)) * (F.col("a_" + b) - F.col("b_" + b)), F.lit(0.0))
               for b in sorted(bands)]
    return F.sqrt(sum(squares[1:], squares[0]))


def change_vector_analysis(pair: DataFrame, bands: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pixels with magnitude and changed, threshold per pair)."""
    measured = pair.withColumn("magnitude", change_magnitude(bands))
    cut = otsu(measured, KEY, "magnitude").select(
        *KEY, F.greatest("threshold", F.lit(CHANGE_THRESHOLD_FLOOR)).alias("threshold"), F.col("n").alias("co_observed"))
    out = attach(measured, cut.select(*KEY, "threshold"), KEY).withColumn("changed", F.col("magnitude") > F.col("threshold"))
    return out.drop("threshold"), cut


def transition_counts(labels: DataFrame, before: str = "b_class", after: str = "a_class") -> DataFrame:
    """Pixels per (pair, from, to); everything below works on these few rows."""
    return labels.where(F.col(before).isNotNull() & F.col(after).isNotNull()).groupBy(
        *KEY, F.col(before).alias("from_class"), F.col(after).alias("to_class")).agg(F.count("*").alias("pixels"))


def transition_matrix(counts: DataFrame, pixel_km2: DataFrame, top_changed: int | None = 8) -> DataFrame:
    """Changed transitions first, largest first; class order breaks ties. Without ``top_changed`` every transition stays."""
    order = F.array(*map(F.lit, CLASSES))
    per_pair = Window.partitionBy(*KEY)
    is_change = F.col("from_class") != F.col("to_class")
    ranked = per_pair.partitionBy(*KEY, "is_change").orderBy(
        F.desc("pixels"), F.array_position(order, F.col("from_class")), F.array_position(order, F.col("to_class")))
    keep = F.lit(True) if top_changed is None else ~F.col("is_change") | (F.col("rank") <= top_changed)
    return (
        counts.withColumn("total", F.sum("pixels").over(per_pair)).withColumn("is_change", is_change)
        .withColumn("rank", F.row_number().over(ranked)).where(keep)
        .join(pixel_km2, KEY, "left")
        .select(*KEY, "from_class", "to_class", "pixels", "is_change", "rank",
                half_even(F.col("pixels") * F.col("pixel_km2"), 4).alias("area_km2"),
                half_even(F.col("pixels") / F.col("total"), 6).alias("fraction_of_scene")))


def class_deltas(counts: DataFrame, pixel_km2: DataFrame) -> DataFrame:
    """Before/after pixels, areas, shares and relative change of every class seen."""
    side = F.array(
        F.struct(F.col("from_class").alias("class"), F.col("pixels").alias("b"), F.lit(0).cast("bigint").alias("a")),
        F.struct(F.col("to_class").alias("class"), F.lit(0).cast("bigint").alias("b"), F.col("pixels").alias("a")))
    sums = counts.select(*KEY, F.inline(side)).groupBy(*KEY, "class").agg(
        F.sum("b").alias("pixels_before"), F.sum("a").alias("pixels_after"))
    total = F.sum("pixels_before").over(Window.partitionBy(*KEY))
    b, a, km2 = F.col("pixels_before"), F.col("pixels_after"), F.col("pixel_km2")
    return sums.withColumn("total", total).join(pixel_km2, KEY, "left").select(
        *KEY, "class", "pixels_before", "pixels_after", (a - b).alias("delta_pixels"),
        half_even(b * km2, 4).alias("area_before_km2"), half_even(a * km2, 4).alias("area_after_km2"),
        half_even((a - b) * km2, 4).alias("delta_area_km2"),
        half_even(b / F.col("total"), 6).alias("fraction_before"), half_even(a / F.col("total"), 6).alias("fraction_after"),
        F.when(b > 0, half_even((a - b) / b * 100.0, 2)).alias("relative_change_pct"))


def index_deltas(pair: DataFrame, names: list[str]) -> DataFrame:
    """Long (pair_id, metric, before, after, v) with v = after - before."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("metric"), index_expr(n, "b_").alias("before"), index_expr(n, "a_").alias("after")) for n in names])
    return pair.select(*KEY, F.inline(rows)).withColumn("v", F.col("after") - F.col("before")).where("v IS NOT NULL")


def delta_stats(deltas: DataFrame) -> DataFrame:
    """Distribution of each index change per pair."""
    by = [*KEY, "metric"]
    v = F.col("v")
    direct = deltas.groupBy(*by).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.avg((v > 0.05).cast("double")).alias("fraction_increased"),
        F.avg((v < -0.05).cast("double")).alias("fraction_decreased"),
        F.avg("before").alias("before_mean"), F.avg("after").alias("after_mean"), F.count("*").alias("n"))
    return direct.join(exact_quantiles(deltas, by, "v", {"median": 0.5, "p10": 0.1, "p90": 0.9}), by)


def delta_histogram(deltas: DataFrame, bins: int = 40) -> DataFrame:
    return histogram(deltas, [*KEY, "metric"], "v", bins, -1.0, 1.0)


__all__ = ["change_magnitude", "change_vector_analysis", "class_deltas", "delta_histogram", "delta_stats", "index_deltas",
           "transition_counts", "transition_matrix"]
