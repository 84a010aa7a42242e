"""Pairing scenes, dates and sensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import corner_offset
from ..functions.numbers import half_even
from .stats import attach


def co_observe(pixels: DataFrame, pairs: DataFrame, values: list[str], first: str = "b_", second: str = "a_",
               other: DataFrame | None = None) -> DataFrame:
    """Pixels seen in both members of each pair.

    ``pairs`` has (pair_id, first_id, second_id). The join key is the pixel, not the
    pair, so one very large pair spreads over all partitions like any other.
    """
    def side(px: DataFrame, member: str, prefix: str) -> DataFrame:
        if "valid" in px.columns:
            px = px.where("valid")
        ids = pairs.select("pair_id", F.col(member).alias("scene_id"))
        cells = px.select("scene_id", "r", "c", *[F.col(v).alias(prefix + v) for v in values])
        return attach(cells, ids, ["scene_id"]).drop("scene_id")

    return side(pixels, "first_id", first).join(
        side(pixels if other is None else other, "second_id", second), ["pair_id", "r", "c"])


def consecutive_pairs(scenes: DataFrame, by: str, order: str) -> DataFrame:
    """(pair_id, first_id, second_id): each scene with the next of its area."""
    return scenes.selectExpr(
        "scene_id AS pair_id", "scene_id AS first_id",
        f"lead(scene_id) OVER (PARTITION BY {by} ORDER BY {order}) AS second_id").where("second_id IS NOT NULL")


def coverage_gate(scene_stats: DataFrame, fraction: str, keep: float, warn: float | None = None) -> DataFrame:
    """Drop what was seen too little; flag what was seen little."""
    kept = scene_stats.where(F.col(fraction) >= keep)
    return kept if warn is None else kept.withColumn("partial", F.col(fraction) < warn)


# ------------------------------------------------------------------ date search
def date_candidates(requests: DataFrame, anchor: str, offsets: Column, today: Column | None = None) -> DataFrame:
    """One row per candidate date, none of them after today."""
    out = requests.withColumn("candidate", F.explode(F.transform(offsets, lambda k: F.date_add(F.col(anchor), k))))
    return out if today is None else out.where(F.col("candidate") <= today)


def nearest_first_dates(requests: DataFrame, anchor: str, span: int, step: int = 1, today: Column | None = None) -> DataFrame:
    """Candidates numbered nearest first, the earlier of two equally near dates first."""
    steps = [0] + [s * k for k in range(step, span + 1, step) for s in (-1, 1)]
    offsets = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("offset")) for i, k in enumerate(steps)])
    out = requests.select("*", F.inline(offsets)).withColumn("candidate", F.date_add(F.col(anchor), F.col("offset")))
    return out if today is None else out.where(F.col("candidate") <= today)


def _window(span: int, step: int = 1) -> Column:
    return F.sequence(F.lit(-span), F.lit(span), F.lit(step))


def nearest_usable_date(requests: DataFrame, probes: DataFrame, anchor: str = "anchor", on: tuple[str, ...] = ("layer_key",),
                        span: int = 12, min_coverage: float = 0.5, min_clear: float = 0.30,
                        today: Column | None = None) -> DataFrame:
    """Most usable observed date within ±span days, nearest then earliest on ties.

    The interval join is an equi-join on the candidate date, and it runs once per
    distinct (keys, anchor), however many requests share one.
    """
    keys = [*on, anchor]
    anchors = requests.select(*keys).distinct()
    seen = probes.where((F.col("coverage") >= min_coverage) & (F.col("dark_fraction") < 0.5)).withColumn(
        "usable", F.col("coverage") * (1 - F.col("cloud_fraction")) * (1 - F.col("dark_fraction")))
    best = (
        date_candidates(anchors, anchor, _window(span), today)
        .join(seen.withColumnRenamed("probe_date", "candidate"), [*on, "candidate"])
        .groupBy(*keys).agg(F.min(F.struct(
            (-F.col("usable")).alias("rank"), F.abs(F.datediff("candidate", anchor)).alias("gap_days"),
            F.col("candidate").alias("selected"), F.col("cloud_fraction"))).alias("best"))
        .select(*keys, "best.selected", (-F.col("best.rank")).alias("usable"), "best.gap_days", "best.cloud_fraction"))
    status = F.when(F.col("usable") >= min_clear, "clear").when(F.col("usable").isNotNull(), "cloudy").otherwise("none")
    return requests.join(best, keys, "left").withColumn("status", status)


def search_optical(requests: DataFrame, probes: DataFrame, anchor: str = "anchor", span: int = 10,
                   primary: str = "modis_terra_truecolor", fallback: str = "viirs_snpp_truecolor",
                   today: Column | None = None, area: tuple[str, ...] = ()) -> DataFrame:
    """Primary sensor, or the fallback where the primary is missing or hazy and the fallback is clearer.

    ``area`` names the columns that tell areas apart in requests and probes.
    """
    keys = [*area, anchor]

    def sensor(key: str, tag: str) -> DataFrame:
        anchors = requests.select(*keys).distinct().withColumn("layer_key", F.lit(key))
        found = nearest_usable_date(anchors, probes, anchor, (*area, "layer_key"), span, min_coverage=0.6, today=today)
        return found.select(*keys, *[F.col(c).alias(tag + c) for c in ("selected", "usable", "cloud_fraction")])

    both = sensor(primary, "p_").join(sensor(fallback, "f_"), keys, "full_outer")
    weak = F.col("p_usable").isNull() | (F.col("p_usable") < 0.30)
    swap = weak & F.col("f_usable").isNotNull() & (F.col("f_usable") > F.coalesce("p_usable", F.lit(0.0)))
    choice = both.select(
        *keys, F.when(swap, F.lit(fallback)).when(F.col("p_selected").isNotNull(), F.lit(primary)).alias("layer_key"),
        *[F.when(swap, F.col("f_" + c)).otherwise(F.col("p_" + c)).alias(c) for c in ("selected", "usable", "cloud_fraction")])
    return requests.join(choice, keys, "left").withColumn("warn_cloud", F.coalesce(F.col("usable") < 0.30, F.lit(False)))


def _best_cover(candidates: DataFrame, probes: DataFrame, anchor: str, area: tuple[str, ...]) -> DataFrame:
    seen = probes.where(F.col("coverage") >= 0.5).select(*area, F.col("probe_date").alias("candidate"), "coverage")
    return candidates.join(seen, [*area, "candidate"]).groupBy(*area, anchor).agg(F.min(F.struct(
        (-F.col("coverage")).alias("rank"), F.abs(F.datediff("candidate", anchor)).alias("gap_days"),
        F.col("candidate").alias("selected"))).alias("best")).select(
        *area, anchor, "best.selected", (-F.col("best.rank")).alias("coverage"), "best.gap_days")


def search_sar(requests: DataFrame, probes: DataFrame, anchor: str = "anchor", wide_span: int = 150,
               today: Column | None = None, area: tuple[str, ...] = ()) -> DataFrame:
    """Repeat-cycle dates first; a wide sweep only for the anchors of an area the cycle left unmatched."""
    keys = [*area, anchor]
    anchors = requests.select(*keys).distinct()
    cycle = sorted({12 * k for k in range(-4, 5)} | {-18, -6, 6, 18})
    first = _best_cover(date_candidates(anchors, anchor, F.array(*map(F.lit, cycle)), today), probes, anchor, area)
    rest = anchors.join(first, keys, "left_anti")
    second = _best_cover(date_candidates(rest, anchor, _window(wide_span, 3), today), probes, anchor, area)
    found = first.withColumn("phase", F.lit(1)).unionByName(second.withColumn("phase", F.lit(2)))
    return requests.join(found, keys, "left").withColumn("warn_gap", F.coalesce(F.col("gap_days") > 20, F.lit(False)))


def pair_nearest_optical(sar: DataFrame, probes: DataFrame, sar_date: str = "sar_date", span: int = 4, area: tuple[str, ...] = ()) -> DataFrame:
    """Optical member of a cross-modal pair, within ±span days of the radar date."""
    out = search_optical(sar, probes, sar_date, span, area=area)
    return out.withColumn("pair_gap_days", F.abs(F.datediff("selected", sar_date)))


def probe_log(*logs: DataFrame) -> DataFrame:
    """All probes of several searches, repeats included."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out


# --------------------------------------------------------------- compatibility
def scene_pairs(pairs: DataFrame, scenes: DataFrame) -> DataFrame:
    """Pair list with the columns of both scenes, prefixed first_/second_."""
    def member(prefix: str) -> DataFrame:
        return scenes.select(*[F.col(c).alias(prefix + ("id" if c == "scene_id" else c)) for c in scenes.columns])

    return pairs.join(member("first_"), "first_id").join(member("second_"), "second_id")


def pair_compatibility(paired: DataFrame) -> DataFrame:
    """May the two scenes be compared, and as what?"""
    same_grid = (F.col("first_width") == F.col("second_width")) & (F.col("first_height") == F.col("second_height"))
    offset = corner_offset("first_", "second_")
    located = F.col("first_west").isNotNull().cast("int") + F.col("second_west").isNotNull().cast("int")
    shared = F.array_sort(F.array_intersect("first_bands", "second_bands"))
    a, b = F.col("first_modality"), F.col("second_modality")
    optical = ("optical", "multispectral")
    crossed = (a != b) & ((a == "sar") & b.isin(*optical) | (b == "sar") & a.isin(*optical))
    issues = F.array_compact(F.array(
        F.when(~same_grid, "grids differ"), F.when(offset >= 1e-4, "extents differ"),
        F.when(F.size(shared) == 0, "no shared bands")))
    warnings = F.array_compact(F.array(
        F.when(located == 1, "one scene has no position"), F.when(located == 0, "neither scene has a position"),
        F.when((a == b) & (F.col("first_acq_date") == F.col("second_acq_date")), "same acquisition date"),
        F.when((a != b) & ~crossed, "mixed modalities treated as a temporal pair")))
    return paired.withColumns({
        "same_grid": same_grid, "max_corner_offset_deg": half_even(offset, 8), "shared_bands": shared,
        "configuration": F.when(crossed, "cross_modal_pair").otherwise("bitemporal_pair"),
        "co_registered": F.coalesce(offset < 1e-4, (located == 0) & same_grid),
        "issues": issues, "warnings": warnings,
        "swap": ~crossed & F.coalesce(F.col("first_acq_date") > F.col("second_acq_date"), F.lit(False)),
    }).withColumn("compatible", F.size("issues") == 0)


def check_coregistration(paired: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Same grid and the same corners to within ``tolerance`` degrees."""
    same_shape = (F.col("first_width") == F.col("second_width")) & (F.col("first_height") == F.col("second_height"))
    gap = F.coalesce(corner_offset("first_", "second_"), F.lit(0.0))
    return paired.withColumns({
        "same_shape": same_shape, "max_corner_offset_deg": half_even(gap, 9), "same_extent": gap <= tolerance,
        "co_registered": same_shape & (gap <= tolerance)})


def comparison_anchors(dates: Column, today: Column) -> dict[str, Column]:
    """First and last of two or more dates; one date against a year before; else a recent year."""
    n = F.size(dates)
    last = F.element_at(dates, -1)
    recent = F.date_sub(today, 5)
    after = F.when(n >= 1, last).otherwise(recent)
    return {
        "before": F.when(n >= 2, F.element_at(dates, 1)).otherwise(F.date_sub(after, 365)),
        "after": after,
        "rule": F.when(n >= 2, "two dates").when(n == 1, "one date, a year earlier").otherwise("no date, past year"),
    }
