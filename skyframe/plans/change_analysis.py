"""What changed between two dates, and where (C7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CLASS_LABELS
from ..functions.geo import area_of, pixel_area_km2
from ..functions.indices import index_expr
from ..operators import change, pairing
from ..operators.facts import to_facts
from ..operators.landcover import apply_multispectral, multispectral_thresholds
from ..operators.stats import attach
from ..session import materialise
from .products import Products
from .regions import change_regions

KEY = ["pair_id"]
INDICES = ("NDVI", "MNDWI", "NBR", "NDBI")


def both_classes(both: DataFrame, bands: list[str]) -> DataFrame:
    """(pair_id, r, c, b_class, a_class): cuts are found for the two dates of each pair apart, and both dates labelled on the joined row."""
    sides = {"b": "b_", "a": "a_"}
    names = {mark: F.concat(F.col("pair_id").cast("string"), F.lit(mark)).alias("scene_id") for mark in sides}
    dates = [both.select(names[mark], *[F.col(prefix + b).alias(b) for b in bands]) for mark, prefix in sides.items()]
    cuts = multispectral_thresholds(dates[0].unionByName(dates[1]))
    rows = both
    for mark, prefix in sides.items():
        others = [c for c in rows.columns if c not in {prefix + b for b in bands}]
        plain = rows.select(*others, names[mark], *[F.col(prefix + b).alias(b) for b in bands])
        rows = apply_multispectral(plain, cuts).drop("scene_id", *bands).withColumnRenamed("class", f"{prefix}class")
    return rows.select(*KEY, "r", "c", "b_class", "a_class")


def change_analysis(pixels: DataFrame, pairs: DataFrame, scenes: DataFrame, bands: list[str], indices=INDICES,
                    max_regions: int = 6, min_pixels: int = 40, min_overlap: float = 0.02) -> Products:
    """The change products of every pair, each planned when it is asked for.

    ``pairs`` is (pair_id, first_id, second_id); ``scenes`` gives grid and box per
    pair_id. The pixel join is the only large shuffle; its result is written once and
    every product reads the columns it needs from it.
    """
    grid = scenes.select(*KEY, "width", "height", "west", "south", "east", "north")

    def gate(p: Products) -> DataFrame:
        overlap = p["co_observed"].groupBy(*KEY).agg(F.count("*").alias("co_observed")).join(grid, KEY).withColumn(
            "overlap", F.col("co_observed") / (F.col("width") * F.col("height")))
        return materialise(pairing.coverage_gate(overlap, "overlap", min_overlap, 0.5).select(*KEY, "overlap", "partial"), "change-gate")

    def cuts(p: Products) -> DataFrame:
        return materialise(change.change_vector_analysis(p["both"], bands)[1], "change-cuts")

    def measured(p: Products) -> DataFrame:
        return attach(p["both"].withColumn("magnitude", change.change_magnitude(bands)), p["cuts"], KEY).withColumn("changed", F.col("magnitude") > F.col("threshold"))

    def summary(p: Products) -> DataFrame:
        counts = p["measured"].groupBy(*KEY).agg(F.first("threshold").alias("threshold"), F.count("*").alias("valid_pixels"), F.count_if("changed").alias("changed_pixels"))
        return counts.join(grid, KEY).join(p["gate"], KEY).withColumns({
            "changed_fraction": F.col("changed_pixels") / F.col("valid_pixels"), "changed_km2": area_of(F.col("changed_pixels")),
            "confidence": F.lit(0.78)}).drop("width", "height", "west", "south", "east", "north")

    def regions(p: Products) -> DataFrame:
        direction = (index_expr("NDVI", "a_") - index_expr("NDVI", "b_")).alias("delta")
        return change_regions(p["measured"].where("changed").select(*KEY, "r", "c", direction), grid, KEY, "delta", max_regions, min_pixels)

    km2 = grid.select(*KEY, pixel_area_km2().alias("pixel_km2"))
    return Products({
        "co_observed": lambda p: materialise(pairing.co_observe(pixels, pairs, bands), "co-observed"),
        "gate": gate, "both": lambda p: attach(p["co_observed"], p["gate"].select(*KEY), KEY), "cuts": cuts, "measured": measured, "summary": summary,
        "counts": lambda p: materialise(change.transition_counts(both_classes(p["both"], bands)), "transitions"),
        "transitions": lambda p: change.transition_matrix(p["counts"], km2, None), "class_deltas": lambda p: change.class_deltas(p["counts"], km2),
        "delta_stats": lambda p: change.delta_stats(change.index_deltas(p["both"], list(indices))), "regions": regions,
        "facts": lambda p: change_facts(p["summary"], p["class_deltas"], p["delta_stats"]),
    }, ["summary", "transitions", "class_deltas", "delta_stats", "regions", "facts"])


def change_facts(summary: DataFrame, class_deltas: DataFrame, delta_stats: DataFrame) -> DataFrame:
    """Facts of the three change tables, keyed by pair."""
    names = F.create_map(*[F.lit(x) for kv in CLASS_LABELS.items() for x in kv])
    overall = to_facts(summary, [
        ("changed_fraction", "change_fraction", "Share of observed area that changed", "fraction", "{changed_pixels} of {valid_pixels} co-observed pixels"),
        ("changed_pixels", "change_pixels", "Changed pixels", "pixels", "change vectors longer than the threshold"),
        ("threshold", "change_threshold", "CVA change threshold", None, "Otsu cut on the change-vector magnitude"),
        ("valid_pixels", "coobserved_pixels", "Pixels observed on both dates", "pixels", "intersection of the validity masks"),
        ("overlap", "coobserved_fraction", "Overlap of the two observations", "fraction", "co-observed pixels of all pixels"),
        ("changed_km2", "change_area_km2", "Changed area", "km2", "pixels by ground area per pixel")], "change_analyzer", by="pair_id")
    per_index = to_facts(delta_stats.withColumn("m", F.lower("metric")), [
        (col, "d{m}_" + key, "{metric} " + label, unit, "difference over {n} co-observed pixels") for col, key, label, unit in (
            ("mean", "mean", "mean change", None), ("before_mean", "before", "mean before", None), ("after_mean", "after", "mean after", None),
            ("fraction_increased", "increased", "share increased", "fraction"), ("fraction_decreased", "decreased", "share decreased", "fraction"))],
        "change_analyzer", by="pair_id")
    per_class = to_facts(class_deltas.withColumn("label", F.element_at(names, F.col("class"))), [
        ("fraction_before", "{class}_fraction_before", "{label} share before", "fraction", "{pixels_before} px before"),
        ("fraction_after", "{class}_fraction_after", "{label} share after", "fraction", "{pixels_after} px after"),
        ("delta_area_km2", "{class}_delta_area_km2", "{label} area change", "km2", "area after minus area before"),
        ("relative_change_pct", "{class}_relative_change_pct", "{label} relative change", "percent", "pixel change relative to before")],
        "change_analyzer", by="pair_id")
    return overall.unionByName(per_index).unionByName(per_class)
