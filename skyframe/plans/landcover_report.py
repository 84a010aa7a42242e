"""Land-cover composition with areas, as rows and as facts (C4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CLASS_LABELS
from ..functions.geo import area_of, bbox_area_km2
from ..functions.numbers import half_even
from ..operators.facts import to_facts
from ..operators.landcover import class_composition, segment_any


def landcover_report(pixels: DataFrame, scenes: DataFrame, adaptive: bool = True) -> dict[str, DataFrame]:
    """Labels, the composition table (shares above 0.05 %), and facts."""
    labels = segment_any(pixels, adaptive)
    comp = class_composition(labels, ["scene_id", "basis"]).join(
        scenes.select("scene_id", "width", "height", "west", "south", "east", "north"), "scene_id")
    names = F.create_map(*[F.lit(x) for kv in CLASS_LABELS.items() for x in kv])
    comp = comp.withColumns({
        "label": F.element_at(names, F.col("class")), "area_km2": area_of(F.col("pixels")),
        "scene_km2": half_even(bbox_area_km2(), 2),
        "confidence": F.when(F.col("basis") == "rgb", 0.62).otherwise(0.82)})
    shown = comp.where("fraction > 0.0005").select(
        "scene_id", "basis", "class", "label", "pixels", half_even(F.col("fraction") * 100, 2).alias("percent"), "area_km2", "confidence")
    facts = to_facts(comp.where("pixels > 0"), [
        ("fraction", "{class}_fraction", "{label} share", "fraction", "{pixels} of {valid_pixels} valid pixels"),
        ("area_km2", "{class}_area_km2", "{label} area", "km2", "{pixels} px by ground area per pixel")], "landcover_segmenter", by="scene_id")
    scene = comp.groupBy("scene_id").agg(F.first("valid_pixels").alias("valid_pixels"), F.first("scene_km2").alias("scene_km2"))
    facts = facts.unionByName(to_facts(scene, [
        ("valid_pixels", "valid_pixels_primary", "Observed pixels", "pixels", "pixels with a valid observation"),
        ("scene_km2", "scene_area_km2", "Analysed area", "km2", "area of the bounding box")], "landcover_segmenter", by="scene_id"))
    return {"labels": labels, "composition": shown, "facts": facts}
