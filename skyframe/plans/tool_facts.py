"""Facts of the radar, fusion and scene-classifier tools."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.facts import to_facts, to_text_facts


def sar_facts(stats: DataFrame, by: str = "scene_id") -> DataFrame:
    """Facts from the rows of ``radar.sar_stats``."""
    return to_facts(stats, [
        ("mean_backscatter", "sar_mean_backscatter", "Mean relative backscatter", "relative gamma-0 (0-1)", "mean of {valid_pixels} filtered pixels"),
        ("median_backscatter", "sar_median_backscatter", "Median relative backscatter", "relative gamma-0 (0-1)", "median of the filtered pixels"),
        ("std_backscatter", "sar_std_backscatter", "Spread of the backscatter", None, "standard deviation of the filtered pixels"),
        ("water_fraction", "sar_water_fraction", "Radar water share", "fraction", "{water_pixels} of {valid_pixels} pixels under the water cut"),
        ("water_pixels", "sar_water_pixels", "Radar water pixels", "pixels", "pixels under the water cut"),
        ("builtup_fraction", "sar_builtup_fraction", "Radar built-up share", "fraction", "{builtup_pixels} pixels over the land-score cut"),
        ("mean_texture", "sar_mean_texture", "Mean texture", None, "mean local variation of the backscatter")], "sar_analyzer", by=by)


def fusion_facts(stats: DataFrame, by: str = "scene_id") -> DataFrame:
    """Facts from the rows of ``radar.fusion_stats``; areas only where the scene has a position."""
    return to_facts(stats, [
        ("iou", "fusion_iou", "Agreement of both sensors on water", None, "{agreement_pixels} pixels in both masks over those in either"),
        ("optical_water_fraction", "fusion_optical_water_fraction", "Optical water share", "fraction", "{optical_water_pixels} pixels of the optical mask"),
        ("sar_water_fraction", "fusion_sar_water_fraction", "Radar water share", "fraction", "{sar_water_pixels} pixels of the radar mask"),
        ("fused_water_fraction", "fusion_water_fraction", "Fused water share", "fraction", "{fused_water_pixels} of {valid_pixels} pixels"),
        ("optical_only_pixels", "fusion_optical_only_pixels", "Water only the optical sensor sees", "pixels", "optical mask without the radar mask"),
        ("sar_only_pixels", "fusion_sar_only_pixels", "Water only the radar sees", "pixels", "radar mask without the optical mask"),
        ("cloud_recovered_pixels", "fusion_cloud_recovered_pixels", "Water the radar finds under cloud", "pixels", "cloudy pixels in the radar mask"),
        ("valid_pixels", "fusion_coobserved_pixels", "Pixels both sensors see", "pixels", "pixels valid in both scenes"),
        ("fused_water_km2", "fusion_water_km2", "Fused water area", "km2", "{fused_water_pixels} pixels by their ground area"),
        ("cloud_recovered_km2", "fusion_cloud_recovered_km2", "Water area found under cloud", "km2", "{cloud_recovered_pixels} pixels by their ground area")],
        "optical_sar_fusion", by=by)


def classification_facts(summary: DataFrame, by: str = "scene_id") -> DataFrame:
    """Facts from the rows of ``classification.classify_scenes``."""
    numbers = to_facts(summary, [
        ("dominant_fraction", "rs_dominant_fraction", "Share of the dominant class", "fraction", "of {tiles} tiles"),
        ("tiles", "rs_tiles", "Classified tiles", "tiles", "tiles with enough valid pixels"),
        ("mean_confidence", "rs_mean_confidence", "Mean classifier confidence", "probability", "mean of the best class of each tile")],
        "rs_scene_classifier", by=by)
    names = to_text_facts(summary, [("dominant_class", "rs_dominant_class", "Dominant class", "most frequent class of {tiles} tiles")], "rs_scene_classifier", by=by)
    return names.unionByName(numbers, allowMissingColumns=True)
