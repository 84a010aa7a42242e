"""Geometry of north-up EPSG:4326 grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import KM_PER_DEG_LAT, KM_PER_DEG_LON
from .numbers import half_even


def pixel_lon(col: Column, width="width", west="west", east="east") -> Column:
    return F.col(west) + (col + 0.5) / F.col(width) * (F.col(east) - F.col(west))


def pixel_lat(row: Column, height="height", south="south", north="north") -> Column:
    return F.col(north) - (row + 0.5) / F.col(height) * (F.col(north) - F.col(south))


def bbox_area_km2(west="west", south="south", east="east", north="north") -> Column:
    w, s, e, n = (F.col(c) for c in (west, south, east, north))
    dy = (n - s) * KM_PER_DEG_LAT
    dx = (e - w) * KM_PER_DEG_LON * F.cos(F.radians((s + n) / 2.0))
    return F.abs(dx * dy)


def pixel_area_km2() -> Column:
    """Ground area per pixel; NULL for a scene without a box."""
    return bbox_area_km2() / F.greatest(F.col("width") * F.col("height"), F.lit(1))


def gsd_m() -> Column:
    return F.sqrt(pixel_area_km2()) * 1000.0


def area_of(pixels: Column) -> Column:
    """km2 to 4 decimals, NULL when the scene has no position."""
    return half_even(pixels * pixel_area_km2(), 4)


def area_unit() -> Column:
    return F.when(F.col("west").isNull(), F.lit("pixels")).otherwise(F.lit("km2"))


def region_location(lon: Column, lat: Column, x: Column, y: Column) -> Column:
    """Geographic centroid where known, pixel centroid otherwise."""
    return F.when(
        lon.isNotNull(), F.format_string("%.4f, %.4f", lon, lat)
    ).otherwise(F.format_string("pixel %.0f, %.0f", x, y))


def clamp_bbox(min_span: float = 0.2, max_span: float = 12.0) -> dict[str, Column]:
    """Widen thin boxes, clip to the usable globe, then cap the span."""

    def axis(lo: str, hi: str, limit: float):
        a, b = F.col(lo), F.col(hi)
        mid, thin = (a + b) / 2.0, (b - a) < min_span
        a = F.greatest(F.when(thin, mid - min_span / 2).otherwise(a), F.lit(-limit))
        b = F.least(F.when(thin, mid + min_span / 2).otherwise(b), F.lit(limit))
        mid, wide = (a + b) / 2.0, (b - a) > max_span
        return (F.when(wide, mid - max_span / 2).otherwise(a),
                F.when(wide, mid + max_span / 2).otherwise(b))

    west, east = axis("west", "east", 180.0)
    south, north = axis("south", "north", 85.0)
    return {"west": west, "south": south, "east": east, "north": north}


def corner_offset(a: str, b: str) -> Column:
    """Largest difference between two boxes' corners; NULL unless both have one."""
    gaps = [F.abs(F.col(a + k) - F.col(b + k)) for k in ("west", "south", "east", "north")]
    both = F.col(a + "west").isNotNull() & F.col(b + "west").isNotNull()
    return F.when(both, F.greatest(*gaps))
