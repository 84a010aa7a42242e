"""Colour columns for rendered layers and their legends."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import (CHANGE_RGBA, CLASS_COLORS, CLASSES, EPS, FUSION_RGBA, PALETTES, SAR_RGBA)
from .indices import clamp


def _rgba(choices: list[tuple[Column, tuple]], channel: int) -> Column:
    out = F.lit(0)
    for condition, rgba in reversed(choices):
        out = F.when(condition, F.lit(rgba[channel])).otherwise(out)
    return out


def class_rgba(label: Column) -> dict[str, Column]:
    choices = [(label == name, (*CLASS_COLORS[name], 200)) for name in CLASSES]
    return {ch: _rgba(choices, i) for i, ch in enumerate(("cr", "cg", "cb", "ca"))}


def ramp_rgba(value: Column, lo: float, hi: float, palette: str, valid: Column) -> dict[str, Column]:
    """Piecewise-linear colour ramp; transparent where the pixel is not valid."""
    stops = PALETTES.get(palette, PALETTES["greys"])
    t = clamp((value - lo) / max(hi - lo, EPS), 0.0, 1.0)
    out = {}
    for i, ch in enumerate(("cr", "cg", "cb")):
        colour = F.lit(float(stops[-1][1][i]))
        for (x0, c0), (x1, c1) in reversed(list(pairwise(stops))):
            colour = F.when(t < x1, c0[i] + (t - x0) * ((c1[i] - c0[i]) / (x1 - x0))).otherwise(colour)
        out[ch] = F.floor(colour).cast("int")
    out["ca"] = F.when(valid, F.lit(210)).otherwise(F.lit(0))
    return out


def change_rgba(changed: Column, direction: Column) -> dict[str, Column]:
    choices = [(changed & direction.isNull(), CHANGE_RGBA["unsigned"]),
               (changed & (direction < 0), CHANGE_RGBA["loss"]),
               (changed & (direction >= 0), CHANGE_RGBA["gain"])]
    return {ch: _rgba(choices, i) for i, ch in enumerate(("cr", "cg", "cb", "ca"))}


def fusion_rgba(optical: Column, sar: Column) -> dict[str, Column]:
    choices = [(optical & sar, FUSION_RGBA["both"]), (optical & ~sar, FUSION_RGBA["optical_only"]),
               (sar & ~optical, FUSION_RGBA["sar_only"])]
    return {ch: _rgba(choices, i) for i, ch in enumerate(("cr", "cg", "cb", "ca"))}


def sar_rgba(water: Column, built: Column) -> dict[str, Column]:
    choices = [(built, SAR_RGBA["built_up"]), (water, SAR_RGBA["water"])]
    return {ch: _rgba(choices, i) for i, ch in enumerate(("cr", "cg", "cb", "ca"))}


def validity_alpha(valid: Column) -> Column:
    return F.when(valid, F.lit(255)).otherwise(F.lit(0))
