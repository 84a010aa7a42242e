"""Rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column | str, digits: int) -> Column:
    """Round half to even at ``digits`` decimals, as floating point, inside codegen."""
    value = F.col(value) if isinstance(value, str) else value
    return F.rint(value * float(10**digits)) / float(10**digits)
