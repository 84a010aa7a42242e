"""Otsu's threshold with its separability, for many groups in two map-combined passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import OTSU_BINS, OTSU_MIN_VALUES
from ..session import materialise
from .stats import attach, usable


def cumulative_histogram(binned: DataFrame, by: list[str]) -> DataFrame:
    """Running count and running odd-bin sum along the bins of each key.

    Bin k contributes its centre in half-bin units, 2k+1, so every sum is an exact
    integer and the chosen cut cannot depend on the order of addition.
    """
    key = ", ".join(by)
    upto = f"OVER (PARTITION BY {key} ORDER BY bin ROWS UNBOUNDED PRECEDING)"
    return binned.selectExpr(
        "*", f"sum(n) {upto} AS n0", f"sum(n * (2 * bin + 1)) {upto} AS s0",
        f"sum(n) OVER (PARTITION BY {key}) AS n_all", f"sum(n * (2 * bin + 1)) OVER (PARTITION BY {key}) AS s_all")


def otsu(df: DataFrame, by: list[str], value: str, bins: int = OTSU_BINS) -> DataFrame:
    """(by…, threshold, eta, n): bin centre of the first best cut, and eta in 0..1.

    Groups under 16 values get their median and eta 0; a constant group gets its
    value and eta 0.
    """
    rows = df.where(usable(F.col(value))).selectExpr(*by, f"double({value}) AS _v")
    span = rows.groupBy(*by).agg(F.expr("min(_v) AS _lo"), F.expr("max(_v) AS _hi"),
                                 F.expr("count(1) AS _n"), F.expr("var_pop(_v) AS _var"))
    # written out, so that its size and not that of the pixels decides how it meets them
    span = materialise(span, "otsu_span")
    small, flat = f"_n < {OTSU_MIN_VALUES}", "_hi - _lo < 1e-9"
    binned = (
        attach(rows, span, by)
        # at most 15 values of a small group keep their identity, for the median
        .selectExpr(
            *by, "_lo", "_hi", "_n", "_var", f"CASE WHEN {small} THEN _v END AS _small",
            f"CASE WHEN {flat} THEN 0L ELSE least(floor((_v - _lo) / (_hi - _lo) * {bins}), {bins - 1}L) END AS bin")
        .groupBy(*by, "_lo", "_hi", "_n", "_var", "bin", "_small").agg(F.expr("count(1) AS n"))
    )
    share = "(n0 / n_all) * ((n_all - n0) / n_all)"
    gap = "power(s0 / n0 - (s_all - s0) / (n_all - n0), 2)"
    best = cumulative_histogram(binned, by).groupBy(*by).agg(
        F.expr(f"max(struct(CASE WHEN n_all > n0 THEN {share} * {gap} ELSE 0D END AS score, -bin AS at)) AS _best"),
        F.expr("first(_lo) AS _lo"), F.expr("first(_hi) AS _hi"), F.expr("first(_n) AS _n"),
        F.expr("first(_var) AS _var"), F.expr("percentile(_small, 0.5, n) AS _median"))
    return best.selectExpr(
        *by,
        f"CASE WHEN {small} THEN _median WHEN {flat} THEN _lo "
        f"ELSE _lo + (0.5D - _best.at) * ((_hi - _lo) / {bins}) END AS threshold",
        f"CASE WHEN {small} OR {flat} OR _var <= 1e-12 THEN 0D "
        f"ELSE least(greatest(_best.score * power((_hi - _lo) / {2 * bins}, 2) / _var, 0D), 1D) END AS eta",
        "_n AS n")
