"""Band naming, scaling and decimation at ingest."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators.stats import SENT, attach, exact_quantiles, usable
from ..session import materialise


def band_presets(spark: SparkSession) -> DataFrame:
    rows = [(n, i, b) for n, names in V.BAND_PRESETS.items() for i, b in enumerate(names)]
    return spark.createDataFrame(rows, "n_bands int, pos int, preset string")


def map_bands(described: DataFrame) -> DataFrame:
    """(scene_id, pos, band, mapping_source) from (scene_id, pos, n_bands, description).

    Descriptions count only when every band of the scene has a known one; otherwise
    names follow from the band count.
    """
    table = F.create_map(*[F.lit(x) for kv in V.BAND_DESCRIPTIONS.items() for x in kv])
    named = described.withColumn("_named", F.try_element_at(table, F.lower(F.trim(F.coalesce("description", F.lit(""))))))
    complete = named.groupBy("scene_id").agg(F.bool_and(F.col("_named").isNotNull()).alias("_all"))
    out = named.join(complete, "scene_id").join(band_presets(described.sparkSession), ["n_bands", "pos"], "left")
    other = F.concat(F.lit("band_"), (F.col("pos") + 1).cast("string"))
    return out.select("scene_id", "pos", F.when(F.col("_all"), F.col("_named")).otherwise(F.coalesce("preset", other)).alias("band"),
                      F.when(F.col("_all"), "file metadata").otherwise("inferred from band count").alias("mapping_source"))


#: Most rows of a group that one task holds; the statistics of a larger one are gathered from all tasks and sent to its rows.
HELD = 65_536


def _is_byte(lo: Column, hi: Column) -> Column:
    return (lo >= 0) & (hi <= 255) & (hi > 1.5)


def _is_flat(lo: Column, hi: Column) -> Column:
    return hi - lo < 1e-9


def _unit(v: Column, lo: Column, hi: Column) -> Column:
    return F.when(_is_flat(lo, hi), 0.0).otherwise((v - lo) / (hi - lo))


def _scaled(v: Column, lo: Column, hi: Column, p02: Column, p98: Column) -> Column:
    """``v`` in 0..1 by the range of its band, and by percentiles that are given in units of that range."""
    # the percentile range is compared in the units of the data
    dead = _is_flat(lo, hi) | ((p98 - p02) * (hi - lo) < 1e-9)
    return F.when(_is_byte(lo, hi), v / 255.0).when(dead, 0.0).otherwise(
        F.least(F.greatest((_unit(v, lo, hi) - p02) / (p98 - p02), F.lit(0.0)), F.lit(1.0)))


def _held(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """``rows`` with an array ``_scaled`` of the names, whose values are usable or null; each group is gathered in one task, by the only shuffle of rows."""
    group = Window.partitionBy(*by)
    lo, hi, p = ([f"_{k}_{i}" for i in range(len(names))] for k in ("lo", "hi", "p"))
    vs = [F.col(c).cast("double") for c in names]
    ranged = rows.withColumns({k: f(v).over(group) for ks, f in ((lo, F.min), (hi, F.max)) for k, v in zip(ks, vs, strict=True)})
    bounds = [(F.col(a), F.col(b)) for a, b in zip(lo, hi, strict=True)]
    stretch = [F.percentile(F.when(~_is_byte(*ends), _unit(v, *ends)), [0.02, 0.98]).over(group) for v, ends in zip(vs, bounds, strict=True)]
    out = ranged.withColumns(dict(zip(p, stretch, strict=True)))
    scaled = [_scaled(v, *ends, F.get(F.col(q), F.lit(0)), F.get(F.col(q), F.lit(1))) for v, ends, q in zip(vs, bounds, p, strict=True)]
    return out.withColumn("_scaled", F.array(*scaled)).drop(*lo, *hi, *p)


def _spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``rows`` with ``scaled``, for few groups of any size: their rows stay where they are."""
    v = F.col(value).cast("double")
    span = materialise(rows.groupBy(*by).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi")), "band-spans")
    n = span.count()
    ends = F.col("_lo"), F.col("_hi")
    placed = attach(rows, span, by, n=n).withColumn("_u", _unit(v, *ends))
    stretch = materialise(exact_quantiles(placed.where(~_is_byte(*ends)), by, "_u", {"_p02": 0.02, "_p98": 0.98}), "band-quantiles")
    out = attach(placed, stretch, by, "left", n=n)
    return out.withColumn("scaled", _scaled(v, *ends, F.col("_p02"), F.col("_p98"))).drop("_lo", "_hi", "_u", "_p02", "_p98")


def normalise_bands(values: DataFrame, by: list[str], value: str | list[str] = "v") -> DataFrame:
    """Scale each (scene, band) to 0..1: byte data by 255, anything else by its 2-98 percentiles.

    ``by`` tells bands apart and ``value`` names their column. Where a row holds several bands, ``value`` lists their columns and ``by``
    tells scenes apart; the result then has a row per ``band`` with its value ``v``, made after all shuffles. Rows without a key and
    values that are no number take no part. Groups of at most HELD rows, however many, cost one shuffle of rows; those of larger ones are not shuffled.
    """
    names = [value] if isinstance(value, str) else list(value)
    some = reduce(or_, [usable(F.col(c)) for c in names])
    rows = values.where(reduce(and_, [F.col(k).isNotNull() for k in by])).where(some)
    if not isinstance(value, str):
        rows = rows.withColumns({c: F.when(usable(F.col(c)), F.col(c)) for c in names})
    large = materialise(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > HELD).select(*by), "large-bands")
    n = large.count()
    sent = F.broadcast(large) if n <= SENT else large

    def bands_of(df: DataFrame, *more: Column) -> DataFrame:
        """A row per band and usable value; ``more`` are its further columns, as arrays over the bands."""
        parts = [F.struct(F.lit(c).alias("band"), F.col(c).alias("v"), *[F.get(m, F.lit(i)).alias("scaled") for m in more]) for i, c in enumerate(names)]
        return df.select(*[c for c in values.columns if c not in names], F.inline(F.array(*parts))).where("v IS NOT NULL")

    small = _held(rows if not n else rows.join(sent, by, "left_anti"), by, names)
    if isinstance(value, str):
        out = small.withColumn("scaled", F.get("_scaled", F.lit(0))).drop("_scaled")
        return out if not n else out.unionByName(_spread(rows.join(sent, by, "left_semi"), by, value))
    out = bands_of(small, F.col("_scaled"))
    return out if not n else out.unionByName(_spread(bands_of(rows.join(sent, by, "left_semi")), [*by, "band"], "v"))


def decimate(pixels: DataFrame, scenes: DataFrame, values: list[str], max_side: int = V.MAX_ANALYSIS_SIDE,
             max_pixels: int | None = None) -> DataFrame:
    """Average blocks so that the longer side fits; ``max_pixels`` refuses larger scenes."""
    kept = scenes if max_pixels is None else scenes.where(F.col("width").cast("bigint") * F.col("height") <= max_pixels)
    grid = kept.select(
        "scene_id", F.ceil(F.greatest("width", "height") / max_side).cast("int").alias("factor"), "width", "height")
    block = [F.expr(f"int({axis} div factor) AS {axis}") for axis in ("r", "c")]
    return (
        attach(pixels, grid, ["scene_id"]).where(F.expr("r div factor < height div factor AND c div factor < width div factor"))
        .groupBy("scene_id", "factor", *block).agg(*[F.avg(v).alias(v) for v in values]))
