"""Distribution statistics by key.

Keys are scenes (or scene and metric). One scene may hold a large part of all
pixels, so nothing here gathers the values of a key in one task: moments and
histograms combine map-side, and exact quantiles are found by locating the
value bucket of each rank before any value is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def usable(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def melt(df: DataFrame, keys: list[str], metrics: dict[str, Column], name="metric", value="v") -> DataFrame:
    """Long form (keys, metric, value); NULL and non-finite values dropped."""
    pairs = F.array(*[F.struct(F.lit(k).alias(name), c.cast("double").alias(value)) for k, c in metrics.items()])
    long = df.select(*keys, F.inline(pairs))
    return long.where(usable(F.col(value)))


#: Least number of tasks that the rows of one key are spread over; a wider shuffle spreads them further.
SALTS = 16
#: Most rows of a counted table that are sent to every task.
SENT = 1 << 15


def attach(rows: DataFrame, per_key: DataFrame, by: list[str], how: str = "inner", n: int | None = None) -> DataFrame:
    """Give every row the columns of its key.

    Catalyst broadcasts ``per_key`` when its measured size allows. Beyond that the
    join must shuffle the rows, so each key is spread over many tasks by the
    input partition of the row (stable when a task is retried), and the aggregates
    that follow combine before their own shuffle instead of inheriting a hot key.
    ``n`` is the number of rows of a ``per_key`` that was written: packed files tell little of the
    memory their rows take, so its rows and not its files decide.
    """
    if n is not None and n <= SENT:
        return rows.join(F.broadcast(per_key), by, how)
    salts = max(SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    spread = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.expr(f"pmod(spark_partition_id(), {salts})"))
    return salted.join(spread if n is None else spread.hint("merge"), [*by, "_salt"], how).drop("_salt")


#: Rows of one value range that a single task ranks; a range with more is divided further.
RANKED = 65_536
#: Parts into which such a range is divided.
PARTS = 1024


def _holding(counts: DataFrame, by: list[str], order: str, targets: str, unpack: str) -> DataFrame:
    """The counted ranges (by…, _lo, _hi, _n) that hold a wanted rank, with the ranks; ``order`` sorts the ranges of a key."""
    key = ", ".join(by)
    running = counts.selectExpr("*", f"sum(_n) OVER (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING) - _n AS _below", f"sum(_n) OVER (PARTITION BY {key}) AS _total")
    return running.selectExpr("*", f"{targets} AS _from").selectExpr("*", unpack).where("_rank >= _from AND _rank < _from + _n")


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float],
                    resolution: float = 1024.0) -> DataFrame:
    """Linear-interpolation quantiles per key, exact at any group size.

    Values are counted in buckets whose width grows with the value, ``resolution`` for
    each factor e: an outlier neither swallows the others in one bucket nor makes the
    ladder of buckets long. The running count says which bucket holds each wanted rank.
    A bucket with many different values is divided again, and so are its parts, until
    every range that holds a rank is small; only the rows of those are grouped by value and ranked.
    """
    rows = df.where(usable(F.col(value))).selectExpr(*by, f"double({value}) AS _v", f"bigint(sign({value}) * floor(ln(1D + abs(double({value})) * 1048576D) * {resolution}D)) AS _b")
    ladder = rows.groupBy(*by, "_b").agg(F.expr("count(1) AS _n"), F.expr("min(_v) AS _lo"), F.expr("max(_v) AS _hi"))
    # two ranks around each position (total - 1) * p, with the weight of the upper one
    sides = ", ".join(
        f"struct('{q}' AS _q, {side} AS _up, {snap}((_total - 1) * {p}D) AS _rank, "
        f"(_total - 1) * {p}D - floor((_total - 1) * {p}D) AS _t)"
        for q, p in probs.items() for side, snap in (("false", "floor"), ("true", "ceil")))
    wanted = F.expr("collect_list(struct(_q, _up, _rank, _t)) AS _targets")
    span = [*by, "_b", "_lo", "_hi", "_before", "_n"]
    targets = _holding(ladder, by, "_b", "_below", f"inline(array({sides}))").withColumn("_before", F.col("_from")).groupBy(*span).agg(wanted)
    targets = materialise(targets, "quantile_buckets")  # its rows decide how it meets the others
    while n_wide := (wide_ := targets.where(f"_n > {RANKED} AND _lo < _hi")).count():
        part = f"least(bigint(floor((_v - _lo) / (_hi - _lo) * {PARTS})), {PARTS - 1}L) AS _part"
        counts = attach(rows, wide_, [*by, "_b"], n=n_wide).where("_v BETWEEN _lo AND _hi").selectExpr(*by, "_b", "_lo AS _outer", "_before", "_targets", "_v", part).groupBy(
            *by, "_b", "_outer", "_before", "_targets", "_part").agg(F.expr("count(1) AS _n"), F.expr("min(_v) AS _lo"), F.expr("max(_v) AS _hi"))
        finer = _holding(counts, [*by, "_b", "_outer"], "_part", "_before + _below", "inline(_targets)").drop("_before").withColumnRenamed("_from", "_before").groupBy(*span).agg(wanted)
        targets = materialise(targets.where(f"NOT (_n > {RANKED} AND _lo < _hi)").unionByName(finer), "quantile_buckets")
    found = (
        attach(rows, targets.drop("_n"), [*by, "_b"], n=targets.count()).where("_v BETWEEN _lo AND _hi")
        .groupBy(*by, "_b", "_lo", "_v", "_before", "_targets").agg(F.expr("count(1) AS _n"))
        .selectExpr(*by, "_v", "_n", "_targets", "_before + sum(_n) OVER (PARTITION BY "
                    f"{', '.join(by)}, _b, _lo ORDER BY _v ROWS UNBOUNDED PRECEDING) AS _end")
        .selectExpr(*by, "_v", "_end - _n AS _start", "_end", "inline(_targets)")
        .where("_rank >= _start AND _rank < _end"))
    # a + (b - a) t gives back the value itself where both neighbours are equal
    low, high = "max(_v) FILTER (WHERE _q = '{q}' AND NOT _up)", "max(_v) FILTER (WHERE _q = '{q}' AND _up)"
    lerp = f"{low} + ({high} - {low}) * max(_t) FILTER (WHERE _q = '{{q}}') AS {{q}}"
    return found.groupBy(*by).agg(*[F.expr(lerp.format(q=q)) for q in probs])


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.where(usable(v)).groupBy(*by).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.count("*").alias("n"))


def index_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, median, population std, min, max, p10, p90 and count per key."""
    q = exact_quantiles(df, by, value, {"median": 0.5, "p10": 0.1, "p90": 0.9})
    return moments(df, by, value).join(q, by)


def histogram(df: DataFrame, by: list[str], value: str, bins: int = 40, lo: float = -1.0,
              hi: float = 1.0) -> DataFrame:
    """Fixed-range counts with empty bins shown; the last bin includes ``hi``."""
    v = F.col(value)
    inside = df.where(usable(v) & v.between(lo, hi))
    slot = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*by, slot.alias("bin")).agg(F.count("*").alias("n"))
    spine = df.where(usable(v)).select(*by).distinct().withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(counts, [*by, "bin"], "left").na.fill(0, ["n"])


def wide(long: DataFrame, by: list[str], metric: str, names: list[str], columns: list[str]) -> DataFrame:
    """One row per key from one row per (key, metric), without a pivot scan."""
    picks = [F.max(F.when(F.col(metric) == m, F.col(c))).alias(f"{m}_{c}") for m in names for c in columns]
    return long.groupBy(*by).agg(*picks)


def joined(frames: list[DataFrame], by: list[str], how: str = "left") -> DataFrame:
    return reduce(lambda a, b: a.join(b, by, how), frames)
