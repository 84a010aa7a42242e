"""Tiles of scenes and their features, as relational operators over (tile_id, r, c).

A tile holds at most tile x tile pixels, so per-tile aggregates are bounded. All
features of a tile come from one pass over its arrays, after a single shuffle of pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import EPS
from ..functions.indices import rgb_proxies
from ..session import materialise
from .focal import gradient, local_std
from .halo import box_moments, slopes
from .stats import attach, usable

TILE = ["tile_id"]
CHANNELS = ("red", "green", "blue")
PROXIES = ("vari", "exg", "gli", "ngrdi", "rbdiff", "chroma_r", "chroma_g", "chroma_b", "brightness", "saturation")
MOMENTS = ("mean", "std", "skew", "kurt", "p5", "p25", "p50", "p75", "p95")
HIST_BINS = 12
#: Summed slope from which a pixel counts as an edge.
EDGE = 0.06
#: Cells of tiles that are measured at a time; a larger tile is measured alone.
BLOCK = 1 << 16


def tile_pixels(pixels: DataFrame, scenes: DataFrame, tile: int = 64, stride: int | None = None) -> DataFrame:
    """Each pixel once per tile that covers it; only tiles wholly inside the grid. The sizes of grids are written, so that their number decides how they meet the pixels."""
    stride = stride or tile
    grid = materialise(scenes.select("scene_id", "width", "height"), "tile-grids")
    others = [c for c in pixels.columns]
    placed = attach(pixels, grid, ["scene_id"], n=grid.count())
    if stride >= tile:
        # at most one tile a pixel
        spots = {k: f"int(floor({axis} / {stride})) * {stride}" for k, axis in (("tile_r", "r"), ("tile_c", "c"))}
        inside = " AND ".join(f"{k} >= 0 AND {axis} < {k} + {tile} AND {k} + {tile} <= {size}" for k, axis, size in (("tile_r", "r", "height"), ("tile_c", "c", "width")))
        return placed.selectExpr(*others, "width", "height", *[f"{e} AS {k}" for k, e in spots.items()]).where(inside).drop("width", "height")

    def origins(axis: str, size: str) -> str:
        first, last = f"int(ceil(({axis} - {tile - 1}) / {stride}))", f"int(floor({axis} / {stride}))"
        return (f"explode(filter(transform(sequence(greatest({first}, 0), greatest({last}, greatest({first}, 0))), k -> k * {stride}), "
                f"o -> o <= {axis} AND o + {tile} > {axis} AND o + {tile} <= {size}))")

    out = placed.selectExpr(*others, "width", "height", f"{origins('r', 'height')} AS tile_r")
    return out.selectExpr(*others, "tile_r", f"{origins('c', 'width')} AS tile_c")


def tile_scenes(tiled: DataFrame, tile: int = 64, min_valid: float = 0.6) -> DataFrame:
    """(scene_id, tile_r, tile_c, valid_share) of tiles with enough valid pixels."""
    valid = F.count_if("valid") if "valid" in tiled.columns else F.count("*")
    share = valid / float(tile * tile)
    return tiled.groupBy("scene_id", "tile_r", "tile_c").agg(share.alias("valid_share")).where(F.col("valid_share") >= min_valid)


def sample_evenly(tiles: DataFrame, limit: int = 900) -> DataFrame:
    """At most ``limit`` tiles per scene at evenly spaced positions in raster order.

    Position k is kept when some i in 0..limit-1 has floor(i (n-1) / (limit-1)) = k.
    Positions come from the counts of the tile rows above, so no window is longer
    than one side of the scene.
    """
    rows = tiles.groupBy("scene_id", "tile_r").agg(F.count("*").alias("_row")).selectExpr(
        "scene_id", "tile_r", "sum(_row) OVER (PARTITION BY scene_id ORDER BY tile_r ROWS UNBOUNDED PRECEDING) - _row AS _above",
        "sum(_row) OVER (PARTITION BY scene_id) AS _n")
    numbered = tiles.selectExpr("*", "row_number() OVER (PARTITION BY scene_id, tile_r ORDER BY tile_c) - 1 AS _i").join(
        rows, ["scene_id", "tile_r"]).withColumn("_k", F.col("_above") + F.col("_i"))
    step = f"bigint(ceil(_k * {limit - 1} / (_n - 1)))"
    return numbered.where(f"_n <= {limit} OR bigint(floor({step} * (_n - 1) / {limit - 1})) = _k").drop("_k", "_n", "_i", "_above")


def channel_rows(patches: DataFrame) -> DataFrame:
    """Long (tile_id, channel, v) over the three bands and ten derived channels."""
    chans = {c: F.col(c) for c in CHANNELS} | rgb_proxies()
    rows = F.array(*[F.struct(F.lit(k).alias("channel"), v.alias("v")) for k, v in chans.items()])
    return patches.select(*TILE, F.inline(rows)).where(usable(F.col("v")))


def patch_moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean, population std, skewness, plain kurtosis and five percentiles per group.

    The deviation is floored at 1e-6, so a constant channel has skew and kurt 0.
    """
    agg = rows.groupBy(*by).agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.skewness("v").alias("_s"), F.kurtosis("v").alias("_k"),
        F.expr("percentile(v, array(0.05D, 0.25D, 0.5D, 0.75D, 0.95D))").alias("_p"))
    ratio = F.col("std") / F.greatest("std", F.lit(1e-6))
    zero = F.lit(0.0)
    return agg.select(
        *by, "mean", "std", F.coalesce(F.nanvl("_s", zero) * F.pow(ratio, 3), zero).alias("skew"),
        F.coalesce((F.nanvl("_k", F.lit(-3.0)) + 3) * F.pow(ratio, 4), zero).alias("kurt"),
        *[F.get("_p", F.lit(i)).alias(f"p{q}") for i, q in enumerate((5, 25, 50, 75, 95))])


def texture_stats(gray: DataFrame, sides: tuple[int, ...] = (3, 7, 15)) -> DataFrame:
    """texstd<k>_mean, _std and _p90 of the local deviation in k x k boxes; needs width, height."""
    local = local_std(gray, "gray", {f"ls{k}": k for k in sides}, TILE)
    return local.groupBy(*TILE).agg(*[
        agg.alias(f"texstd{k}_{name}") for k in sides for name, agg in (
            ("mean", F.avg(f"ls{k}")), ("std", F.stddev_pop(f"ls{k}")), ("p90", F.expr(f"percentile(ls{k}, 0.9D)")))])


def gradient_stats(gray: DataFrame, edge: float = EDGE) -> DataFrame:
    """Gradient magnitude statistics and the share of edge pixels."""
    g = gradient(gray, "gray", TILE).withColumn("mag", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    steep = (F.abs("gy") + F.abs("gx") > edge).cast("double")
    return g.groupBy(*TILE).agg(F.avg("mag").alias("grad_mean"), F.stddev_pop("mag").alias("grad_std"),
                                F.expr("percentile(mag, 0.95D)").alias("grad_p95"), F.avg(steep).alias("edge_density"))


def layout_grid(patches: DataFrame, values: list[str]) -> DataFrame:
    """(tile_id, gi, gj, means): 3 x 3 cells bounded at g·h // 3."""
    def cell(axis: str, size: str) -> Column:
        return F.expr(f"CASE WHEN {axis} < {size} div 3 THEN 0 WHEN {axis} < 2 * {size} div 3 THEN 1 ELSE 2 END")

    return patches.groupBy(*TILE, cell("r", "height").alias("gi"), cell("c", "width").alias("gj")).agg(*[F.avg(v).alias(v) for v in values])


def profiles(gray: DataFrame) -> DataFrame:
    """Deviation of the row means, of the column means, and their distance."""
    def along(axis: str, name: str) -> DataFrame:
        return gray.groupBy(*TILE, axis).agg(F.avg("gray").alias("m")).groupBy(*TILE).agg(F.stddev_pop("m").alias(name))

    return along("r", "row_profile_std").join(along("c", "col_profile_std"), TILE).withColumn(
        "anisotropy", F.abs(F.col("row_profile_std") - F.col("col_profile_std")))


def channel_histogram(patches: DataFrame) -> DataFrame:
    """(tile_id, channel, bin, share) over [0, 1]; values outside fall in no bin."""
    rows = F.array(*[F.struct(F.lit(k).alias("channel"), F.col(k).alias("v")) for k in CHANNELS])
    long = patches.select(*TILE, F.inline(rows))
    share = (F.col("n") / F.sum("n").over(_per_channel())).alias("share")
    slot = F.when(F.col("v").between(0.0, 1.0), F.least(F.floor(F.col("v") * HIST_BINS), F.lit(HIST_BINS - 1))).cast("int")
    return long.groupBy(*TILE, "channel", slot.alias("bin")).agg(F.count("*").alias("n")).select(*TILE, "channel", "bin", share).where(
        "bin IS NOT NULL")


def _per_channel():
    from pyspark.sql import Window

    return Window.partitionBy(*TILE, "channel")


def feature_names() -> list[str]:
    names = [f"{c}_{m}" for c in CHANNELS + PROXIES for m in MOMENTS]
    names += [f"texstd{k}_{s}" for k in (3, 7, 15) for s in ("mean", "std", "p90")]
    names += ["grad_mean", "grad_std", "grad_p95", "edge_density"]
    names += [f"hist_{c}_{i}" for c in CHANNELS for i in range(HIST_BINS)]
    names += [f"grid{i}{j}_{c}" for i in range(3) for j in range(3) for c in CHANNELS]
    return names + ["row_profile_std", "col_profile_std", "anisotropy"]


def _quantiles(v: np.ndarray, shares: tuple[float, ...]) -> np.ndarray:
    """Linearly interpolated quantiles along the last axis; a row per share comes last."""
    v = np.sort(v, axis=-1)
    at = np.array(shares) * (v.shape[-1] - 1)
    low = np.floor(at).astype(np.int64)
    high = np.minimum(low + 1, v.shape[-1] - 1)
    return v[..., low] + (v[..., high] - v[..., low]) * (at - low)


def _moment_values(v: np.ndarray) -> np.ndarray:
    """MOMENTS of each row of values."""
    if not v.shape[-1]:
        return np.zeros((len(v), len(MOMENTS)))
    # added one after the other in raster order, as an average in SQL is: pairwise sums fall on the other side of a rounding tie
    mean, std = v.cumsum(axis=1)[:, -1:] / v.shape[-1], v.std(axis=1, keepdims=True)
    z = (v - mean) / np.maximum(std, 1e-6)
    square = z * z
    return np.hstack((mean, std, (square * z).mean(axis=1, keepdims=True), (square * square).mean(axis=1, keepdims=True), _quantiles(v, (0.05, 0.25, 0.5, 0.75, 0.95))))


def _channels(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> list[np.ndarray]:
    """The bands and the derived channels of ``rgb_proxies``, on arrays."""
    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, EPS)

    total, high, low = red + green + blue, np.maximum(np.maximum(red, green), blue), np.minimum(np.minimum(red, green), blue)
    excess = 2 * green - red - blue
    return [red, green, blue, over(green - red, green + red), excess, over(excess, 2 * green + red + blue), over(green - red, green + red), over(red - blue, red + blue),
            over(red, total), over(green, total), over(blue, total), total / 3.0, over(high - low, high)]


def _by_count(values: np.ndarray, mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of (rows x places) by how many places of them are marked: their numbers, and the marked values in order."""
    if mask.all():
        yield np.arange(len(values)), values
        return
    count = mask.sum(axis=1)
    for n in np.unique(count):
        at = np.flatnonzero(count == n)
        yield at, values[at][mask[at]].reshape(len(at), n)


def _stats(values: np.ndarray, mask: np.ndarray, measure: Callable[[np.ndarray], tuple[np.ndarray, ...]], width: int) -> np.ndarray:
    """``width`` measures of the marked values of each row, 0 where none is marked."""
    out = np.zeros((len(values), width))
    for at, v in _by_count(values, mask):
        if v.shape[1]:
            out[at] = np.column_stack(measure(v))
    return out


def tile_values(bands: np.ndarray, present: np.ndarray) -> np.ndarray:
    """The 196 values of tiles of one size, in the order of ``feature_names``; bands is tiles x 3 x rows x columns, NaN where there is no value.

    A value does not depend on the tiles beside it: reductions run along the values of one tile.
    """
    tiles, _, height, width = bands.shape
    with np.errstate(invalid="ignore"):
        gray = (bands[:, 0] + bands[:, 1] + bands[:, 2]) / 3.0
        channels = np.stack(_channels(bands[:, 0], bands[:, 1], bands[:, 2]), axis=1).reshape(tiles * len(CHANNELS + PROXIES), -1)
        out = [_stats(channels, np.isfinite(channels), lambda v: (_moment_values(v),), len(MOMENTS)).reshape(tiles, -1)]
        known = np.isfinite(gray)
        filled = np.where(known, gray, 0.0)
        there, clear = present.reshape(tiles, -1), known.reshape(tiles, -1)
        for k in (3, 7, 15):
            local = np.sqrt(box_moments(filled, k, "reflect")[1]).reshape(tiles, -1)
            out.append(_stats(local, there, lambda v: (v.mean(axis=1), v.std(axis=1), _quantiles(v, (0.9,))), 3))
        gy, gx = (slopes(filled, known, axis).reshape(tiles, -1) for axis in (-2, -1))
        out.append(_stats(np.hypot(gx, gy), clear, lambda v: (v.mean(axis=1), v.std(axis=1), _quantiles(v, (0.95,))), 3))
        out.append(_stats((np.abs(gy) + np.abs(gx) > EDGE).astype(float), clear, lambda v: (v.mean(axis=1),), 1))
        n = there.sum(axis=1)
        flat = bands.reshape(tiles * len(CHANNELS), -1)
        row, place = np.nonzero(np.isfinite(flat) & (flat >= 0.0) & (flat <= 1.0))
        slot = np.minimum(np.floor(flat[row, place] * HIST_BINS), HIST_BINS - 1).astype(np.int64)
        out.append(np.bincount(row * HIST_BINS + slot, minlength=len(flat) * HIST_BINS).reshape(tiles, -1) / n[:, None])
        rows, columns = ([g * size // 3 for g in range(4)] for size in (height, width))
        for i in range(3):
            for j in range(3):
                cell = bands[:, :, rows[i]:rows[i + 1], columns[j]:columns[j + 1]].reshape(tiles * len(CHANNELS), -1)
                out.append(_stats(cell, ~np.isnan(cell), lambda v: (v.mean(axis=1),), 1).reshape(tiles, -1))
        across = []
        for axis in (2, 1):
            count = known.sum(axis=axis)
            across.append(_stats((filled * known).sum(axis=axis) / np.maximum(count, 1), count > 0, lambda v: (v.std(axis=1),), 1))
        out += [*across, np.abs(across[0] - across[1])]
    values = np.hstack(out)
    return np.where(np.isfinite(values), values, 0.0)


def _tile_rows(ids: pa.Array, table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Features of tiles whose pixels are the rows from ``starts`` to ``ends``, at most BLOCK cells at a time."""
    r, c, height, width = (table.column(k).to_numpy() for k in ("r", "c", "height", "width"))
    colours = [pc.fill_null(table.column(k).cast(pa.float64()), float("nan")).to_numpy() for k in CHANNELS]
    sizes = np.stack((height[starts], width[starts]), axis=1)
    for h, w in np.unique(sizes, axis=0):
        alike = np.flatnonzero((sizes == (h, w)).all(axis=1))
        step = max(1, BLOCK // max(1, int(h * w)))
        for some in (alike[k:k + step] for k in range(0, len(alike), step)):
            lengths = ends[some] - starts[some]
            tile = np.repeat(np.arange(len(some)), lengths)
            rows = np.arange(lengths.sum()) + np.repeat(starts[some] - (lengths.cumsum() - lengths), lengths)
            bands, present = np.full((len(some), 3, h, w), np.nan), np.zeros((len(some), h, w), bool)
            present[tile, r[rows], c[rows]] = True
            for k, colour in enumerate(colours):
                bands[tile, k, r[rows], c[rows]] = colour[rows]
            values = tile_values(bands, present)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), lists], names=["tile_id", "features"])


def patch_features(patches: DataFrame) -> DataFrame:
    """(tile_id, features): the 196 values of each patch, missing ones 0, from one shuffle and one pass over its arrays.

    ``patches`` has tile_id, r, c, height, width and red, green, blue in 0..1. A patch is bounded by its tile; pixels without a row or value
    take no part, and box deviations read them as 0. Rows come in the order of their tiles, and the tiles of a block are measured together.
    """
    kind = patches.schema["tile_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, enough = 0, BLOCK

        def measured(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, enough
            table = pa.Table.from_batches(held).combine_chunks()
            runs = pc.run_end_encode(table.column("tile_id").combine_chunks())
            ends = runs.run_ends.to_numpy().astype(np.int64)
            starts = np.concatenate(([0], ends[:-1]))
            # the pixels of the last tile may go on in the next batch
            whole = len(ends) if last else len(ends) - 1
            cut = int(ends[-1] if last else starts[-1])
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
            enough = max(BLOCK, 2 * rows)
            yield from _tile_rows(runs.values, table, starts[:whole], ends[:whole])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= enough:
                yield from measured(False)
        if rows:
            yield from measured(True)

    wide = patches.select(*TILE, "r", "c", "height", "width", *CHANNELS)
    return wide.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(run, f"tile_id {kind}, features array<double>")


def paint_tiles(tile_labels: DataFrame, pixels: DataFrame, tile: int = 64, stride: int | None = None, rule: str = "votes") -> DataFrame:
    """Tile classes back on the pixel grid; ``class`` is NULL where no labelled tile lies.

    Where tiles overlap, ``votes`` takes the class with the largest sum of confidence (1 per tile without that column; of
    equal sums the first class by name), and ``last`` the class of the last tile in raster order. All pixels of a cell
    of the grid that tile edges draw lie under the same tiles, so classes are decided per cell and pixels only look theirs up.
    """
    if rule not in ("votes", "last"):
        raise ValueError("rule is votes or last")
    cell = math.gcd(tile, stride or tile)
    steps = F.sequence(F.lit(0), F.lit(tile - cell), F.lit(cell))
    weight = F.col("confidence") if "confidence" in tile_labels.columns else F.lit(1.0)
    over = tile_labels.select("scene_id", "tile_r", "tile_c", "class", weight.alias("_w"), F.explode(steps).alias("_dr")).select(
        "scene_id", "tile_r", "tile_c", "class", "_w", (F.col("tile_r") + F.col("_dr")).alias("_r"), F.explode(steps).alias("_dc")).withColumn("_c", F.col("tile_c") + F.col("_dc"))
    by = ["scene_id", "_r", "_c"]
    if rule == "last":
        cells = over.groupBy(*by).agg(F.max_by("class", F.struct("tile_r", "tile_c")).alias("class"))
    else:
        sums = over.groupBy(*by, "class").agg(F.round(F.sum("_w"), 9).alias("_sum"))
        cells = sums.groupBy(*by).agg(F.min(F.struct((-F.col("_sum")).alias("m"), "class"))["class"].alias("class"))
    spot = {f"_{a}": F.expr(f"int(floor({a} / {cell})) * {cell}") for a in ("r", "c")}
    return pixels.withColumns(spot).join(cells, by, "left").drop("_r", "_c")
