"""Connected components of masks and the regions they form.

A mask is cut into square blocks. A task labels the components of one block; after that only the cells on the borders of
blocks matter. Neighbouring blocks are merged into larger ones, level by level, and of a merged block again only the outer
border goes on, so a group holds a few border lines and no component, however long, is ever one key. What each merge
joined comes back to the runs as a table of labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_even
from ..session import materialise
from .stats import attach

#: Side of a block, and blocks merged along each side.
BLOCK, FAN = 256, 4
#: A cell as one number in raster order.
ROW = 1 << 32


def _least_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> dict[int, int]:
    """Label -> smallest label it is joined with, for those that change; u and v are joined labels."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for a, b in zip(label[u].tolist(), label[v].tolist(), strict=True):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: r for x in list(parent) if (r := find(x)) != x}


def _relabelled(label: np.ndarray, least: dict[int, int]) -> np.ndarray:
    if not least:
        return label
    old = np.array(sorted(least), np.int64)
    new = np.array([least[x] for x in old.tolist()], np.int64)
    at = np.minimum(np.searchsorted(old, label), len(old) - 1)
    return np.where(old[at] == label, new[at], label)


def label_cells(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of 8-connected cells with the first cell of their component, then the cells in raster order with the run of each.

    Repeated cells count once.
    """
    cell = np.unique(r.astype(np.int64) * ROW + c)
    first = np.flatnonzero(np.diff(cell, prepend=-2) != 1)
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(cell))))
    start, end = cell[first], cell[np.append(first[1:], len(cell)) - 1]
    # runs of the next row that touch this one, diagonals included
    lo, hi = np.searchsorted(end, start + ROW - 1), np.searchsorted(start, end + ROW + 1, side="right")
    n = np.maximum(hi - lo, 0)
    u = np.repeat(np.arange(len(start)), n)
    v = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    label = _relabelled(start, _least_labels(start, u, v))
    return start // ROW, start % ROW, end % ROW, label, cell // ROW, cell % ROW, run


def _on_border(r: np.ndarray, c: np.ndarray, size: int) -> np.ndarray:
    return (r % size == 0) | (r % size == size - 1) | (c % size == 0) | (c % size == size - 1)


def _rows(table: pa.Table, by: list[str], n: int, columns: dict[str, np.ndarray]) -> pa.Table:
    out = table.select(by).slice(0, 1).take(pa.array(np.zeros(n, np.int64)))
    for name, values in columns.items():
        out = out.append_column(name, pa.array(values, pa.bool_() if values.dtype == bool else pa.int64()))
    return out


def _block_runs(by: list[str], size: int):
    """Of one block: its runs with their component, and the cells on its border."""
    def run(table: pa.Table) -> pa.Table:
        r, c0, c1, label, cell_r, cell_c, of = label_cells(table.column("r").to_numpy(), table.column("c").to_numpy())
        edge = _on_border(cell_r, cell_c, size)
        columns = {"r": (r, cell_r[edge]), "c0": (c0, cell_c[edge]), "c1": (c1, cell_c[edge]), "component": (label, label[of][edge]),
                   "edge": (np.zeros(len(r), bool), np.ones(int(edge.sum()), bool))}
        return _rows(table, by, len(r) + int(edge.sum()), {k: np.concatenate(v) for k, v in columns.items()})

    return run


def _merged(by: list[str], size: int):
    """Of a square of blocks: labels that became another one, and the cells on its border with their new labels."""
    def run(table: pa.Table) -> pa.Table:
        r, c, label = (table.column(k).to_numpy().astype(np.int64) for k in ("r", "c0", "component"))
        cell = r * ROW + c
        order = np.argsort(cell)
        cell, r, c, label = cell[order], r[order], c[order], label[order]
        ends = []
        for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
            at = np.minimum(np.searchsorted(cell, cell + dr * ROW + dc), len(cell) - 1)
            apart = ((r + dr) // size != r // size) | ((c + dc) // size != c // size)
            u = np.flatnonzero((cell[at] == cell + dr * ROW + dc) & apart & (c + dc >= 0))
            ends.append((u, at[u]))
        u, v = (np.concatenate(x) for x in zip(*ends, strict=True))
        least = _least_labels(label, u, v)
        label = _relabelled(label, least)
        edge = _on_border(r, c, size * FAN)
        old = np.array(list(least), np.int64)
        new = np.array(list(least.values()), np.int64)
        none = np.zeros(len(old), np.int64)
        columns = {"r": (none, r[edge]), "c0": (none, c[edge]), "component": (old, label[edge]), "least": (new, label[edge]),
                   "edge": (np.zeros(len(old), bool), np.ones(int(edge.sum()), bool))}
        return _rows(table, by, len(old) + int(edge.sum()), {k: np.concatenate(x) for k, x in columns.items()})

    return run


def connected_runs(mask: DataFrame, by: list[str]) -> DataFrame:
    """(by…, r, c0, c1, component): runs of cells, cut where blocks meet, with their component's first cell in raster order."""
    kinds = {f.name: f.dataType.simpleString() for f in mask.schema.fields}
    keys = ", ".join(f"`{k}` {kinds[k]}" for k in by)
    size = BLOCK
    blocks = mask.selectExpr(*by, "r", "c", f"int(floor(r / {size})) AS _br", f"int(floor(c / {size})) AS _bc").groupBy(*by, "_br", "_bc")
    found = materialise(blocks.applyInArrow(_block_runs(by, size), f"{keys}, r bigint, c0 bigint, c1 bigint, component bigint, edge boolean"), "block-runs")
    runs = found.where("NOT edge").select(*by, F.col("r").cast("int").alias("r"), F.col("c0").cast("int").alias("c0"), F.col("c1").cast("int").alias("c1"), "component")
    border = found.where("edge")
    side = border.agg(F.greatest(F.max("r"), F.max("c0")).alias("m")).first()["m"]
    labels = None
    while side is not None and size <= side:
        square = [F.floor(F.col(a) / (size * FAN)).alias(b) for a, b in (("r", "_br"), ("c0", "_bc"))]
        squares = border.select(*by, "r", "c0", "component", *square).groupBy(*by, "_br", "_bc")
        step = materialise(squares.applyInArrow(_merged(by, size), f"{keys}, r bigint, c0 bigint, component bigint, least bigint, edge boolean"), "block-merge")
        joined = step.where("NOT edge").select(*by, "component", "least")
        if labels is not None:
            further = joined.select(*by, F.col("component").alias("least"), F.col("least").alias("_next"))
            joined = attach(labels, further, [*by, "least"], "left").select(*by, "component", F.coalesce("_next", "least").alias("least")).unionByName(joined)
        labels, border, size = joined, step.where("edge"), size * FAN
    if labels is None:
        return runs
    return attach(runs, materialise(labels, "block-labels"), [*by, "component"], "left").withColumn("component", F.coalesce("least", "component")).drop("least")


def run_cells(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs back to cells."""
    return runs.select(*by, "component", "r", F.explode(F.sequence("c0", "c1")).alias("c"))


def connected_components(mask: DataFrame, by: list[str]) -> DataFrame:
    """(by…, component, r, c) for the 8-connected components of the mask cells."""
    return run_cells(connected_runs(mask, by), by)


def area_open(mask: DataFrame, by: list[str], min_size: int = 12) -> DataFrame:
    """Runs of the components with at least ``min_size`` cells."""
    runs = connected_runs(mask, by)
    sizes = runs.groupBy(*by, "component").agg(F.sum(F.expr("c1 - c0 + 1")).alias("_size"))
    return attach(runs, sizes.where(F.col("_size") >= min_size).select(*by, "component"), [*by, "component"])


def region_stats(runs: DataFrame, by: list[str]) -> DataFrame:
    """Size, box, centroid and fill of every component, from its runs alone."""
    n = F.expr("c1 - c0 + 1")
    agg = runs.groupBy(*by, "component").agg(
        F.sum(n).alias("pixels"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c0").alias("c0"),
        F.max("c1").alias("c1"), (F.sum(n * F.col("r")) / F.sum(n)).alias("cy"),
        (F.sum(n * (F.col("c0") + F.col("c1"))) / F.sum(n) / 2).alias("cx"))
    return agg.withColumn("fill_ratio", half_even(F.col("pixels") / F.expr("(r1 - r0 + 1) * (c1 - c0 + 1)"), 4))


def rank_regions(regions: DataFrame, by: list[str], min_pixels: int = 30, max_regions: int = 8) -> DataFrame:
    """Largest regions first; equal sizes in raster order."""
    over = f"OVER (PARTITION BY {', '.join(by)} ORDER BY pixels DESC, component)"
    return regions.where(F.col("pixels") >= min_pixels).selectExpr("*", f"row_number() {over} AS rank").where(
        F.col("rank") <= max_regions)


def locate_regions(regions: DataFrame, scenes: DataFrame, by: list[str]) -> DataFrame:
    """Share of the grid, area, geographic box and centroid; geography stays NULL without a position."""
    def lon(col: str) -> Column:
        return F.expr(f"rint((west + ({col} + 0.5D) / width * (east - west)) * 1e5) / 1e5")

    def lat(row: str) -> Column:
        return F.expr(f"rint((north - ({row} + 0.5D) / height * (north - south)) * 1e5) / 1e5")

    from ..functions.geo import area_of, area_unit

    return regions.join(scenes.select(*by, "width", "height", "west", "south", "east", "north"), by).select(
        *by, "rank", "component", "pixels", "r0", "r1", "c0", "c1", half_even("cx", 1).alias("cx"), half_even("cy", 1).alias("cy"),
        "fill_ratio", half_even(F.expr("pixels / (width * height)"), 6).alias("fraction_of_scene"),
        area_of(F.col("pixels")).alias("area_km2"), area_unit().alias("unit"),
        lon("c0").alias("box_west"), lat("r1").alias("box_south"), lon("c1").alias("box_east"), lat("r0").alias("box_north"),
        lon("cx").alias("lon"), lat("cy").alias("lat"))


def region_direction(regions: DataFrame, cells: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean signed change of the masked cells inside each ranked region's box.

    At most max_regions boxes per image meet its cells, on the image key with the
    box as a filter; ``component_delta`` is the mean over the component itself when
    the cells carry one.
    """
    boxes = regions.select(*by, "rank", F.col("component").alias("_region"), "r0", "r1", "c0", "c1")
    hits = attach(cells, boxes, by).where("r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1")
    aggs = [F.avg(value).alias("mean_delta")]
    if "component" in cells.columns:
        aggs.append(F.avg(F.when(F.col("component") == F.col("_region"), F.col(value))).alias("component_delta"))
    means = hits.groupBy(*by, "rank").agg(*aggs)
    return regions.join(means, [*by, "rank"], "left").withColumn(
        "direction", F.when(F.col("mean_delta") >= 0, "increase").when(F.col("mean_delta") < 0, "decrease"))
