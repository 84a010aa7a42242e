"""Images cut into square tiles that overlap by a halo, for chains of neighbourhood steps.

Every pixel goes to its own tile and to those in whose halo it lies. A task then holds one tile as arrays and takes
all steps of a chain at once, so a chain costs a single shuffle of pixels, whatever its length. A wrong value near the
cut edge of a tile can only come from the part of the halo that the steps so far have used up; the core of a tile is
right as long as the halo is the sum of the reaches of the steps. A tile is bounded, however large its image.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256

#: A kernel takes the inputs as arrays, the mask of the cells that exist, and the values of the image.
Kernel = Callable[[dict[str, np.ndarray], np.ndarray, dict], dict[str, np.ndarray]]


def _tiles_of(axis: str, halo: int, tile: int, size: str | None) -> str:
    last = f"int(floor(({axis} + {halo}) / {tile}))"
    last = last if size is None else f"least({last}, int(floor(({size} - 1) / {tile})))"
    # a size that does not hold the pixel must not lose it
    return f"explode(sequence(greatest(int(floor(({axis} - {halo}) / {tile})), 0), greatest({last}, int(floor({axis} / {tile})))))"


def _dealt(df: DataFrame, key: list[str], inputs: list[str], halo: int, tile: int) -> DataFrame:
    """One row per tile a pixel is needed in; only the copy in its own tile carries the other columns."""
    needed = {*key, "r", "c", *inputs, "width", "height"}
    known = "width" in df.columns
    core = F.expr(f"_tr = floor(r / {tile}) AND _tc = floor(c / {tile})")
    dealt = df.selectExpr("*", f"{_tiles_of('r', halo, tile, 'height' if known else None)} AS _tr").selectExpr(
        "*", f"{_tiles_of('c', halo, tile, 'width' if known else None)} AS _tc").withColumn("_core", core)
    return dealt.select(*key, "_tr", "_tc", "_core", *[c if c in needed else F.when(F.col("_core"), F.col(c)).alias(c) for c in df.columns if c not in key])


def image_tiles(images: DataFrame, key: list[str], tile: int = TILE) -> DataFrame:
    """One row per tile of every image, with keys of their own names, as they may come from the pixels they meet; needs width and height."""
    named = images.withColumnsRenamed({k: f"_image_{k}" for k in key})
    rows = named.select(*[F.col(c).alias(c) for c in named.columns]).selectExpr("*", f"explode(sequence(0, int(floor((height - 1) / {tile})))) AS _tr")
    return rows.selectExpr("*", f"explode(sequence(0, int(floor((width - 1) / {tile})))) AS _tc")


class _Frame:
    """Where a tile with its halo lies in its image."""

    def __init__(self, r: np.ndarray, c: np.ndarray, tr: int, tc: int, halo: int, tile: int, size: tuple[int, int] | None):
        if size is None:
            self.r0, self.c0, r1, c1 = int(r.min()), int(c.min()), int(r.max()) + 1, int(c.max()) + 1
        else:
            self.r0, self.c0 = max(tr * tile - halo, 0), max(tc * tile - halo, 0)
            r1, c1 = min((tr + 1) * tile + halo, size[0]), min((tc + 1) * tile + halo, size[1])
        self.shape = (max(r1 - self.r0, 1), max(c1 - self.c0, 1))
        self.inside = (r >= self.r0) & (r < r1) & (c >= self.c0) & (c < c1)
        self.at = (r[self.inside] - self.r0, c[self.inside] - self.c0)

    def array(self, column: pa.ChunkedArray) -> np.ndarray:
        """Values on the grid; absent cells and nulls are 0."""
        values = pc.fill_null(column.cast(pa.float64()), 0.0).to_numpy()
        out = np.zeros(self.shape)
        out[self.at] = values[self.inside]
        return out

    def present(self) -> np.ndarray:
        out = np.zeros(self.shape, bool)
        out[self.at] = True
        return out


def _size(table: pa.Table) -> tuple[int, int] | None:
    if "width" not in table.column_names or not table.num_rows:
        return None
    return table.column("height")[0].as_py(), table.column("width")[0].as_py()


def over_tiles(df: DataFrame, key: list[str], inputs: list[str], outputs: list[str], halo: int, kernel: Kernel, images: DataFrame | None = None,
               tile: int | None = None) -> DataFrame:
    """The rows of ``df`` (key…, r, c, inputs, …) with the outputs of ``kernel`` as further doubles; the only shuffle of pixels is the one to tiles.

    With width and height among the columns, cells without a row count as 0 inside the image. ``images`` brings
    values of whole images to their tiles, a row per tile; it needs width and height.
    """
    columns, tile = df.columns, tile or TILE

    def run(table: pa.Table, values: dict) -> pa.Table:
        core = table.column("_core").to_numpy()
        rows = table.filter(table.column("_core")).select(columns)
        if not rows.num_rows:
            found = {name: np.zeros(0) for name in outputs}
        else:
            r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
            frame = _Frame(r, c, table.column("_tr")[0].as_py(), table.column("_tc")[0].as_py(), halo, tile, _size(table))
            out = kernel({name: frame.array(table.column(name)) for name in inputs}, frame.present(), values)
            spot = (np.clip(r[core] - frame.r0, 0, frame.shape[0] - 1), np.clip(c[core] - frame.c0, 0, frame.shape[1] - 1))
            found = {name: out[name][spot] for name in outputs}
        for name in outputs:
            rows = rows.append_column(name, pa.array(found[name], pa.float64()))
        return rows

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{name}` double" for name in outputs])
    by = [*key, "_tr", "_tc"]
    dealt = _dealt(df, key, inputs, halo, tile).groupBy(*by)
    if images is None:
        return dealt.applyInArrow(lambda table: run(table, {}), fields)
    named = [c for c in images.columns if c not in key]
    meta = image_tiles(images, key, tile).groupBy(*[f"_image_{k}" for k in key], "_tr", "_tc")
    return dealt.cogroup(meta).applyInArrow(lambda table, image: run(table, {c: image.column(c)[0].as_py() for c in named} if image.num_rows else {}), fields)


def mask_over_tiles(cells: DataFrame, images: DataFrame, key: list[str], halo: int, kernel: Callable[[np.ndarray], np.ndarray], tile: int | None = None) -> DataFrame:
    """(key…, r, c) of the cells that ``kernel`` leaves on in masks given by the cells that are on; only those are shuffled."""
    tile = tile or TILE
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    fields = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", r int, c int"
    by = [*key, "_tr", "_tc"]

    def run(table: pa.Table, image: pa.Table) -> pa.Table:
        if not table.num_rows or not image.num_rows:
            return table.select(key).slice(0, 0).append_column("r", pa.array([], pa.int32())).append_column("c", pa.array([], pa.int32()))
        tr, tc = table.column("_tr")[0].as_py(), table.column("_tc")[0].as_py()
        frame = _Frame(table.column("r").to_numpy(), table.column("c").to_numpy(), tr, tc, halo, tile, _size(image))
        r, c = np.nonzero(kernel(frame.present()))
        r, c = r + frame.r0, c + frame.c0
        own = (r // tile == tr) & (c // tile == tc)
        first = table.select(key).slice(0, 1)
        rows = first.take(pa.array(np.zeros(int(own.sum()), np.int64)))
        return rows.append_column("r", pa.array(r[own], pa.int32())).append_column("c", pa.array(c[own], pa.int32()))

    dealt = _dealt(cells.select(*key, "r", "c"), key, [], halo, tile).groupBy(*by)
    meta = image_tiles(images.select(*key, "width", "height"), key, tile).groupBy(*[f"_image_{k}" for k in key], "_tr", "_tc")
    return dealt.cogroup(meta).applyInArrow(run, fields)


# ------------------------------------------------------------------ steps on arrays
def box_sum(a: np.ndarray, half: int, edge: str) -> np.ndarray:
    """Sums over square boxes of the last two axes, borders mirrored by NumPy's ``edge`` mode.

    Terms are added in the same order everywhere, so a value does not depend on the tile it is computed in, and a flat
    area has no rounding noise, as differences of running sums would.
    """
    if half == 0:
        return a.copy()
    h, w = a.shape[-2:]
    p = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(half, half)] * 2, mode=edge)
    rows = p[..., :h, :].copy()
    for k in range(1, 2 * half + 1):
        rows += p[..., k : k + h, :]
    out = rows[..., :w].copy()
    for k in range(1, 2 * half + 1):
        out += rows[..., k : k + w]
    return out


def box_count(mask: np.ndarray, half: int) -> np.ndarray:
    """Marked cells of square boxes from one summed-area table; cells outside count as unmarked."""
    p = np.pad(mask, ((half + 1, half), (half + 1, half)))
    table = p.astype(np.int64).cumsum(0).cumsum(1)
    k = 2 * half + 1
    return table[k:, k:] - table[:-k, k:] - table[k:, :-k] + table[:-k, :-k]


def box_moments(a: np.ndarray, k: int, edge: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance, never negative, of the k x k box around each cell."""
    n = float(k * k)
    mean = box_sum(a, k // 2, edge) / n
    return mean, np.maximum(box_sum(a * a, k // 2, edge) / n - mean * mean, 0.0)


def lee(a: np.ndarray, whole: float, k: int) -> np.ndarray:
    mean, var = box_moments(a, k, "symmetric")
    return mean + var / np.maximum(var + whole, 1e-6) * (a - mean)


def variation(a: np.ndarray, k: int) -> np.ndarray:
    mean, var = box_moments(a, k, "symmetric")
    return np.sqrt(var) / np.maximum(mean, 1e-6)


def slopes(a: np.ndarray, present: np.ndarray, axis: int) -> np.ndarray:
    """Central differences, one-sided where a neighbour is missing."""
    def shifted(x: np.ndarray, by: int, empty) -> np.ndarray:
        out = np.full_like(x, empty)
        to, source = [slice(None)] * x.ndim, [slice(None)] * x.ndim
        to[axis], source[axis] = (slice(by, None), slice(None, -by)) if by > 0 else (slice(None, by), slice(-by, None))
        out[tuple(to)] = x[tuple(source)]
        return out

    before, after = shifted(present, 1, False), shifted(present, -1, False)
    low, high = np.where(before, shifted(a, 1, 0.0), a), np.where(after, shifted(a, -1, 0.0), a)
    return (high - low) / np.where(before & after, 2.0, 1.0)


def smooth(mask: np.ndarray, inside: np.ndarray, radius: int) -> np.ndarray:
    """Closing then opening with a square; cells that are not inside are off throughout.

    The erosion that ends the closing and the one that starts the opening are one erosion of twice the radius.
    """
    grown = (box_count(mask, radius) > 0) & inside
    shrunk = (box_count(grown, 2 * radius) == (4 * radius + 1) ** 2) & inside
    return (box_count(shrunk, radius) > 0) & inside
