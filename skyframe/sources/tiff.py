"""TIFF files of any band count and depth as a Spark data source with partitioned, reduced reads.

The reader takes a file's directory first, then only the strips or tiles of its own rows, one line of them at a time; with
``maxSide`` the values are averaged to blocks as they are read, so a large file never lies in memory. Small files share
a partition; the rows of a large one are divided among several.

Read: classic and BigTIFF of either byte order, strips and tiles, chunky and planar samples, integers and floats of 8
to 64 bits, horizontal prediction, no compression, Deflate, LZW and PackBits. Anything else is a scene row with a reason.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EXTENSIONS = (".tif", ".tiff", ".geotiff")
#: Bytes of files read by one task, unless the option ``splitBytes`` says otherwise. Packed files grow many times when every pixel becomes a row,
#: so a task takes fewer of their bytes than of a columnar file.
SPLIT_BYTES = 2 << 20
PIXELS = "path string, r int, c int, factor int, valid boolean, values array<double>"
SCENES = ("path string, width int, height int, n_bands int, dtype string, descriptions array<string>, nodata double, epsg int, "
          "west double, south double, east double, north double, status string, reason string")

# TIFF 6.0, BigTIFF, GeoTIFF and GDAL: field types (code -> struct letter), tag numbers, geographic keys
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, GDAL_METADATA, GDAL_NODATA = 33550, 33922, 34735, 42112, 42113
GEOGRAPHIC_KEY, PROJECTED_KEY = 2048, 3072
WGS84, WEB_MERCATOR, EARTH_RADIUS = 4326, 3857, 6378137.0
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


class UnreadableTiff(ValueError):
    """The reason a file gives no pixels."""


@dataclass
class Layout:
    """What a file's directory says."""

    width: int
    height: int
    samples: int
    dtype: np.dtype
    compression: int
    predictor: int
    planar: bool
    cell_w: int
    cell_h: int
    offsets: list[int]
    counts: list[int]
    descriptions: list[str] = field(default_factory=list)
    nodata: float | None = None
    epsg: int | None = None
    box: tuple[float, float, float, float] | None = None

    @property
    def across(self) -> int:
        return -(-self.width // self.cell_w)

    @property
    def down(self) -> int:
        return -(-self.height // self.cell_h)


def _tags(read, start: bytes) -> tuple[str, dict[int, tuple]]:
    if len(start) < 8:
        raise UnreadableTiff("too small to be an image")
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    magic = struct.unpack(order + "H", start[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise UnreadableTiff("contents are not a TIFF")
    big = magic == 43
    at = struct.unpack(order + "Q", start[8:16])[0] if big else struct.unpack(order + "I", start[4:8])[0]
    head = read(at, 8 if big else 2)
    n = struct.unpack(order + ("Q" if big else "H"), head)[0]
    size, number = (20, "Q") if big else (12, "I")
    inline = 8 if big else 4
    raw = read(at + len(head), n * size)
    tags = {}
    for k in range(n):
        entry = raw[k * size : (k + 1) * size]
        tag, kind, count = struct.unpack(order + "HH" + number, entry[: 4 + inline])
        letters = TYPES.get(kind)
        if letters is None:
            continue
        length = count * struct.calcsize(order + letters)
        value = entry[4 + inline :][:length] if length <= inline else read(struct.unpack(order + number, entry[4 + inline :])[0], length)
        tags[tag] = (value,) if letters == "s" else struct.unpack(f"{order}{count * len(letters)}{letters[0]}", value)
    return order, tags


def parse(read) -> Layout:
    """The layout of the first image; ``read(offset, length)`` gives bytes of the file."""
    try:
        order, tags = _tags(read, read(0, 16))
        return _layout(order, tags)
    except (struct.error, KeyError, IndexError) as broken:
        raise UnreadableTiff("the file directory is broken") from broken


def _layout(order: str, tags: dict[int, tuple]) -> Layout:
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    bits, formats = set(tags.get(BITS, (1,))), set(tags.get(SAMPLE_FORMAT, (1,)))
    if len(bits) > 1 or len(formats) > 1:
        raise UnreadableTiff("bands of different kinds")
    kind = {1: "u", 2: "i", 3: "f"}.get(formats.pop())
    depth = bits.pop()
    if kind is None or depth not in ((8, 16, 32, 64) if kind != "f" else (16, 32, 64)):
        raise UnreadableTiff(f"samples of {depth} bits are not supported")
    if width < 1 or height < 1 or samples < 1:
        raise UnreadableTiff("an image without pixels")
    compression, predictor = tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0]
    if compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS) or predictor > 2 or (predictor == 2 and kind == "f"):
        raise UnreadableTiff(f"compression {compression} with predictor {predictor} is not supported")
    tiled = TILE_OFFSETS in tags
    layout = Layout(
        width, height, samples, np.dtype(f"{order}{kind}{depth // 8}"), compression, predictor, tags.get(PLANAR, (1,))[0] == 2,
        tags[TILE_WIDTH][0] if tiled else width, tags[TILE_HEIGHT][0] if tiled else min(tags.get(ROWS_PER_STRIP, (height,))[0], height),
        list(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS]), list(tags[TILE_COUNTS if tiled else STRIP_COUNTS]))
    needed = layout.across * layout.down * (samples if layout.planar else 1)
    if len(layout.offsets) < needed or len(layout.counts) < needed:
        raise UnreadableTiff("strips or tiles are missing")
    named = dict(re.findall(r'sample="(\d+)"[^>]*role="description"[^>]*>([^<]*)<', tags.get(GDAL_METADATA, (b"",))[0].decode("utf-8", "replace")))
    layout.descriptions = [named.get(str(k), "") for k in range(samples)]
    try:
        layout.nodata = float(tags[GDAL_NODATA][0].rstrip(b"\0 ").decode()) if GDAL_NODATA in tags else None
    except ValueError:
        layout.nodata = None
    _locate(layout, tags)
    return layout


def _locate(layout: Layout, tags: dict[int, tuple]) -> None:
    """Geographic box of files in WGS 84 or Web Mercator; other projections keep only their code."""
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    layout.epsg = codes.get(PROJECTED_KEY, codes.get(GEOGRAPHIC_KEY))
    if PIXEL_SCALE not in tags or TIE_POINT not in tags or layout.epsg not in (WGS84, WEB_MERCATOR):
        return
    sx, sy = tags[PIXEL_SCALE][:2]
    i, j, _, x, y = tags[TIE_POINT][:5]
    west, north = x - i * sx, y + j * sy
    box = (west, north - layout.height * sy, west + layout.width * sx, north)
    if layout.epsg == WEB_MERCATOR:
        box = tuple(math.degrees(v / EARTH_RADIUS) if k % 2 == 0 else math.degrees(math.atan(math.sinh(v / EARTH_RADIUS))) for k, v in enumerate(box))
    layout.box = box


def _unpack_bits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += raw[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def _unpack_lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears the table and 257 ends."""
    out, table, width, held, bits, last = [], [], 9, 0, 0, b""
    for byte in raw:
        held, bits = ((held << 8) | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = (held >> bits) & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((k,)) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not last:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        # the encoder widens its codes one entry early
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


def _cell(layout: Layout, raw: bytes, inside: int) -> np.ndarray:
    """One strip or tile as (rows, columns, samples), of which ``inside`` rows are wanted; a last strip may be short."""
    try:
        if layout.compression in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompress(raw)
        elif layout.compression == LZW:
            raw = _unpack_lzw(raw)
        elif layout.compression == PACKBITS:
            raw = _unpack_bits(raw)
        n = 1 if layout.planar else layout.samples
        cell = np.frombuffer(raw, layout.dtype, inside * layout.cell_w * n).reshape(inside, layout.cell_w, n)
    except (zlib.error, ValueError, IndexError) as broken:
        raise UnreadableTiff("a strip or tile is broken") from broken
    if layout.predictor == 2:
        cell = np.cumsum(cell, axis=1, dtype=layout.dtype.newbyteorder("="))
    return cell


def rows_of(layout: Layout, read, top: int, bottom: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x width x bands) of the image rows top to bottom, a line of strips or tiles at a time."""
    per_plane = layout.across * layout.down
    for line in range(top // layout.cell_h, -(-bottom // layout.cell_h)):
        first = line * layout.cell_h
        inside = min(layout.cell_h, layout.height - first)
        planes = []
        for plane in range(layout.samples if layout.planar else 1):
            cells = []
            for column in range(layout.across):
                k = plane * per_plane + line * layout.across + column
                cells.append(_cell(layout, read(layout.offsets[k], layout.counts[k]), inside))
            planes.append(np.concatenate(cells, axis=1)[:, : layout.width])
        block = np.concatenate(planes, axis=2)
        a, b = max(top, first), min(bottom, first + inside)
        yield a, block[a - first : b - first]


def factor_of(layout: Layout, max_side: int | None) -> int:
    return 1 if not max_side else max(1, -(-max(layout.width, layout.height) // max_side))


def _batches(path: str, layout: Layout, read, factor: int, top: int, bottom: int) -> Iterator[pa.RecordBatch]:
    """Pixel rows of the reduced image rows top to bottom; a block is the mean of its valid pixels, and valid if it has any."""
    width = layout.width // factor
    total, count, done = None, None, 0
    for first, block in rows_of(layout, read, top * factor, bottom * factor):
        value = block[:, : width * factor].astype(np.float64)
        good = np.isfinite(value).all(axis=2) if layout.nodata is None else (np.isfinite(value) & (value != layout.nodata)).all(axis=2)
        if factor == 1:
            yield _batch(path, first, value, good, factor)
            continue
        value = np.where(good[..., None], value, 0.0)
        for k in range(len(block)):
            if total is None:
                total, count = np.zeros((width, layout.samples)), np.zeros(width)
            total += value[k].reshape(width, factor, -1).sum(axis=1)
            count += good[k].reshape(width, factor).sum(axis=1)
            done += 1
            if done == factor:
                yield _batch(path, (first + k) // factor, (total / np.maximum(count, 1)[:, None])[None], (count > 0)[None], factor)
                total, done = None, 0


def _batch(path: str, top: int, value: np.ndarray, good: np.ndarray, factor: int) -> pa.RecordBatch:
    h, w, n = value.shape
    r, c = np.indices((h, w), dtype=np.int32)
    flat = np.where(np.isfinite(value), value, np.nan).ravel()
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, h * w * n + 1, n, dtype=np.int32)), pa.array(flat))
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * (h * w)), pa.array(r.ravel() + np.int32(top)), pa.array(c.ravel()), pa.array(np.full(h * w, factor, np.int32)), pa.array(good.ravel()), lists],
        ["path", "r", "c", "factor", "valid", "values"])


def filesystem(path: str):
    """(file system, name in it) of a path or URI."""
    from pyarrow import fs

    if re.match(r"^[a-z0-9]+://", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


def _reader(path: str):
    system, name = filesystem(path)
    file = system.open_input_file(name)

    def read(offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > file.size():
            raise UnreadableTiff("the file is cut off")
        file.seek(offset)
        return file.read(length)

    return file, read


@dataclass
class Piece(InputPartition):
    """Files read whole (no rows given), or some reduced rows of one file."""

    files: list[tuple[str, int | None, int | None]]


class TiffReader(DataSourceReader):
    def __init__(self, options: dict, scenes: bool):
        self.path, self.scenes = options["path"], scenes
        self.max_side = int(options["maxside"]) if options.get("maxside") else None
        self.split = int(options.get("splitbytes") or SPLIT_BYTES)

    def partitions(self) -> list[Piece]:
        from pyarrow import fs

        system, name = filesystem(self.path)
        info = system.get_file_info(name)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(EXTENSIONS))
        prefix = self.path[: self.path.index("://") + 3] if re.match(r"^[a-z0-9]+://", self.path) and not self.path.startswith("file:") else ""
        pieces, held, size = [], [], 0
        for path, length in files:
            if length > self.split and not self.scenes:
                pieces += self._rows(prefix + path, length)
                continue
            if held and size + length > self.split:
                pieces.append(Piece(held))
                held, size = [], 0
            held.append((prefix + path, None, None))
            size += length
        return pieces + ([Piece(held)] if held or not pieces else [])

    def _rows(self, path: str, length: int) -> list[Piece]:
        file, read = _reader(path)
        with file:
            try:
                layout = parse(read)
            except UnreadableTiff:
                return []
        factor = factor_of(layout, self.max_side)
        n = layout.height // factor
        # whole lines of strips or tiles where they are not larger than a split
        step = max(1, -(-n // -(-length // self.split)))
        line = max(1, layout.cell_h // factor)
        step = -(-step // line) * line
        return [Piece([(path, a, min(a + step, n))]) for a in range(0, n, step)]

    def read(self, piece: Piece) -> Iterator:
        for path, top, bottom in piece.files:
            file, read = _reader(path)
            with file:
                if self.scenes:
                    yield self._scene(path, read)
                    continue
                try:
                    layout = parse(read)
                    factor = factor_of(layout, self.max_side)
                    yield from _batches(path, layout, read, factor, top or 0, layout.height // factor if bottom is None else bottom)
                except UnreadableTiff:
                    continue  # the scene row says why

    def _scene(self, path: str, read) -> tuple:
        try:
            x = parse(read)
        except UnreadableTiff as why:
            return (path, *[None] * 11, "rejected", str(why))
        return (path, x.width, x.height, x.samples, x.dtype.newbyteorder("=").name, x.descriptions, x.nodata, x.epsg, *(x.box or [None] * 4), "accepted", None)


class TiffPixels(DataSource):
    """``spark.read.format("tiff").load(folder)``: one row per pixel."""

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> TiffReader:
        return TiffReader({k.lower(): v for k, v in self.options.items()}, scenes=False)


class TiffScenes(DataSource):
    """``spark.read.format("tiff_scenes").load(folder)``: one row per file, accepted or with the reason why not."""

    @classmethod
    def name(cls) -> str:
        return "tiff_scenes"

    def schema(self) -> str:
        return SCENES

    def reader(self, schema) -> TiffReader:
        return TiffReader({k.lower(): v for k, v in self.options.items()}, scenes=True)


def scan_tiff(spark: SparkSession, path: str, max_side: int | None = None, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(scenes, pixels) of all TIFF files below ``path``; values keep the units of the file."""
    for source in (TiffPixels, TiffScenes):
        spark.dataSource.register(source)
    options = {"splitBytes": str(split_bytes)} | ({"maxSide": str(max_side)} if max_side else {})
    return spark.read.format("tiff_scenes").options(**options).load(path), spark.read.format("tiff").options(**options).load(path)


def encode(cube: np.ndarray, tile: int | None = None, rows_per_strip: int | None = None, deflate: bool = False, predictor: bool = False, planar: bool = False,
           descriptions: list[str] | None = None, nodata: float | None = None, box: tuple | None = None, big_endian: bool = False) -> bytes:
    """A TIFF file of (rows, columns, bands); ``box`` is its extent in WGS 84."""
    order = ">" if big_endian else "<"
    h, w, n = cube.shape
    cube = cube.astype(cube.dtype.newbyteorder(order))
    cw, ch = (tile, tile) if tile else (w, rows_per_strip or h)
    cells = []
    for plane in (range(n) if planar else [slice(None)]):
        part = cube[:, :, plane : plane + 1] if planar else cube
        for top in range(0, h, ch):
            for left in range(0, w, cw):
                cell = part[top : top + ch, left : left + cw]
                if tile:
                    cell = np.pad(cell, ((0, ch - cell.shape[0]), (0, cw - cell.shape[1]), (0, 0)))
                if predictor:
                    cell = np.diff(cell, axis=1, prepend=np.zeros_like(cell[:, :1])).astype(cube.dtype)
                raw = np.ascontiguousarray(cell).tobytes()
                cells.append(zlib.compress(raw) if deflate else raw)
    kind = {"u": 1, "i": 2, "f": 3}[cube.dtype.kind]
    entries = {WIDTH: ("I", [w]), HEIGHT: ("I", [h]), BITS: ("H", [cube.dtype.itemsize * 8] * n), COMPRESSION: ("H", [DEFLATE if deflate else NONE]), SAMPLES: ("H", [n]),
               PLANAR: ("H", [2 if planar else 1]), PREDICTOR: ("H", [2 if predictor else 1]), SAMPLE_FORMAT: ("H", [kind] * n)}
    at, offsets = 8, []
    for cell in cells:
        offsets.append(at)
        at += len(cell) + len(cell) % 2
    entries |= {TILE_WIDTH: ("I", [cw]), TILE_HEIGHT: ("I", [ch]), TILE_OFFSETS: ("I", offsets), TILE_COUNTS: ("I", [len(c) for c in cells])} if tile else {
        ROWS_PER_STRIP: ("I", [ch]), STRIP_OFFSETS: ("I", offsets), STRIP_COUNTS: ("I", [len(c) for c in cells])}
    if box:
        west, south, east, north = box
        entries |= {PIXEL_SCALE: ("d", [(east - west) / w, (north - south) / h, 0.0]), TIE_POINT: ("d", [0.0, 0.0, 0.0, west, north, 0.0]),
                    GEO_KEYS: ("H", [1, 1, 0, 1, GEOGRAPHIC_KEY, 0, 1, WGS84])}
    if descriptions:
        items = "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{d}</Item>' for k, d in enumerate(descriptions))
        entries[GDAL_METADATA] = ("s", f"<GDALMetadata>{items}</GDALMetadata>\0".encode())
    if nodata is not None:
        entries[GDAL_NODATA] = ("s", f"{nodata:g}\0".encode())
    codes = {letter: code for code, letter in TYPES.items() if code in (2, 3, 4, 12)}
    directory, extra = b"", b""
    after = at + 2 + 12 * len(entries) + 4
    for tag in sorted(entries):
        letter, values = entries[tag]
        raw = values if letter == "s" else struct.pack(f"{order}{len(values)}{letter}", *values)
        inline = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", after + len(extra))
        if len(raw) > 4:
            extra += raw + b"\0" * (len(raw) % 2)
        directory += struct.pack(order + "HHI", tag, codes[letter], len(values)) + inline
    body = b"".join(c + b"\0" * (len(c) % 2) for c in cells)
    return (b"MM" if big_endian else b"II") + struct.pack(order + "HI", 42, at) + body + struct.pack(order + "H", len(entries)) + directory + struct.pack(order + "I", 0) + extra
