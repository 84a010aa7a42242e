import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.operators import tiles
from skyframe.sources import bands, images
from skyframe.streaming import ingest_stream, run_to_table


def png(a):
    """Minimal PNG bytes of an (h, w) or (h, w, 3|4) uint8 array."""
    kind = {2: 0, 3: {3: 2, 4: 6}.get(a.shape[-1])}[a.ndim]
    raw = b"".join(b"\0" + row.tobytes() for row in a)

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    rgba = rng.integers(0, 256, (5, 7, 4), dtype=np.uint8)
    rgba[0, :, 3] = 0
    rgba[1:, :, 3] = 255
    made = {"rgb.png": rng.integers(0, 256, (6, 4, 3), dtype=np.uint8), "gray.png": rng.integers(0, 256, (3, 9), dtype=np.uint8), "rgba.png": rgba}
    for name, a in made.items():
        (tmp_path / name).write_bytes(png(a))
    (tmp_path / "broken.png").write_bytes(png(made["rgb.png"])[:40] + b"\0" * 30)
    (tmp_path / "notes.tif").write_bytes(b"%PDF-1.4 " + b"x" * 60)
    (tmp_path / "copy.png").write_bytes(png(made["rgb.png"]))
    return tmp_path, made


def test_scan_images_decodes_every_pixel(spark, folder):
    path, made = folder
    scenes, px = images.scan_images(spark, str(path))
    readable = {r.path.rsplit("/", 1)[1]: r.readable for r in scenes.collect()}
    assert readable["rgb.png"] and not readable["broken.png"]
    rows = {}
    for r in px.collect():
        rows.setdefault(r.scene_id.rsplit("/", 1)[1], {})[r.r, r.c] = r
    a = made["rgb.png"]
    assert all(np.allclose([v.red, v.green, v.blue], a[k] / 255) and v.gray is None and v.valid for k, v in rows["rgb.png"].items())
    assert all(np.isclose(v.gray, made["gray.png"][k] / 255) and v.red is None for k, v in rows["gray.png"].items())
    assert all(v.valid == (k[0] > 0) for k, v in rows["rgba.png"].items()) and len(rows["rgba.png"]) == 35


def test_validation_names_the_reason(spark, folder):
    files = spark.read.format("binaryFile").load(str(folder[0]))
    got = {r.path.rsplit("/", 1)[1]: r.reason for r in images.validate_files(files).collect()}
    assert got["rgb.png"] is None and got["notes.tif"] == "contents are not an image"


def test_ingest_stream_keeps_one_of_equal_files(spark, folder):
    rows = run_to_table(ingest_stream(spark, str(folder[0]), "*.png"), "t-ingest").collect()
    assert len(rows) == 4 and {r.status for r in rows} == {"accepted"}


def test_normalise_bands(spark):
    rng = np.random.default_rng(2)
    data = {"byte": rng.integers(0, 256, 300).astype(float), "deep": rng.integers(0, 5000, 300).astype(float), "flat": np.full(50, 9.0), "neg": np.full(20, -3.0)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "band string, v double")
    got = {}
    for r in bands.normalise_bands(df, ["band"]).collect():
        got.setdefault(r.band, []).append((r.v, r.scaled))
    lo, hi = np.percentile(data["deep"], [2, 98])
    assert all(np.isclose(s, v / 255) for v, s in got["byte"])
    assert all(np.isclose(s, np.clip((v - lo) / (hi - lo), 0, 1)) for v, s in got["deep"])
    assert all(np.isclose(s, 9 / 255) for _, s in got["flat"]) and all(s == 0 for _, s in got["neg"])


def test_tiles_and_even_sampling(spark):
    grid = spark.createDataFrame([("s", 70, 50)], "scene_id string, width int, height int")
    px = spark.range(50 * 70).select(F.lit("s").alias("scene_id"), F.expr("int(id div 70) AS r"), F.expr("int(id % 70) AS c"))
    got = {(r.tile_r, r.tile_c) for r in tiles.tile_scenes(tiles.tile_pixels(px, grid, 16, 8), 16).collect()}
    want = [(y, x) for y in range(0, 50 - 16 + 1, 8) for x in range(0, 70 - 16 + 1, 8)]
    assert got == set(want)
    many = spark.createDataFrame([("s", y, x) for y, x in want], "scene_id string, tile_r int, tile_c int")
    for limit in (5, 7, 12, 39, 40, 41):
        kept = {(r.tile_r, r.tile_c) for r in tiles.sample_evenly(many, limit).collect()}
        picks = range(len(want)) if len(want) <= limit else {i * (len(want) - 1) // (limit - 1) for i in range(limit)}
        assert kept == {want[i] for i in picks}


def brute_features(p):
    """The 196 values from their definitions."""
    eps, (r, g, b) = 1e-6, np.moveaxis(p, -1, 0)
    gray, mx, mn, tot = p.mean(-1), p.max(-1), p.min(-1), np.maximum(p.sum(-1), eps)
    ratio = lambda a, d: a / np.maximum(d, eps)
    chans = [r, g, b, ratio(g - r, g + r), 2 * g - r - b, ratio(2 * g - r - b, 2 * g + r + b), ratio(g - r, g + r), ratio(r - b, r + b),
             r / tot, g / tot, b / tot, gray, ratio(mx - mn, mx)]
    out = []
    for ch in chans:
        z = (ch - ch.mean()) / max(ch.std(), eps)
        out += [ch.mean(), ch.std(), (z**3).mean(), (z**4).mean(), *np.percentile(ch, (5, 25, 50, 75, 95))]
    n = gray.shape[0]
    for k in (3, 7, 15):
        q = np.pad(gray, k // 2, mode="reflect")
        ls = np.array([q[i:i + k, j:j + k].std() for i in range(n) for j in range(n)])
        out += [ls.mean(), ls.std(), np.percentile(ls, 90)]
    gy, gx = np.gradient(gray)
    mag = np.hypot(gx, gy)
    out += [mag.mean(), mag.std(), np.percentile(mag, 95), (abs(gx) + abs(gy) > 0.06).mean()]
    for ch in (r, g, b):
        out += list(np.histogram(ch, 12, (0, 1))[0] / ch.size)
    cut = [i * n // 3 for i in range(4)]
    for i in range(3):
        for j in range(3):
            out += list(p[cut[i]:cut[i + 1], cut[j]:cut[j + 1]].mean((0, 1)))
    a, c = gray.mean(1).std(), gray.mean(0).std()
    return np.array(out + [a, c, abs(a - c)])


def test_patch_features_against_numpy(spark):
    rng = np.random.default_rng(5)
    patches = {"a": rng.random((16, 16, 3)), "b": np.clip(rng.normal(0.4, 0.1, (16, 16, 3)), 0, 1)}
    rows = [(k, int(i), int(j), 16, 16, *map(float, p[i, j])) for k, p in patches.items() for i in range(16) for j in range(16)]
    df = spark.createDataFrame(rows, "tile_id string, r int, c int, height int, width int, red double, green double, blue double")
    assert len(tiles.feature_names()) == 196
    for row in tiles.patch_features(df).collect():
        assert np.allclose(row.features, brute_features(patches[row.tile_id]), atol=1e-6)


def test_means_are_added_in_raster_order():
    from skyframe.operators.tiles import _moment_values

    v = np.full((1, 64), 1 / 3)
    v[0, 9] = 0.0
    plain = 0.0
    for x in v[0]:
        plain += x
    assert plain != v.sum() and _moment_values(v)[0, 0] == plain / 64
