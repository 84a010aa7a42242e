"""The TIFF source against planted files of every layout it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.sources import tiff

RNG = np.random.default_rng(8)


def from_bytes(body):
    return lambda at, n: body[at : at + n]


def whole(body):
    layout = tiff.parse(from_bytes(body))
    return layout, np.concatenate([block for _, block in tiff.rows_of(layout, from_bytes(body), 0, layout.height)])


@pytest.mark.parametrize("dtype", ["u1", "u2", "i2", "u4", "f4", "f8"])
@pytest.mark.parametrize("bands", [1, 2, 5, 6])
@pytest.mark.parametrize("layout", [dict(), dict(rows_per_strip=7), dict(tile=16), dict(tile=16, planar=True, deflate=True), dict(rows_per_strip=5, planar=True, big_endian=True),
                                    dict(rows_per_strip=9, deflate=True, predictor=True), dict(tile=16, predictor=True, big_endian=True)])
def test_round_trip(dtype, bands, layout):
    if layout.get("predictor") and dtype[0] == "f":
        pytest.skip("prediction is for integers")
    cube = (RNG.random((37, 45, bands)) * 200).astype(dtype)
    found, got = whole(tiff.encode(cube, descriptions=[f"B{k}" for k in range(bands)], nodata=3, box=(70.0, 20.0, 71.0, 21.0), **layout))
    assert np.array_equal(got, cube) and found.samples == bands and found.nodata == 3 and found.descriptions == [f"B{k}" for k in range(bands)]
    assert found.box == pytest.approx((70.0, 20.0, 71.0, 21.0)) and found.epsg == 4326


def packed_lzw(data):
    table, out, width, held, bits = {bytes((k,)): k for k in range(256)}, bytearray(), 9, 0, 0

    def put(code):
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)

    put(256)
    n, word = 258, b""
    for byte in data:
        more = word + bytes((byte,))
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = n
        n += 1
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
        if n == 4094:
            put(256)
            table, n, width = {bytes((k,)): k for k in range(256)}, 258, 9
        word = bytes((byte,))
    put(table[word])
    n += 1
    width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


@pytest.mark.parametrize("data", [b"abababababab" * 40, bytes(RNG.integers(0, 256, 20_000, dtype=np.uint8)), bytes(RNG.integers(0, 4, 60_000, dtype=np.uint8)), b"x"])
def test_lzw_and_pack_bits(data):
    assert tiff._unpack_lzw(packed_lzw(data)) == data
    packed = b"".join(bytes((len(data[i : i + 128]) - 1,)) + data[i : i + 128] for i in range(0, len(data), 128)) + bytes((128, 254)) + b"z"
    assert tiff._unpack_bits(packed) == data + b"zzz"


def test_web_mercator_box():
    layout = tiff.Layout(10, 10, 1, np.dtype("u1"), 1, 1, False, 10, 10, [0], [100])
    tiff._locate(layout, {tiff.GEO_KEYS: (1, 1, 0, 1, tiff.PROJECTED_KEY, 0, 1, 3857), tiff.PIXEL_SCALE: (1000.0, 1000.0, 0.0), tiff.TIE_POINT: (0.0, 0.0, 0.0, 0.0, 0.0, 0.0)})
    assert layout.box == pytest.approx((0.0, -0.0898315, 0.0898315, 0.0), abs=1e-6)


def test_files_of_a_folder(spark, tmp_path):
    cube = RNG.integers(1, 60_000, (50, 41, 5)).astype("u2")
    cube[3:9, 4:20] = 0
    real = RNG.random((20, 30, 2)).astype("f4")
    real[0, 0, 1] = np.nan
    (tmp_path / "sub").mkdir()
    (tmp_path / "five.tif").write_bytes(tiff.encode(cube, rows_per_strip=4, nodata=0))
    (tmp_path / "sub" / "two.TIFF").write_bytes(tiff.encode(real, tile=16, deflate=True))
    (tmp_path / "text.tif").write_bytes(b"not an image at all, but some text")
    (tmp_path / "empty.tif").write_bytes(b"")
    (tmp_path / "cut.tif").write_bytes(tiff.encode(cube)[:5000])
    (tmp_path / "other.png").write_bytes(b"ignored")
    for split in (1 << 30, 3000):
        scenes, px = tiff.scan_tiff(spark, str(tmp_path), split_bytes=split)
        found = {r["path"].rsplit("/", 1)[1]: r for r in scenes.collect()}
        assert {k: r["status"] for k, r in found.items()} == {"five.tif": "accepted", "two.TIFF": "accepted", "text.tif": "rejected", "empty.tif": "rejected", "cut.tif": "rejected"}
        assert found["text.tif"]["reason"] == "contents are not a TIFF" and (found["five.tif"]["n_bands"], found["two.TIFF"]["dtype"]) == (5, "float32")
        rows = px.collect()
        assert len(rows) == cube[..., 0].size + real[..., 0].size
        for r in rows:
            source = cube if r["path"].endswith("five.tif") else real
            want = source[r["r"], r["c"]].astype(float)
            assert np.array_equal(np.array(r["values"]), want, equal_nan=True)
            assert r["valid"] == (bool((want != 0).all()) if source is cube else not np.isnan(want).any())
    assert px.rdd.getNumPartitions() > 4


def test_reduced_while_reading(spark, tmp_path):
    cube = RNG.integers(0, 9, (50, 41, 6)).astype("u2")
    (tmp_path / "a.tif").write_bytes(tiff.encode(cube, rows_per_strip=7, nodata=0))
    for split in (1 << 30, 1000):
        _, px = tiff.scan_tiff(spark, f"file://{tmp_path}", max_side=13, split_bytes=split)
        rows = px.collect()
        assert len(rows) == (50 // 4) * (41 // 4) and {r["factor"] for r in rows} == {4}
        for r in rows:
            block = cube[4 * r["r"] : 4 * r["r"] + 4, 4 * r["c"] : 4 * r["c"] + 4].reshape(-1, 6).astype(float)
            block = block[(block != 0).all(axis=1)]
            assert r["valid"] == bool(len(block))
            if len(block):
                assert np.allclose(r["values"], block.mean(axis=0))


def test_a_folder_without_files(spark, tmp_path):
    scenes, px = tiff.scan_tiff(spark, str(tmp_path))
    assert scenes.collect() == [] and px.where(F.col("valid")).collect() == []
