"""Bands of few and of many rows, scaled alike."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from skyframe.sources import bands

RNG = np.random.default_rng(41)
SIZES = {1: 1, 2: 2, 3: 60, 4: 500, 5: 700}


@pytest.fixture(scope="module")
def table(spark):
    """Scenes with a byte band, a deep one, a flat one and one that is empty in some scenes; odd values, rows twice and rows without a scene among them."""
    rows = []
    for scene, n in SIZES.items():
        for i in range(n):
            rows.append((scene, i, float(RNG.integers(0, 256)), float(RNG.normal() * 1e3), 300.0, float(RNG.random()) if scene % 2 else None))
        rows += [(scene, n, float("nan"), None, 300.0, float("inf")), (scene, n + 1, None, None, float("-inf"), None)]
    rows += [(4, 0, 7.0, 9e9, 300.0, None)] * 2 + [(None, 0, 1.0, 2.0, 3.0, 4.0)]
    return spark.createDataFrame([rows[i] for i in RNG.permutation(len(rows))], "scene long, i int, byte double, deep double, flat double, some double").cache()


def by_hand(table, name):
    got = {}
    for scene in SIZES:
        v = np.array([x for x in (r[name] for r in table.where(F.col("scene") == scene).collect()) if x is not None and np.isfinite(x)])
        if not len(v):
            continue
        lo, hi = np.quantile(v, [0.02, 0.98])
        byte = v.min() >= 0 and v.max() <= 255 and v.max() > 1.5
        got[scene] = sorted(v / 255) if byte else sorted(np.zeros(len(v)) if hi - lo < 1e-9 else np.clip((v - lo) / (hi - lo), 0, 1))
    return got


@pytest.mark.parametrize("held", [65_536, 100, 0])
def test_bands_of_a_row_are_scaled_alike(spark, table, monkeypatch, held):
    monkeypatch.setattr(bands, "HELD", held)
    names = ["byte", "deep", "flat", "some"]
    out = bands.normalise_bands(table, ["scene"], names)
    assert sorted(out.columns) == ["band", "i", "scaled", "scene", "v"]
    found = {}
    for r in out.collect():
        found.setdefault(r["band"], {}).setdefault(r["scene"], []).append(r["scaled"])
    for name in names:
        want = by_hand(table, name)
        assert found[name].keys() == want.keys()
        for scene, values in want.items():
            assert np.allclose(sorted(found[name][scene]), values, atol=1e-12) and len(values) == len(found[name][scene])
    # a band of its own says the same
    alone = bands.normalise_bands(table.select("scene", "i", F.col("deep").alias("v")), ["scene"]).collect()
    assert sorted((r["scene"], r["i"], r["v"], round(r["scaled"], 9)) for r in alone) == sorted(
        (r["scene"], r["i"], r["v"], round(r["scaled"], 9)) for r in out.where("band = 'deep'").collect())


def test_rows_of_many_bands_are_shuffled_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # what Catalyst sees of bands that are many
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(4000).selectExpr("id % 50 AS scene", "id", "double(id) AS a", "double(id % 7) AS b")
        out = bands.normalise_bands(rows, ["scene"], ["a", "b"])
        exchanges = re.findall(r"Exchange (?!Single)\w+\((.*?),", out._jdf.queryExecution().executedPlan().toString())
        assert len(exchanges) == 1 and exchanges[0].startswith("scene")
        assert out.count() == 8000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
