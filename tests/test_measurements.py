import numpy as np
import pytest
from helpers import BANDS, grid, half_water, raster, scene_row
from pyspark.sql import functions as F

from skyframe.functions.indices import index_expr, substitute_indices
from skyframe.operators import landcover
from skyframe.operators.otsu import otsu
from skyframe.operators.stats import exact_quantiles, histogram, index_stats


def numbers(spark, values, key="k"):
    return spark.createDataFrame([(key, float(v)) for v in values], "k string, v double")


def test_ndvi_is_the_definition(spark):
    px = raster(spark, half_water(4))
    v = px.where("r = 3 AND c = 0").select(index_expr("NDVI")).first()[0]
    assert v == pytest.approx(0.48 / 0.62)


def test_missing_band_gives_no_value(spark):
    px = raster(spark, half_water(4)).withColumn("swir2", F.lit(None).cast("double"))
    assert px.select(index_expr("MNDWI").alias("x")).where("x IS NOT NULL").isEmpty()


def test_substitution_for_visible_only_scene(spark):
    df = spark.createDataFrame([(["red", "green", "blue"], ["NDVI"]), (["gray"], ["NDVI"]), (["nir", "red"], ["NDVI", "BSI"])], "bands array<string>, want array<string>")
    out = substitute_indices(F.col("want"), F.col("bands"))
    rows = df.select(*[v.alias(k) for k, v in out.items()]).collect()
    assert rows[0].computed == ["VARI"] and rows[0].substituted_for == ["NDVI"] and rows[0].confidence == 0.70
    assert rows[1].status == "no_data"
    assert rows[2].computed == ["NDVI"] and rows[2].missing == ["BSI"] and rows[2].confidence == 0.95


@pytest.mark.parametrize("values", [
    [1.0], [2.0, 2.0, 2.0], list(np.linspace(-1, 1, 101)), list(np.random.default_rng(1).normal(0, 1e-5, 500)),
    list(np.random.default_rng(2).lognormal(3, 2, 400)), [0.1] * 300 + [0.9] * 7])
def test_quantiles_match_numpy(spark, values):
    probs = {"a": 0.0, "b": 0.02, "c": 0.35, "d": 0.5, "e": 0.98, "f": 1.0}
    got = exact_quantiles(numbers(spark, values), ["k"], "v", probs).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12, abs=1e-15)


def test_quantiles_of_several_keys(spark):
    rng = np.random.default_rng(3)
    parts = {"hot": rng.normal(size=5000), "cold": rng.normal(size=3)}
    df = numbers(spark, parts["hot"], "hot").unionByName(numbers(spark, parts["cold"], "cold"))
    for row in exact_quantiles(df, ["k"], "v", {"q": 0.9}).collect():
        assert row.q == pytest.approx(np.percentile(parts[row.k], 90))


def test_statistics_ignore_masked_pixels(spark):
    a = np.full((10, 10), 0.5)
    a[0] = 99
    valid = np.ones((10, 10), bool)
    valid[0] = False
    st = index_stats(raster(spark, {"v": a}, valid=valid).where("valid"), ["scene_id"], "v").first()
    assert st.mean == 0.5 and st.n == 90 and st["std"] == 0


def test_histogram_closes_the_last_bin(spark):
    rows = histogram(numbers(spark, [-1, -0.96, 0.999, 1.0, 1.2]), ["k"], "v", 40).orderBy("bin").collect()
    assert len(rows) == 40 and rows[0].n == 2 and rows[39].n == 2 and sum(r.n for r in rows) == 4


def brute_otsu(v, bins=256):
    hist, edges = np.histogram(v, bins)
    mid = (edges[1:] + edges[:-1]) / 2
    best, at = -1.0, 0
    for k in range(bins):
        a, b = hist[:k + 1].sum(), hist[k + 1:].sum()
        if a and b:
            gap = (hist[:k + 1] * mid[:k + 1]).sum() / a - (hist[k + 1:] * mid[k + 1:]).sum() / b
            score = a * b / len(v) ** 2 * gap * gap
            if score > best * (1 + 1e-12):
                best, at = score, k
    return mid[at], best / np.var(v)


def test_otsu_against_brute_force(spark):
    rng = np.random.default_rng(4)
    for v in (np.r_[rng.normal(.1, .03, 900), rng.normal(.8, .05, 700)], rng.random(500), rng.normal(size=300)):
        got = otsu(numbers(spark, v), ["k"], "v").first()
        cut, eta = brute_otsu(v)
        assert got.threshold == pytest.approx(cut, abs=1e-9) and got.eta == pytest.approx(eta, abs=1e-9)


def test_otsu_separability_of_one_and_two_modes(spark):
    rng = np.random.default_rng(5)
    two = otsu(numbers(spark, np.r_[rng.normal(.1, .02, 2000), rng.normal(.8, .02, 2000)]), ["k"], "v").first()
    one = otsu(numbers(spark, rng.normal(0, 1, 4000)), ["k"], "v").first()
    assert two.eta > 0.9 and abs(one.eta - 2 / np.pi) < 0.02


def test_otsu_of_tiny_and_constant_groups(spark):
    assert otsu(numbers(spark, [1, 2, 10]), ["k"], "v").first().threshold == 2
    assert otsu(numbers(spark, [1, 2]), ["k"], "v").first().threshold == 1.5
    flat = otsu(numbers(spark, [3.0] * 40), ["k"], "v").first()
    assert flat.threshold == 3.0 and flat.eta == 0


def shares(spark, bands, **kw):
    labels, _ = landcover.segment_landcover(raster(spark, bands), **kw)
    return {r["class"]: r.fraction for r in landcover.class_composition(labels).collect()}


def test_half_water_half_vegetation(spark):
    got = shares(spark, half_water())
    assert abs(got["water"] - 0.5) < 0.06
    assert abs(got["dense_vegetation"] + got["sparse_vegetation"] - 0.5) < 0.06


def test_uniform_dry_scene_is_not_split(spark):
    rng = np.random.default_rng(6)
    base = (0.30, 0.33, 0.35, 0.36, 0.40)
    got = shares(spark, {b: base[i] + rng.normal(0, .004, (48, 48)) for i, b in enumerate(BANDS)})
    assert got["water"] < 0.02 and got["bare_soil"] > 0.9


def test_fixed_cuts_without_adaptation(spark):
    got = shares(spark, half_water(), adaptive=False)
    assert abs(got["dense_vegetation"] - 0.5) < 0.06


def test_visible_scene_goes_the_rgb_way(spark):
    rng = np.random.default_rng(7)
    colours = np.array([[140, 120, 95], [30, 90, 40], [25, 60, 150], [195, 195, 200]])
    which = np.repeat(np.repeat(np.array([[0, 1], [2, 3]]), 40, 0), 40, 1)
    rgb = (colours[which] + rng.integers(-10, 11, (80, 80, 3))) / 255
    px = raster(spark, {b: rgb[..., i] for i, b in enumerate(("red", "green", "blue"))}).withColumns(
        {"nir": F.lit(None).cast("double"), "swir2": F.lit(None).cast("double")})
    both = px.unionByName(raster(spark, half_water(), "m"))
    out = landcover.segment_any(both)
    basis = {r.scene_id: r.basis for r in out.select("scene_id", "basis").distinct().collect()}
    assert basis == {"s": "rgb", "m": "multispectral"}
    water = out.where("scene_id = 's' AND class = 'water'").count() / 6400
    assert water > 0.10


def test_scene_without_usable_bands_is_left_out(spark):
    px = raster(spark, {"gray": np.ones((4, 4))}).withColumns({b: F.lit(None).cast("double") for b in BANDS})
    assert landcover.segment_any(px).count() == 0


def test_labels_are_placed_where_they_belong(spark):
    labels, _ = landcover.segment_landcover(raster(spark, half_water(32)))
    on = labels.withColumn("w", (F.col("class") == "water").cast("int"))
    assert np.array_equal(grid(on, "w", (32, 32)), np.repeat([1.0, 0.0], 16)[:, None] * np.ones((32, 32)))


def test_scene_row_helper(spark):
    assert scene_row(spark, 3, 4).first().width == 4
