"""Statistics, Otsu and land-cover segmentation over the raster view."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.fixed_values import CLASSES, INDEX_BANDS
from skyframe.functions.indices import index_expr
from skyframe.operators import landcover
from skyframe.operators.otsu import cumulative_histogram, otsu
from skyframe.operators.stats import exact_quantiles, histogram, index_stats, melt

from .fixtures import pixels, with_px
from .registry import query
from .sql_parts import INDEX_SQL, landcover_ctes, otsu_ctes, rgb_ctes

LONG_CTE = "long AS (" + " UNION ALL ".join(
    f"SELECT scene_id, '{k}' AS metric, {sql} AS v FROM px" for k, sql in INDEX_SQL.items()) + ")"


def _long(spark, sf_dir):
    return melt(pixels(spark, sf_dir), ["scene_id"], {k: index_expr(k) for k in INDEX_BANDS})


@query("a1_index_stats", with_px("""
SELECT scene_id, metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_pop(v), 6) AS std,
  round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.1), 6) AS p10,
  round(quantile_cont(v, 0.9), 6) AS p90, count(*) AS n
FROM long GROUP BY scene_id, metric""", LONG_CTE))
def a1(spark, sf_dir):
    st = index_stats(_long(spark, sf_dir), ["scene_id", "metric"], "v")
    return st.select("scene_id", "metric", "n", *[F.round(c, 6).alias(c) for c in
                                                  ("mean", "median", "std", "min", "max", "p10", "p90")])


@query("a2_histogram", with_px("""
SELECT k.scene_id, k.metric, CAST(b.bin AS INT) AS bin, coalesce(n, 0) AS n
FROM (SELECT DISTINCT scene_id, metric FROM long) k CROSS JOIN range(0, 40) b(bin)
LEFT JOIN (SELECT scene_id, metric, least(floor((v + 1.0) / 2.0 * 40), 39) AS bin, count(*) AS n
           FROM long WHERE v BETWEEN -1 AND 1 GROUP BY ALL) h
  ON h.scene_id = k.scene_id AND h.metric = k.metric AND h.bin = b.bin""", LONG_CTE))
def a2(spark, sf_dir):
    return histogram(_long(spark, sf_dir), ["scene_id", "metric"], "v", 40, -1.0, 1.0)


@query("a3_otsu", with_px("""
SELECT scene_id, metric, round(threshold, 9) AS threshold, round(eta, 6) AS eta, n FROM cut""",
                          LONG_CTE, *otsu_ctes("cut", "long", "scene_id, metric")))
def a3(spark, sf_dir):
    cut = otsu(_long(spark, sf_dir), ["scene_id", "metric"], "v")
    return cut.select("scene_id", "metric", F.round("threshold", 9).alias("threshold"), F.round("eta", 6).alias("eta"), "n")


@query("w1_cumulative_histogram", with_px("""
SELECT scene_id, bin, n, sum(n) OVER w AS n0, sum(n * (2 * bin + 1)) OVER w AS s0 FROM (
  SELECT scene_id, CAST(least(floor((v + 1.0) / 2.0 * 256), 255) AS BIGINT) AS bin, count(*) AS n FROM long
  WHERE metric = 'NDVI' GROUP BY ALL) WINDOW w AS (PARTITION BY scene_id ORDER BY bin)""", LONG_CTE).replace(
    "sum(n) OVER w AS n0, sum(n * (2 * bin + 1)) OVER w AS s0",
    "CAST(sum(n) OVER w AS BIGINT) AS n0, CAST(sum(n * (2 * bin + 1)) OVER w AS BIGINT) AS s0"))
def w1(spark, sf_dir):
    binned = pixels(spark, sf_dir).groupBy(
        "scene_id", F.least(F.floor((index_expr("NDVI") + 1.0) / 2.0 * 256), F.lit(255)).cast("long").alias("bin")
    ).agg(F.count("*").alias("n"))
    return cumulative_histogram(binned, ["scene_id"]).select("scene_id", "bin", "n", "n0", "s0")


@query("w1_exact_quantiles", with_px("""
SELECT scene_id, metric, round(quantile_cont(v, 0.02), 6) AS p02, round(quantile_cont(v, 0.35), 6) AS p35,
  round(quantile_cont(v, 0.98), 6) AS p98 FROM long GROUP BY scene_id, metric""", LONG_CTE))
def quantiles(spark, sf_dir):
    q = exact_quantiles(_long(spark, sf_dir), ["scene_id", "metric"], "v", {"p02": 0.02, "p35": 0.35, "p98": 0.98})
    return q.select("scene_id", "metric", *[F.round(c, 6).alias(c) for c in ("p02", "p35", "p98")])


CUT_COLS = ("t_water", "eta_water", "nir_cut", "nir_eta", "t_veg", "t_dense", "t_built", "eta_built", "gap_built")


@query("c2_landcover_thresholds", with_px(
    "SELECT scene_id, n_valid, split_built, " + ", ".join(f"round({c}, 6) AS {c}" for c in CUT_COLS) + " FROM lc_cuts",
    *landcover_ctes()))
def c2_cuts(spark, sf_dir):
    _, cuts = landcover.segment_landcover(pixels(spark, sf_dir))
    return cuts.select("scene_id", "n_valid", "split_built", *[F.round(c, 6).alias(c) for c in CUT_COLS])


@query("c2_segment_landcover", with_px("SELECT scene_id, r, c, truth, class FROM lc", *landcover_ctes()))
def c2(spark, sf_dir):
    labels, _ = landcover.segment_landcover(pixels(spark, sf_dir))
    return labels.select("scene_id", "r", "c", "truth", "class")


@query("j3_apply_thresholds", with_px("""
SELECT scene_id, class, count(*) AS pixels, count(*) FILTER (truth = 'water') AS water_truth FROM lc GROUP BY ALL""",
                                     *landcover_ctes()))
def j3(spark, sf_dir):
    px = pixels(spark, sf_dir)
    cuts = landcover.multispectral_thresholds(px)
    return landcover.apply_multispectral(px, cuts).groupBy("scene_id", "class").agg(
        F.count("*").alias("pixels"), F.count_if(F.col("truth") == "water").alias("water_truth"))


COMPOSITION = """
SELECT s.scene_id, k.class, coalesce(pixels, 0) AS pixels, s.valid_pixels, round(coalesce(pixels, 0) / s.valid_pixels, 6) AS fraction
FROM (SELECT scene_id, count(*) AS valid_pixels FROM {lc} GROUP BY 1) s
CROSS JOIN (SELECT unnest([{classes}]) AS class) k
LEFT JOIN (SELECT scene_id, class, count(*) AS pixels FROM {lc} GROUP BY ALL) p ON p.scene_id = s.scene_id AND p.class = k.class
"""
CLASS_LIST = ", ".join(f"'{c}'" for c in CLASSES)


@query("a4_class_composition", with_px(COMPOSITION.format(lc="lc", classes=CLASS_LIST), *landcover_ctes()))
def a4(spark, sf_dir):
    labels, _ = landcover.segment_landcover(pixels(spark, sf_dir))
    return landcover.class_composition(labels).withColumn("fraction", F.round("fraction", 6))


@query("c3_segment_landcover_rgb", with_px(COMPOSITION.format(lc="rgb", classes=CLASS_LIST), *rgb_ctes()))
def c3(spark, sf_dir):
    px = pixels(spark, sf_dir).select("scene_id", "r", "c", "red", "green", "blue")
    labels, _ = landcover.segment_landcover(px, visible_only=True)
    return landcover.class_composition(labels).withColumn("fraction", F.round("fraction", 6))
