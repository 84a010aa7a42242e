"""Views derived from the given tables, as SQL that Spark and DuckDB both run.

Rasters: one area of interest per 16,384 order keys and one scene per area and
ship year, so the number of scenes grows with the data while a scene stays
64 x 64 cells. Cells no line item falls on are the invalid pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.session import materialise

from .registry import table

PX_SQL = """
SELECT aoi, yr, aoi * 10000 + yr AS scene_id, r, c, truth,
  (CASE truth WHEN 'water' THEN 71 WHEN 'veg' THEN 15 WHEN 'bare' THEN 76 WHEN 'built' THEN 92 ELSE 230 END + n) AS blue_u8,
  (CASE truth WHEN 'water' THEN 76 WHEN 'veg' THEN 36 WHEN 'bare' THEN 84 WHEN 'built' THEN 97 ELSE 230 END + n) AS green_u8,
  (CASE truth WHEN 'water' THEN 31 WHEN 'veg' THEN 18 WHEN 'bare' THEN 89 WHEN 'built' THEN 102 ELSE 230 END + n) AS red_u8,
  (CASE truth WHEN 'water' THEN 13 WHEN 'veg' THEN 140 WHEN 'bare' THEN 92 WHEN 'built' THEN 64 ELSE 200 END + n) AS nir_u8,
  (CASE truth WHEN 'water' THEN 5 WHEN 'veg' THEN 51 WHEN 'bare' THEN 102 WHEN 'built' THEN 153 ELSE 120 END + n) AS swir2_u8,
  (CASE truth WHEN 'water' THEN 8 WHEN 'veg' THEN 110 WHEN 'bare' THEN 90 WHEN 'built' THEN 200 ELSE CASE WHEN c < 56 THEN 8 ELSE 110 END END + n) AS sar_u8
FROM (
  SELECT aoi, yr, r, c, n,
    CASE WHEN yr = 1998 AND r >= 40 AND c >= 48 THEN 'cloud'
         WHEN r < 20 + (yr - 1995) * 2 THEN 'water'
         WHEN c < 32 THEN 'veg'
         WHEN (CAST(floor(r / 8.0) AS INT) + CAST(floor(c / 8.0) AS INT)) % 2 = 0 THEN 'built'
         ELSE 'bare' END AS truth
  FROM (
    SELECT CAST(floor(l_orderkey / 16384.0) AS BIGINT) AS aoi, CAST(year(l_shipdate) AS INT) AS yr,
           CAST(l_orderkey % 64 AS INT) AS r, CAST(l_partkey % 64 AS INT) AS c,
           MAX(CAST(l_quantity AS INT)) % 10 AS n
    FROM {lineitem} GROUP BY 1, 2, 3, 4) cell) k
"""
# reflectances: the fixture's pixels table
PIXELS_SQL = f"""
SELECT scene_id, aoi, yr, r, c, truth, blue_u8 / 255.0 AS blue, green_u8 / 255.0 AS green,
  red_u8 / 255.0 AS red, nir_u8 / 255.0 AS nir, swir2_u8 / 255.0 AS swir2, sar_u8 / 255.0 AS sar
FROM ({PX_SQL}) px
"""
QUESTIONS_SQL = """
SELECT o_orderkey AS question_id,
  CASE o_orderkey % 6
   WHEN 0 THEN concat('What changed around ', n_name, ' between January 2021 and October 2023?')
   WHEN 1 THEN concat('Highlight the water body in ', n_name)
   WHEN 2 THEN concat('What is the mean NDVI over ', n_name, ' on ', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), '?')
   WHEN 3 THEN concat(n_name, ' floods 2020')
   WHEN 4 THEN concat('Use the optical and SAR images together over ', n_name)
   ELSE 'How much water is there?' END AS text
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""
PROBES_SQL = """
SELECT event_type AS layer_key, CAST(ts AS DATE) AS probe_date,
  CAST(least(1.0, count(*) / 80.0) AS DOUBLE) AS coverage,
  sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS cloud_fraction,
  sum(CASE WHEN value < 2 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS dark_fraction
FROM {events} GROUP BY 1, 2
"""
SERIES_SQL = """
SELECT user_id AS aoi_id, CAST(ts AS DATE) AS d,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 50000.0 / count(*) AS mean, count(*) AS n
FROM {events} GROUP BY 1, 2
"""
FACTS_SQL = """
SELECT l_suppkey AS request_id, 0 AS ord, 'water_fraction' AS fact_key,
  sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS value_num, 'fraction' AS unit
FROM {lineitem} GROUP BY l_suppkey
UNION ALL SELECT l_suppkey, 1, 'water_area_km2', CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE), 'km2'
FROM {lineitem} GROUP BY l_suppkey
"""
NARRATIONS_SQL = f"""
SELECT f.request_id, concat('Acquired 2025-10-14 at 512x512 pixels. Water covers ',
  CAST(CAST(floor(f.value_num * 10000) / 100 + CASE WHEN f.request_id % 5 = 0 THEN 37 ELSE 0 END AS DECIMAL(10,2)) AS VARCHAR(20)),
  '% of the scene, an area of ', CAST(CAST(a.value_num AS BIGINT) AS VARCHAR(20)), ' km2.') AS text
FROM ({FACTS_SQL}) f JOIN ({FACTS_SQL}) a ON f.request_id = a.request_id AND a.ord = 1 WHERE f.ord = 0
"""
PATCHES_DUCK = """
SELECT vec_id AS patch_id, label, CAST(floor((i-1)/8.0) AS INT) AS r, CAST((i-1)%8 AS INT) AS c,
  least(1.0, greatest(0.0, CAST(embedding[i] AS DOUBLE)+0.5)) AS gray FROM embeddings, range(1,65) t(i)
"""

TABLES = ("lineitem", "orders", "customer", "nation", "events")


def duck(sql: str) -> str:
    """The DuckDB text of a shared view."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


_INGESTED: dict[tuple[str, str], DataFrame] = {}


def derive_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = view(spark, sf_dir, PX_SQL)
    bands = {b: F.col(f"{b}_u8") / F.lit(255.0) for b in ("blue", "green", "red", "nir", "swir2", "sar")}
    return px.select("scene_id", "aoi", "yr", "r", "c", "truth", *[c.alias(b) for b, c in bands.items()])


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels table. Derived from lineitem and written once per session, as an
    ingest would, so that queries scan a columnar table and prune its bands."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INGESTED:
        _INGESTED[key] = materialise(derive_pixels(spark, sf_dir), "pixels")
    return _INGESTED[key]


def scenes(px: DataFrame) -> DataFrame:
    """One row per scene with its grid, box and date."""
    return px.select("scene_id", "aoi", "yr").distinct().select(
        "scene_id", "aoi", "yr", F.lit(64).alias("width"), F.lit(64).alias("height"),
        (F.lit(70.0) + F.col("yr") - 1995).alias("west"), F.lit(20.0).alias("south"),
        (F.lit(71.0) + F.col("yr") - 1995).alias("east"), F.lit(21.0).alias("north"),
        F.make_date("yr", F.lit(7), F.lit(1)).alias("acq_date"))


SCENES_SQL = """
SELECT DISTINCT scene_id, aoi, yr, 64 AS width, 64 AS height, CAST(70.0 + yr - 1995 AS DOUBLE) AS west,
  CAST(20.0 AS DOUBLE) AS south, CAST(71.0 + yr - 1995 AS DOUBLE) AS east, CAST(21.0 AS DOUBLE) AS north,
  make_date(yr, 7, 1) AS acq_date FROM px"""


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("patch_id"), "label", F.posexplode("embedding").alias("pos", "v")).select(
        "patch_id", "label", F.floor(F.col("pos") / 8).cast("int").alias("r"), (F.col("pos") % 8).cast("int").alias("c"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v").cast("double") + 0.5)).alias("gray"))


def with_px(rest: str, *more: str) -> str:
    """DuckDB query over px (pixels), with further CTEs spliced in before ``rest``."""
    ctes = [f"px AS ({duck(PIXELS_SQL)})", *more]
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + rest
