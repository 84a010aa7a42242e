"""Per-pixel and per-scene expressions (P rows of the survey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.functions.numbers import half_even

from skyframe import fixed_values as V
from skyframe.functions import colour, geo, indices, text
from skyframe.sources import scenes as scene_checks

from .fixtures import QUESTIONS_SQL, SCENES_SQL, duck, pixels, scenes, view, with_px
from .registry import query, table
from .sql_parts import INDEX_SQL, NDVI


def _index_query(pid: str, name: str):
    key = f"{pid}_{name.lower()}"

    @query(key, with_px(f"SELECT scene_id, r, c, round({INDEX_SQL[name]}, 6) AS value FROM px"))
    def run(spark, sf_dir, name=name):
        return pixels(spark, sf_dir).select("scene_id", "r", "c", F.round(indices.index_expr(name), 6).alias("value"))


for _pid, _name in (("p2", "NDVI"), ("p3", "NDWI"), ("p4", "MNDWI"), ("p5", "NBR"), ("p6", "NDBI"), ("p7", "BSI"), ("p8", "VARI")):
    _index_query(_pid, _name)


@query("p1_normalised_difference", """
SELECT l_orderkey, l_linenumber, round((l_discount - l_tax) / greatest(l_discount + l_tax, 1e-6), 6) AS value FROM lineitem""")
def p1(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(indices.nd(F.col("l_discount"), F.col("l_tax")), 6).alias("value"))


# part stands in for a scene table whose band list follows from a key
BANDS_SQL = """
SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN ['gray'] WHEN 1 THEN ['vv', 'vh'] WHEN 2 THEN ['red', 'green', 'blue']
  WHEN 3 THEN ['red', 'green', 'blue', 'nir'] WHEN 4 THEN ['blue', 'green', 'red', 'nir', 'swir2']
  ELSE ['blue', 'green', 'red', 'nir', 'swir1', 'swir2'] END AS bands,
  CASE p_partkey % 4 WHEN 0 THEN ['NDVI'] WHEN 1 THEN ['MNDWI', 'VARI'] WHEN 2 THEN ['NBR', 'NDVI', 'NDWI'] ELSE ['BSI'] END AS wanted
FROM part"""
USABLE_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN list_has_all(bands, [{', '.join(repr(b) for b in need)}]) THEN '{k}' END"
    for k, need in V.INDEX_BANDS.items()) + "], lambda x: x IS NOT NULL)"


def band_lists(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    arr = lambda *xs: F.array(*map(F.lit, xs))
    m, w = F.col("p_partkey") % 6, F.col("p_partkey") % 4
    bands = F.when(m == 0, arr(*V.BAND_PRESETS[1])).when(m == 1, arr(*V.BAND_PRESETS[2])).when(
        m == 2, arr(*V.BAND_PRESETS[3])).when(m == 3, arr(*V.BAND_PRESETS[4])).when(
        m == 4, arr(*V.BAND_PRESETS[5])).otherwise(arr(*V.BAND_PRESETS[6]))
    wanted = F.when(w == 0, arr("NDVI")).when(w == 1, arr("MNDWI", "VARI")).when(
        w == 2, arr("NBR", "NDVI", "NDWI")).otherwise(arr("BSI"))
    return p.select("p_partkey", "p_size", bands.alias("bands"), wanted.alias("wanted"))


@query("p9_available_indices", f"""
SELECT p_partkey, array_to_string({USABLE_SQL}, ',') AS usable, len({USABLE_SQL}) AS n FROM ({BANDS_SQL})""".replace(
    f"len({USABLE_SQL}) AS n", f"CAST(len({USABLE_SQL}) AS INT) AS n"))
def p9(spark, sf_dir):
    b = band_lists(spark, sf_dir).withColumn("u", indices.available_indices(F.col("bands")))
    return b.select("p_partkey", F.array_join("u", ",").alias("usable"), F.size("u").alias("n"))


@query("p10_substitute_indices", f"""
SELECT p_partkey, array_to_string(CASE WHEN len(kept) = 0 THEN usable[1:2] ELSE kept END, ',') AS computed,
  array_to_string(missing, ',') AS missing, array_to_string(CASE WHEN len(kept) = 0 THEN missing ELSE [] END, ',') AS substituted_for,
  CASE WHEN len(kept) > 0 THEN 0.95::DOUBLE WHEN len(usable) > 0 THEN 0.70::DOUBLE END AS confidence,
  CASE WHEN len(kept) = 0 AND len(usable) = 0 THEN 'no_data' ELSE 'ok' END AS status
FROM (SELECT *, list_filter(wanted, lambda x: list_contains(usable, x)) AS kept,
        list_filter(wanted, lambda x: NOT list_contains(usable, x)) AS missing
      FROM (SELECT *, {USABLE_SQL} AS usable FROM ({BANDS_SQL})))""")
def p10(spark, sf_dir):
    b = band_lists(spark, sf_dir)
    out = indices.substitute_indices(F.col("wanted"), F.col("bands"))
    return b.select("p_partkey", *[F.array_join(out[k], ",").alias(k) for k in ("computed", "missing", "substituted_for")],
                    out["confidence"].alias("confidence"), out["status"].alias("status"))


SAT = "(greatest(red, green, blue) - least(red, green, blue)) / greatest(red, green, blue, 1e-6)"


@query("p11_brightness_saturation", with_px(f"""
SELECT scene_id, r, c, round((red + green + blue) / 3.0, 6) AS brightness, round({SAT}, 6) AS saturation FROM px"""))
def p11(spark, sf_dir):
    return pixels(spark, sf_dir).select("scene_id", "r", "c", F.round(indices.rgb_mean(), 6).alias("brightness"),
                                        F.round(indices.saturation(), 6).alias("saturation"))


@query("p12_rgb_proxies", with_px(f"""
SELECT scene_id, r, c, round((green - red) / greatest(green + red, 1e-6), 6) AS vari, round(2 * green - red - blue, 6) AS exg,
  round((2 * green - red - blue) / greatest(2 * green + red + blue, 1e-6), 6) AS gli,
  round((green - red) / greatest(green + red, 1e-6), 6) AS ngrdi, round((red - blue) / greatest(red + blue, 1e-6), 6) AS rbdiff,
  round(red / greatest(red + green + blue, 1e-6), 6) AS chroma_r, round(green / greatest(red + green + blue, 1e-6), 6) AS chroma_g,
  round(blue / greatest(red + green + blue, 1e-6), 6) AS chroma_b, round((red + green + blue) / 3.0, 6) AS brightness,
  round({SAT}, 6) AS saturation FROM px"""))
def p12(spark, sf_dir):
    return pixels(spark, sf_dir).select("scene_id", "r", "c", *[F.round(v, 6).alias(k) for k, v in indices.rgb_proxies().items()])


@query("p13_is_cloud_rgb", with_px(f"""
SELECT scene_id, count(*) AS pixels, count(*) FILTER ((red + green + blue) / 3.0 > 0.62 AND {SAT} < 0.28) AS cloudy
FROM px GROUP BY scene_id"""))
def p13(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("scene_id").agg(
        F.count("*").alias("pixels"), F.count_if(indices.is_cloud_rgb()).alias("cloudy"))


@query("p14_pixel_to_lonlat", with_px("""
SELECT scene_id, r, c, round(70.0 + yr - 1995 + (c + 0.5) / 64 * 1.0, 6) AS lon, round(21.0 - (r + 0.5) / 64 * 1.0, 6) AS lat FROM px"""))
def p14(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return px.join(scenes(px).drop("aoi", "yr"), "scene_id").select(
        "scene_id", "r", "c", F.round(geo.pixel_lon(F.col("c")), 6).alias("lon"), F.round(geo.pixel_lat(F.col("r")), 6).alias("lat"))


AREA = "abs((north - south) * 110.574 * (east - west) * 111.320 * cos(radians((south + north) / 2.0)))"


@query("p15_areas_and_gsd", with_px(f"""
SELECT scene_id, round({AREA}, 4) AS area_km2, round({AREA} / (width * height), 8) AS pixel_km2,
  round(sqrt({AREA} / (width * height)) * 1000.0, 4) AS gsd_m FROM sc""", f"sc AS ({SCENES_SQL})"))
def p15(spark, sf_dir):
    sc = scenes(pixels(spark, sf_dir))
    return sc.select("scene_id", F.round(geo.bbox_area_km2(), 4).alias("area_km2"),
                     F.round(geo.pixel_area_km2(), 8).alias("pixel_km2"), F.round(geo.gsd_m(), 4).alias("gsd_m"))


# odd years stand for scenes without a position
UNLOCATED = "CASE WHEN yr % 2 = 1 THEN NULL ELSE {c} END AS {c}"
HALF_SQL = "half AS (SELECT scene_id, yr, width, height, " + ", ".join(
    UNLOCATED.format(c=c) for c in ("west", "south", "east", "north")) + f" FROM ({SCENES_SQL}))"


def half_located(sc):
    return sc.select("scene_id", "yr", "width", "height",
                     *[F.when(F.col("yr") % 2 == 0, F.col(c)).alias(c) for c in ("west", "south", "east", "north")])


@query("p16_area_of", with_px(f"""
SELECT scene_id, pixels, round_even(pixels * ({AREA} / (width * height)), 4) AS area_km2,
  CASE WHEN west IS NULL THEN 'pixels' ELSE 'km2' END AS unit,
  CASE WHEN west IS NULL THEN format('pixel {{:.0f}}, {{:.0f}}', cx, cy)
       ELSE format('{{:.4f}}, {{:.4f}}', west + (cx + 0.5) / 64 * (east - west), north - (cy + 0.5) / 64 * (north - south)) END AS location
FROM half JOIN (SELECT scene_id, count(*) AS pixels, floor(avg(c)) AS cx, floor(avg(r)) AS cy FROM px GROUP BY 1) USING (scene_id)""", HALF_SQL))
def p16(spark, sf_dir):
    px = pixels(spark, sf_dir)
    per = px.groupBy("scene_id").agg(F.count("*").alias("pixels"), F.floor(F.avg("c")).cast("double").alias("cx"),
                                     F.floor(F.avg("r")).cast("double").alias("cy"))
    s = half_located(scenes(px)).join(per, "scene_id")
    return s.select("scene_id", "pixels", geo.area_of(F.col("pixels")).alias("area_km2"), geo.area_unit().alias("unit"),
                    geo.region_location(geo.pixel_lon(F.col("cx")), geo.pixel_lat(F.col("cy")), F.col("cx"), F.col("cy")).alias("location"))


# scenes with few valid cells in some years: only cells whose row is below a yearly limit count as valid
CHECK_SQL = """chk AS (SELECT scene_id, yr % 2 = 0 AS georeferenced, count(*) FILTER (r < (yr - 1994) * 9) / 4096.0 AS valid_fraction,
  CASE WHEN yr % 3 = 0 THEN ['red', 'green', 'blue'] WHEN yr % 3 = 1 THEN ['blue', 'green', 'red', 'nir', 'swir2'] ELSE ['gray'] END AS bands
  FROM px GROUP BY scene_id, yr)"""


def checked_scenes(px):
    arr = lambda *xs: F.array(*map(F.lit, xs))
    y = F.col("yr") % 3
    return px.groupBy("scene_id", "yr").agg((F.count_if(F.col("r") < (F.col("yr") - 1994) * 9) / 4096.0).alias("valid_fraction")).select(
        "scene_id", (F.col("yr") % 2 == 0).alias("georeferenced"), "valid_fraction",
        F.when(y == 0, arr("red", "green", "blue")).when(y == 1, arr("blue", "green", "red", "nir", "swir2")).otherwise(arr("gray")).alias("bands"))


@query("p17_check_scene", with_px("""
SELECT scene_id, len(missing) = 0 AND valid_fraction >= 0.05 AS compatible, array_to_string(missing, ',') AS missing_bands,
  CAST((len(missing) > 0)::INT + (valid_fraction < 0.05)::INT AS INT) AS issues,
  CAST((valid_fraction >= 0.05 AND valid_fraction < 0.6)::INT + (NOT georeferenced)::INT AS INT) AS warnings,
  round_even(valid_fraction, 4) AS valid_fraction
FROM (SELECT *, list_filter(['nir', 'red'], lambda x: NOT list_contains(bands, x)) AS missing FROM chk)""", CHECK_SQL))
def p17(spark, sf_dir):
    out = scene_checks.check_scene(checked_scenes(pixels(spark, sf_dir)), ["nir", "red"])
    return out.select("scene_id", "compatible", F.array_join("missing_bands", ",").alias("missing_bands"),
                      F.size("issues").alias("issues"), F.size("warnings").alias("warnings"), half_even("valid_fraction", 4).alias("valid_fraction"))


@query("p18_capabilities", with_px(f"""
SELECT scene_id, CASE WHEN ms THEN 'multispectral' WHEN rgb THEN 'rgb' ELSE 'single_band' END AS band_basis,
  CASE WHEN georeferenced THEN 'georeferenced' ELSE 'pixel_space' END AS spatial_reference,
  ms OR rgb AS land_cover_segmentation, rgb AS scene_classification, ms OR rgb AS region_grounding,
  array_to_string(list_sort({USABLE_SQL}), ',') AS spectral_indices,
  CAST((CASE WHEN georeferenced THEN 0 ELSE 3 END) + (NOT ms)::INT + (NOT rgb)::INT AS INT) AS unavailable
FROM (SELECT *, list_has_all(bands, ['nir', 'red']) AS ms, list_has_all(bands, ['red', 'green', 'blue']) AS rgb FROM chk)""", CHECK_SQL))
def p18(spark, sf_dir):
    out = scene_checks.capabilities(checked_scenes(pixels(spark, sf_dir)))
    return out.select("scene_id", "band_basis", "spatial_reference", "land_cover_segmentation", "scene_classification",
                      "region_grounding", F.array_join("spectral_indices", ",").alias("spectral_indices"), F.size("unavailable").alias("unavailable"))


@query("p19_domain_check", with_px(f"""
SELECT scene_id, round(gsd, 4) AS gsd_m, coalesce(gsd > 40, false) AS out_of_domain,
  round(CAST(0.9 AS DOUBLE) * CASE WHEN gsd > 40 THEN 0.35 ELSE 1.0 END, 4) AS confidence, coalesce(gsd <= 40, true) AS narrated
FROM (SELECT scene_id, sqrt({AREA} / (width * height)) * 1000.0 / (yr - 1994) / (yr - 1994) AS gsd FROM half)""", HALF_SQL))
def p19(spark, sf_dir):
    s = half_located(scenes(pixels(spark, sf_dir))).withColumn(
        "gsd", geo.gsd_m() / (F.col("yr") - 1994) / (F.col("yr") - 1994)).withColumn("confidence", F.lit(0.9))
    return scene_checks.domain_check(s, "gsd", "confidence").select(
        "scene_id", F.round("gsd", 4).alias("gsd_m"), "out_of_domain", F.round("confidence", 4).alias("confidence"), "narrated")


def _ramp_sql(value: str, lo: float, hi: float, palette: str) -> str:
    t = f"least(1.0, greatest(0.0, ({value} - ({lo})) / {hi - lo}))"
    stops, cols = V.PALETTES[palette], []
    for i, ch in enumerate(("cr", "cg", "cb")):
        cases = " ".join(f"WHEN t < {x1} THEN {c0[i]} + (t - {x0}) * (({c1[i]} - {c0[i]}) / ({x1 - x0})::DOUBLE)"
                         for (x0, c0), (x1, c1) in zip(stops, stops[1:]))
        cols.append(f"CAST(floor(CASE {cases} ELSE {stops[-1][1][i]} END) AS INT) AS {ch}")
    return f"SELECT scene_id, r, c, {', '.join(cols)}, 210 AS ca FROM (SELECT *, CAST({t} AS DOUBLE) AS t FROM px)"


@query("p20_colour_ramp", with_px(_ramp_sql(f"({NDVI})", -1.0, 1.0, "rdylgn")))
def p20_ramp(spark, sf_dir):
    out = colour.ramp_rgba(indices.index_expr("NDVI"), -1.0, 1.0, "rdylgn", F.lit(True))
    return pixels(spark, sf_dir).select("scene_id", "r", "c", *[v.alias(k) for k, v in out.items()])


TRUTH_CLASS = "CASE truth WHEN 'water' THEN 'water' WHEN 'veg' THEN 'dense_vegetation' WHEN 'built' THEN 'built_up' WHEN 'bare' THEN 'bare_soil' ELSE 'cloud_or_snow' END"


def truth_class():
    t = F.col("truth")
    return F.when(t == "water", "water").when(t == "veg", "dense_vegetation").when(t == "built", "built_up").when(
        t == "bare", "bare_soil").otherwise("cloud_or_snow")


@query("p20_colour_classes", with_px(
    "SELECT scene_id, cr, cg, cb, ca, count(*) AS pixels FROM (SELECT scene_id, " + ", ".join(
        "CASE " + TRUTH_CLASS + " " + " ".join(f"WHEN '{k}' THEN {V.CLASS_COLORS[k][i]}" for k in V.CLASSES) + f" ELSE 0 END AS {ch}"
        for i, ch in enumerate(("cr", "cg", "cb"))) + ", 200 AS ca FROM px) GROUP BY ALL"))
def p20_classes(spark, sf_dir):
    out = colour.class_rgba(F.col("class"))
    return pixels(spark, sf_dir).select("scene_id", truth_class().alias("class")).select(
        "scene_id", *[v.alias(k) for k, v in out.items()]).groupBy("scene_id", "cr", "cg", "cb", "ca").agg(F.count("*").alias("pixels"))


def _pick(choices: list[tuple[str, tuple]]) -> str:
    return ", ".join("CASE " + " ".join(f"WHEN {cond} THEN {rgba[i]}" for cond, rgba in choices) + f" ELSE 0 END AS {ch}"
                     for i, ch in enumerate(("cr", "cg", "cb", "ca")))


@query("p21_colour_change_fusion_sar", with_px(
    "SELECT layer, cr, cg, cb, ca, count(*) AS pixels FROM ("
    "SELECT 'change' AS layer, " + _pick([("changed AND d < 0", V.CHANGE_RGBA["loss"]), ("changed AND d >= 0", V.CHANGE_RGBA["gain"])])
    + " FROM t UNION ALL SELECT 'fusion', " + _pick([("o AND s", V.FUSION_RGBA["both"]), ("o AND NOT s", V.FUSION_RGBA["optical_only"]),
                                                     ("s AND NOT o", V.FUSION_RGBA["sar_only"])])
    + " FROM t UNION ALL SELECT 'sar', " + _pick([("b", V.SAR_RGBA["built_up"]), ("s", V.SAR_RGBA["water"])]) + " FROM t) GROUP BY ALL",
    "t AS (SELECT nir > 0.2 AS changed, red - blue AS d, truth = 'water' AS o, sar < 0.1 AS s, truth = 'built' AS b FROM px)"))
def p21(spark, sf_dir):
    px = pixels(spark, sf_dir)
    o, s, b = F.col("truth") == "water", F.col("sar") < 0.1, F.col("truth") == "built"
    layers = {"change": colour.change_rgba(F.col("nir") > 0.2, F.col("red") - F.col("blue")),
              "fusion": colour.fusion_rgba(o, s), "sar": colour.sar_rgba(s, b)}
    one = [F.struct(F.lit(k).alias("layer"), *[v.alias(ch) for ch, v in rgba.items()]) for k, rgba in layers.items()]
    return px.select(F.inline(F.array(*one))).groupBy("layer", "cr", "cg", "cb", "ca").agg(F.count("*").alias("pixels"))


@query("p23_archive_range_filter", """
SELECT o_orderkey, layer_key, requested, CASE WHEN requested < start THEN 'no_data' ELSE 'ok' END AS status
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 2200 AS requested,
        ['modis_terra_truecolor', 'modis_aqua_truecolor', 'viirs_snpp_truecolor', 'opera_rtc_s1'][o_orderkey % 4 + 1] AS layer_key FROM orders)
JOIN (VALUES ('modis_terra_truecolor', DATE '2000-02-24'), ('modis_aqua_truecolor', DATE '2002-07-04'),
  ('viirs_snpp_truecolor', DATE '2015-11-24'), ('opera_rtc_s1', DATE '2023-12-15')) l(layer_key, start) USING (layer_key)""")
def p23(spark, sf_dir):
    keys = F.array(*[F.lit(k) for k in ("modis_terra_truecolor", "modis_aqua_truecolor", "viirs_snpp_truecolor", "opera_rtc_s1")])
    req = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 2200).alias("requested"),
        F.element_at(keys, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("layer_key"))
    return scene_checks.archive_range(req, "layer_key", "requested").select("o_orderkey", "layer_key", "requested", "status")


@query("p24_acceptable_place", """
SELECT page_id, (cls IN ('', 'boundary', 'place', 'natural', 'landuse', 'waterway', 'water', 'administrative', 'region', 'landform'))
  AND NOT regexp_matches(split_part(name, ',', 1), '(?i)\\b(19|20)\\d{2}\\b|\\b(flood|cyclone|earthquake|disaster|memorial|museum|hotel|restaurant|relief camp)s?\\b') AS accepted
FROM (SELECT page_id, ['boundary', 'historic', 'natural', '', 'tourism'][page_id % 5 + 1] AS cls,
  CASE page_id % 3 WHEN 0 THEN concat('Kerala floods ', 2000 + page_id % 20, ', India') WHEN 1 THEN concat(url, ', hotel') ELSE 'Grand Hotel, Pune' END AS name FROM pages)""")
def p24(spark, sf_dir):
    pid = F.col("page_id")
    cls = F.element_at(F.array(*map(F.lit, ("boundary", "historic", "natural", "", "tourism"))), (pid % 5 + 1).cast("int"))
    name = F.when(pid % 3 == 0, F.concat(F.lit("Kerala floods "), (2000 + pid % 20).cast("string"), F.lit(", India"))).when(
        pid % 3 == 1, F.concat("url", F.lit(", hotel"))).otherwise("Grand Hotel, Pune")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.acceptable_place(cls, name, V.PLACE_CLASSES, V.EVENT_NAME).alias("accepted"))


@query("p25_clamp_bbox", """
WITH b AS (SELECT s_suppkey, (s_suppkey * 37 % 360 - 180)::DOUBLE AS w, (s_suppkey * 53 % 180 - 90)::DOUBLE AS s,
  (s_suppkey * 37 % 360 - 180 + (s_suppkey % 8) * 2.55)::DOUBLE AS e, (s_suppkey * 53 % 180 - 90 + (s_suppkey % 5) * 3.55)::DOUBLE AS n FROM supplier),
t AS (SELECT s_suppkey, greatest(CASE WHEN e - w < 0.2 THEN (w + e) / 2 - 0.1 ELSE w END, -180.0) AS w,
  least(CASE WHEN e - w < 0.2 THEN (w + e) / 2 + 0.1 ELSE e END, 180.0) AS e,
  greatest(CASE WHEN n - s < 0.2 THEN (s + n) / 2 - 0.1 ELSE s END, -85.0) AS s,
  least(CASE WHEN n - s < 0.2 THEN (s + n) / 2 + 0.1 ELSE n END, 85.0) AS n FROM b)
SELECT s_suppkey, round(CASE WHEN e - w > 12 THEN (w + e) / 2 - 6 ELSE w END, 6) AS west, round(CASE WHEN n - s > 12 THEN (s + n) / 2 - 6 ELSE s END, 6) AS south,
  round(CASE WHEN e - w > 12 THEN (w + e) / 2 + 6 ELSE e END, 6) AS east, round(CASE WHEN n - s > 12 THEN (s + n) / 2 + 6 ELSE n END, 6) AS north FROM t""")
def p25(spark, sf_dir):
    k = F.col("s_suppkey")
    west, south = (k * 37 % 360 - 180).cast("double"), (k * 53 % 180 - 90).cast("double")
    b = table(spark, sf_dir, "supplier").select(
        "s_suppkey", west.alias("west"), south.alias("south"), (west + (k % 8) * 2.55).alias("east"), (south + (k % 5) * 3.55).alias("north"))
    return b.select("s_suppkey", *[F.round(v, 6).alias(n) for n, v in geo.clamp_bbox().items()])


@query("p27_valid_alpha", with_px("""
SELECT scene_id, count(*) FILTER (n > 10) AS valid_by_alpha, count(*) FILTER (NOT (red = nd AND green = nd AND blue = nd)) AS valid_by_nodata,
  CAST(sum(CASE WHEN n > 10 THEN 255 ELSE 0 END) AS BIGINT) AS alpha_sum
FROM (SELECT *, (r * 7 + c) % 32 AS n, 102 / 255.0 AS nd FROM px) GROUP BY scene_id"""))
def p27(spark, sf_dir):
    px = pixels(spark, sf_dir).withColumn("alpha", (F.col("r") * 7 + F.col("c")) % 32)
    ok = indices.valid_alpha(F.col("alpha"), V.ALPHA_VALID_ABOVE)
    return px.groupBy("scene_id").agg(
        F.count_if(ok).alias("valid_by_alpha"),
        F.count_if(indices.valid_nodata(["red", "green", "blue"], F.lit(102) / F.lit(255.0))).alias("valid_by_nodata"),
        F.sum(colour.validity_alpha(ok)).alias("alpha_sum"))
