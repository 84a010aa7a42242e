"""Joins, date searches, quality and change (J, U, A5-A8, S6-S8 rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.functions import geo
from skyframe.operators import change, pairing, quality, series

from .expression_queries import AREA, TRUTH_CLASS, checked_scenes, truth_class
from .fixtures import PROBES_SQL, SCENES_SQL, SERIES_SQL, duck, pixels, scenes, view, with_px
from .registry import query, table
from .sql_parts import INDEX_SQL, otsu_ctes

BANDS = ["blue", "green", "red", "nir", "swir2"]
SIDES = ", ".join(f"b.{x} AS b_{x}, a.{x} AS a_{x}" for x in [*BANDS, "truth"])
PAIR_CTE = f"""pr AS (SELECT b.scene_id AS pair_id, b.r, b.c, {SIDES}
  FROM px b JOIN px a ON a.aoi = b.aoi AND a.yr = b.yr + 1 AND a.r = b.r AND a.c = b.c)"""


def year_pairs(px):
    return pairing.consecutive_pairs(scenes(px), "aoi", "yr")


def co_observed(spark, sf_dir, extra=("truth",)):
    px = pixels(spark, sf_dir)
    return pairing.co_observe(px, year_pairs(px), [*BANDS, *extra])


@query("j1_co_observe", with_px("""
SELECT pair_id, count(*) AS pixels, round(sum(a_nir - b_nir), 6) AS nir_gain FROM pr GROUP BY pair_id""", PAIR_CTE))
def j1(spark, sf_dir):
    return co_observed(spark, sf_dir).groupBy("pair_id").agg(
        F.count("*").alias("pixels"), F.round(F.sum(F.col("a_nir") - F.col("b_nir")), 6).alias("nir_gain"))


SAR_GRID = "sarpx AS (SELECT scene_id, r, c, sar AS vv FROM px WHERE (r + c) % 11 <> 0)"


@query("j2_pair_optical_sar", with_px("""
SELECT px.scene_id AS pair_id, count(*) AS pixels, round(avg(vv), 6) AS mean_vv, round(avg(nir), 6) AS mean_nir
FROM px JOIN sarpx USING (scene_id, r, c) GROUP BY 1""", SAR_GRID))
def j2(spark, sf_dir):
    px = pixels(spark, sf_dir)
    sar = px.where((F.col("r") + F.col("c")) % 11 != 0)
    pairs = scenes(px).select(F.col("scene_id").alias("pair_id"), F.col("scene_id").alias("first_id"), F.col("scene_id").alias("second_id"))
    both = pairing.co_observe(px, pairs, ["nir", "sar"], "o_", "s_", other=sar)
    return both.groupBy("pair_id").agg(F.count("*").alias("pixels"), F.round(F.avg("s_sar"), 6).alias("mean_vv"),
                                       F.round(F.avg("o_nir"), 6).alias("mean_nir"))


@query("p22_coverage_gate", with_px("""
SELECT pair_id, round(n / 4096.0, 6) AS co_observed, n / 4096.0 < 0.75 AS partial FROM (SELECT pair_id, count(*) AS n FROM pr GROUP BY 1)
WHERE n / 4096.0 >= 0.5""", PAIR_CTE))
def p22(spark, sf_dir):
    n = co_observed(spark, sf_dir).groupBy("pair_id").agg((F.count("*") / 4096.0).alias("co_observed"))
    return pairing.coverage_gate(n, "co_observed", 0.5, 0.75).withColumn("co_observed", F.round("co_observed", 6))


# ------------------------------------------------------------------ date search
REQ_SQL = "req AS (SELECT o_orderkey AS request_id, o_orderkey % 4 AS area, DATE '2023-12-20' + CAST(o_orderkey % 60 AS INT) AS anchor FROM orders)"
PROBE_SQL = f"pb AS ({duck(PROBES_SQL)})"
# the probes of four areas, told apart by who was there
AREA_SQL = """SELECT user_id % 4 AS area, event_type AS layer_key, CAST(ts AS DATE) AS probe_date, CAST(least(1.0, count(*) / 20.0) AS DOUBLE) AS coverage,
  sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS cloud_fraction,
  sum(CASE WHEN value < 2 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS dark_fraction FROM {events} GROUP BY 1, 2, 3"""
AREA_PROBES = f"pb AS ({duck(AREA_SQL)})"
OBSERVED = """obs AS (SELECT area, layer_key, probe_date, coverage * (1 - cloud_fraction) * (1 - dark_fraction) AS usable, coverage FROM pb
  WHERE dark_fraction < 0.5)"""


def requests(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), (F.col("o_orderkey") % 4).alias("area"), F.expr("date_add(DATE '2023-12-20', CAST(o_orderkey % 60 AS INT))").alias("anchor"))


def probes(spark, sf_dir):
    return view(spark, sf_dir, PROBES_SQL)


def area_probes(spark, sf_dir):
    return view(spark, sf_dir, AREA_SQL)


def _nearest(cte: str, layer: str, span: int, cov: float, src: str = "req") -> str:
    return f"""{cte} AS (SELECT r.area, anchor, probe_date AS selected, usable FROM (SELECT DISTINCT area, anchor FROM {src}) r
      JOIN obs ON r.area = obs.area AND layer_key = '{layer}' AND abs(probe_date - anchor) <= {span} AND coverage >= {cov}
      QUALIFY row_number() OVER (PARTITION BY r.area, anchor ORDER BY usable DESC, abs(probe_date - anchor), probe_date) = 1)"""


@query("j4_nearest_usable_date", f"""
WITH {REQ_SQL}, {AREA_PROBES}, {OBSERVED}, {_nearest('best', 'click', 12, 0.5)}
SELECT request_id, anchor, selected, round(usable, 6) AS usable, CAST(abs(selected - anchor) AS INT) AS gap_days,
  CASE WHEN usable >= 0.3 THEN 'clear' WHEN usable IS NOT NULL THEN 'cloudy' ELSE 'none' END AS status
FROM req LEFT JOIN best USING (area, anchor)""")
def j4(spark, sf_dir):
    req = requests(spark, sf_dir).withColumn("layer_key", F.lit("click"))
    out = pairing.nearest_usable_date(req, area_probes(spark, sf_dir), on=("area", "layer_key"))
    return out.select("request_id", "anchor", "selected", F.round("usable", 6).alias("usable"), "gap_days", "status")


@query("j5_search_optical", f"""
WITH {REQ_SQL}, {AREA_PROBES}, {OBSERVED}, {_nearest('t', 'click', 10, 0.6)}, {_nearest('v', 'view', 10, 0.6)}
SELECT request_id, CASE WHEN swap THEN 'view' WHEN ts IS NOT NULL THEN 'click' END AS layer_key,
  CASE WHEN swap THEN vs ELSE ts END AS selected, round(CASE WHEN swap THEN vu ELSE tu END, 6) AS usable,
  coalesce(CASE WHEN swap THEN vu ELSE tu END < 0.3, false) AS warn_cloud
FROM (SELECT request_id, t.selected AS ts, t.usable AS tu, v.selected AS vs, v.usable AS vu,
        (t.usable IS NULL OR t.usable < 0.3) AND v.usable IS NOT NULL AND v.usable > coalesce(t.usable, 0) AS swap
      FROM req LEFT JOIN t USING (area, anchor) LEFT JOIN v USING (area, anchor))""")
def j5(spark, sf_dir):
    out = pairing.search_optical(requests(spark, sf_dir), area_probes(spark, sf_dir), primary="click", fallback="view", area=("area",))
    return out.select("request_id", "layer_key", "selected", F.round("usable", 6).alias("usable"), "warn_cloud")


SAR_CTES = """sp AS (SELECT area, probe_date, coverage FROM pb WHERE layer_key = 'purchase' AND coverage >= 0.5),
a AS (SELECT DISTINCT area, anchor FROM req),
p1 AS (SELECT area, anchor, probe_date AS selected, coverage, 1 AS phase FROM a JOIN sp USING (area)
  WHERE (abs(probe_date - anchor) <= 48 AND abs(probe_date - anchor) % 12 = 0) OR abs(probe_date - anchor) IN (6, 18)),
p2 AS (SELECT area, anchor, probe_date, coverage, 2 FROM a JOIN sp USING (area) WHERE abs(probe_date - anchor) <= 150 AND abs(probe_date - anchor) % 3 = 0
  AND (area, anchor) NOT IN (SELECT (area, anchor) FROM p1)),
hit AS (SELECT * FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2)
  QUALIFY row_number() OVER (PARTITION BY area, anchor ORDER BY coverage DESC, abs(selected - anchor), selected) = 1)"""


def sar_probes(spark, sf_dir):
    return area_probes(spark, sf_dir).where("layer_key = 'purchase'")


@query("j6_search_sar", f"""
WITH {REQ_SQL}, {AREA_PROBES}, {SAR_CTES}
SELECT request_id, selected, round(coverage, 6) AS coverage, CAST(abs(selected - anchor) AS INT) AS gap_days, phase,
  coalesce(abs(selected - anchor) > 20, false) AS warn_gap FROM req LEFT JOIN hit USING (area, anchor)""")
def j6(spark, sf_dir):
    out = pairing.search_sar(requests(spark, sf_dir), sar_probes(spark, sf_dir), area=("area",))
    return out.select("request_id", "selected", F.round("coverage", 6).alias("coverage"), "gap_days", "phase", "warn_gap")


@query("j7_pair_nearest_optical", f"""
WITH {REQ_SQL}, {AREA_PROBES}, {OBSERVED}, {SAR_CTES}, sr AS (SELECT request_id, area, selected AS anchor FROM req JOIN hit USING (area, anchor)),
{_nearest('t', 'click', 4, 0.6, 'sr')}, {_nearest('v', 'view', 4, 0.6, 'sr')}
SELECT request_id, anchor AS sar_date, CASE WHEN swap THEN vs ELSE ts END AS selected,
  CAST(abs(CASE WHEN swap THEN vs ELSE ts END - anchor) AS INT) AS pair_gap_days
FROM (SELECT request_id, anchor, t.selected AS ts, v.selected AS vs,
        (t.usable IS NULL OR t.usable < 0.3) AND v.usable IS NOT NULL AND v.usable > coalesce(t.usable, 0) AS swap
      FROM sr LEFT JOIN t USING (area, anchor) LEFT JOIN v USING (area, anchor))""")
def j7(spark, sf_dir):
    sar = pairing.search_sar(requests(spark, sf_dir), sar_probes(spark, sf_dir), area=("area",)).where("selected IS NOT NULL").select(
        "request_id", "area", F.col("selected").alias("sar_date"))
    pb = area_probes(spark, sf_dir).replace({"click": "modis_terra_truecolor", "view": "viirs_snpp_truecolor"}, subset=["layer_key"])
    return pairing.pair_nearest_optical(sar, pb, area=("area",)).select("request_id", "sar_date", "selected", "pair_gap_days")


@query("u1_union_of_probe_logs", f"""
WITH {PROBE_SQL} SELECT layer_key, probe_date, round(coverage, 6) AS coverage, count(*) AS probes FROM
 (SELECT * FROM pb WHERE layer_key = 'click' UNION ALL SELECT * FROM pb WHERE layer_key IN ('click', 'view') AND day(probe_date) <= 10) GROUP BY ALL""")
def u1(spark, sf_dir):
    pb = probes(spark, sf_dir)
    log = pairing.probe_log(pb.where("layer_key = 'click'"), pb.where("layer_key IN ('click', 'view') AND day(probe_date) <= 10"))
    return log.groupBy("layer_key", "probe_date", F.round("coverage", 6).alias("coverage")).agg(F.count("*").alias("probes"))


@query("k6_date_candidates", f"""
WITH {REQ_SQL}, k AS (SELECT unnest(range(-5, 6)) AS k)
SELECT request_id, anchor + CAST(k AS INT) AS candidate, CAST(CASE WHEN k <= 0 THEN greatest(-2 * k - 1, 0) ELSE 2 * k END AS INT) AS rank
FROM req CROSS JOIN k WHERE anchor + CAST(k AS INT) <= DATE '2024-02-01'""")
def k6(spark, sf_dir):
    out = pairing.nearest_first_dates(requests(spark, sf_dir), "anchor", 5, today=F.lit("2024-02-01").cast("date"))
    return out.select("request_id", "candidate", "rank")


# ---------------------------------------------------------------- compatibility
FULL_SCENES = f"""fs AS (SELECT s.*, chk.bands, CASE WHEN yr % 2 = 0 THEN 'multispectral' WHEN yr % 3 = 0 THEN 'sar' ELSE 'optical' END AS modality,
  CASE WHEN yr % 4 = 3 THEN NULL ELSE 70.0::DOUBLE + (yr % 3) * 0.00004 END AS x FROM ({SCENES_SQL}) s JOIN chk USING (scene_id)),
pp AS (SELECT b.scene_id AS pair_id, b.width AS bw, a.width AS aw, b.x AS bx, a.x AS ax, b.bands AS bb, a.bands AS ab, b.modality AS bm, a.modality AS am
  FROM fs b JOIN fs a ON a.aoi = b.aoi AND a.yr = b.yr + 1)"""
from .expression_queries import CHECK_SQL  # noqa: E402


def full_scenes(px):
    bands = checked_scenes(px).select("scene_id", "bands")
    x = F.when(F.col("yr") % 4 != 3, F.lit(70.0) + (F.col("yr") % 3) * 0.00004)
    return scenes(px).join(bands, "scene_id").select(
        "scene_id", "aoi", "yr", "width", "height", x.alias("west"), x.alias("south"), x.alias("east"), x.alias("north"), "acq_date", "bands",
        F.when(F.col("yr") % 2 == 0, "multispectral").when(F.col("yr") % 3 == 0, "sar").otherwise("optical").alias("modality"))


@query("j8_pair_compatibility", with_px("""
SELECT pair_id, CASE WHEN bm <> am AND ((bm = 'sar' AND am IN ('optical', 'multispectral')) OR (am = 'sar' AND bm IN ('optical', 'multispectral')))
    THEN 'cross_modal_pair' ELSE 'bitemporal_pair' END AS configuration,
  round_even(abs(bx - ax), 8) AS max_corner_offset_deg, array_to_string(list_sort(list_intersect(bb, ab)), ',') AS shared_bands,
  coalesce(abs(bx - ax) < 1e-4, bx IS NULL AND ax IS NULL) AS co_registered,
  len(list_intersect(bb, ab)) > 0 AND coalesce(abs(bx - ax) < 1e-4, true) AS compatible FROM pp""", CHECK_SQL, FULL_SCENES))
def j8(spark, sf_dir):
    s = full_scenes(pixels(spark, sf_dir))
    pairs = pairing.consecutive_pairs(s, "aoi", "yr")
    out = pairing.pair_compatibility(pairing.scene_pairs(pairs, s))
    return out.select("pair_id", "configuration", "max_corner_offset_deg", F.array_join("shared_bands", ",").alias("shared_bands"),
                      "co_registered", "compatible")


@query("j9_check_coregistration", with_px("""
SELECT pair_id, bw = aw AS same_shape, round_even(coalesce(abs(bx - ax), 0.0), 9) AS max_corner_offset_deg,
  bw = aw AND coalesce(abs(bx - ax), 0) <= 1e-6 AS co_registered FROM pp""", CHECK_SQL, FULL_SCENES))
def j9(spark, sf_dir):
    s = full_scenes(pixels(spark, sf_dir))
    out = pairing.check_coregistration(pairing.scene_pairs(pairing.consecutive_pairs(s, "aoi", "yr"), s))
    return out.select("pair_id", "same_shape", "max_corner_offset_deg", "co_registered")


@query("u3_shared_and_missing_bands", with_px("""
SELECT pair_id, array_to_string(list_sort(list_intersect(bb, ab)), ',') AS shared,
  array_to_string(list_sort(list_filter(bb, lambda x: NOT list_contains(ab, x))), ',') AS only_first FROM pp""", CHECK_SQL, FULL_SCENES))
def u3(spark, sf_dir):
    s = full_scenes(pixels(spark, sf_dir))
    out = pairing.scene_pairs(pairing.consecutive_pairs(s, "aoi", "yr"), s)
    return out.select("pair_id", F.array_join(F.array_sort(F.array_intersect("first_bands", "second_bands")), ",").alias("shared"),
                      F.array_join(F.array_sort(F.array_except("first_bands", "second_bands")), ",").alias("only_first"))


# ------------------------------------------------------------------------ quality
SAT = "(greatest(red, green, blue) - least(red, green, blue)) / greatest(red, green, blue, 1e-6)"
QUALITY = f"""q AS (SELECT scene_id, count(*) / 4096.0::DOUBLE AS cov, avg(CASE WHEN (red + green + blue) / 3.0 > 0.62 AND {SAT} < 0.28 THEN 1.0 ELSE 0.0 END) AS cloud,
  avg(CASE WHEN (red + green + blue) / 3.0 < 0.02 THEN 1.0 ELSE 0.0 END) AS dark, avg((red + green + blue) / 3.0) AS mean FROM px GROUP BY 1)"""


@query("a8_scene_quality", with_px("""
SELECT scene_id, round_even(cov, 4) AS coverage, round_even(cloud, 4) AS cloud_fraction, round_even(dark, 4) AS dark_fraction,
  round_even(mean, 4) AS mean_brightness, round_even(cov * (1 - cloud), 4) AS clear_fraction,
  round_even(cov * (1 - cloud) * (1 - dark), 4) AS usable_fraction FROM q""", QUALITY))
def a8(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return quality.scene_quality(px, scenes(px))


DIM = "CASE WHEN yr % 3 = 0 THEN 0.05 ELSE 1.0 END"


@query("s8_reject_empty_scenes", with_px(f"""
SELECT scene_id, count(*) AS pixels FROM px WHERE scene_id IN (SELECT scene_id FROM (
  SELECT scene_id, count(*) / 4096.0 AS cov, avg(b) AS mean, avg(CASE WHEN b < 0.02 THEN 1.0 ELSE 0.0 END) AS dark
  FROM (SELECT scene_id, (red + green + blue) / 3.0 * {DIM} AS b FROM px) GROUP BY 1)
  WHERE cov >= 0.02 AND NOT (mean < 0.035 OR dark > 0.97)) GROUP BY 1"""))
def s8(spark, sf_dir):
    px = pixels(spark, sf_dir)
    dim = F.when(F.col("yr") % 3 == 0, 0.05).otherwise(1.0)
    dimmed = px.withColumns({b: F.col(b) * dim for b in ("red", "green", "blue")})
    return quality.reject_empty_scenes(dimmed, scenes(px)).groupBy("scene_id").agg(F.count("*").alias("pixels"))


@query("s7_build_cube", with_px("""
SELECT aoi, yr, CASE WHEN yr % 2 = 0 THEN 'Terra' ELSE 'Aqua' END AS sensor, count(*) AS pixels, round(avg(red), 6) AS red, round(avg(nir), 6) AS nir
FROM px WHERE (r + c) % 7 <> 0 AND (r * c) % 5 <> 0 GROUP BY ALL"""))
def s7(spark, sf_dir):
    # Terra serves true colour every year but infrared only in even years; Aqua serves both
    px = pixels(spark, sf_dir).withColumn("acq_date", F.col("yr"))
    sensors = F.array(*[F.struct(F.lit(n).alias("sensor"), F.lit(i).alias("pref")) for i, n in enumerate(("Terra", "Aqua"))])
    both = px.select("*", F.inline(sensors))
    tc = both.where((F.col("r") + F.col("c")) % 7 != 0).select("aoi", "acq_date", "sensor", "pref", "r", "c", "blue", "green", "red")
    ir = both.where(((F.col("r") * F.col("c")) % 5 != 0) & ((F.col("sensor") == "Aqua") | (F.col("yr") % 2 == 0))).select(
        "aoi", "acq_date", "sensor", "pref", "r", "c", "swir2", "nir", (F.col("red") / 2).alias("red"))
    return quality.build_cube(tc, ir).groupBy("aoi", F.col("acq_date").alias("yr"), "sensor").agg(
        F.count("*").alias("pixels"), F.round(F.avg("red"), 6).alias("red"), F.round(F.avg("nir"), 6).alias("nir"))


# ------------------------------------------------------------------------- change
MAG_CTE = ("mg AS (SELECT *, sqrt(" + " + ".join(f"(a_{b} - b_{b}) * (a_{b} - b_{b})" for b in sorted(BANDS)) + ") AS magnitude FROM pr)")
CVA_CTES = [PAIR_CTE, MAG_CTE, *otsu_ctes("cut", "mg", "pair_id", "magnitude")]


@query("c6_change_vector_analysis", with_px("""
SELECT pair_id, round(greatest(threshold, 0.04), 6) AS threshold, count(*) AS co_observed,
  count(*) FILTER (magnitude > greatest(threshold, 0.04)) AS changed FROM mg JOIN cut USING (pair_id) GROUP BY ALL""", *CVA_CTES))
def c6(spark, sf_dir):
    out, cut = change.change_vector_analysis(co_observed(spark, sf_dir), BANDS)
    n = out.groupBy("pair_id").agg(F.count_if("changed").alias("changed"))
    return cut.join(n, "pair_id").select("pair_id", F.round("threshold", 6).alias("threshold"), "co_observed", "changed")


def truth_pair(spark, sf_dir):
    px = pixels(spark, sf_dir).select("scene_id", "aoi", "yr", "r", "c", truth_class().alias("class"))
    return pairing.co_observe(px, year_pairs(px), ["class"])


def pixel_km2(px):
    return scenes(px).select(F.col("scene_id").alias("pair_id"), geo.pixel_area_km2().alias("pixel_km2"))


TC = f"""tp AS (SELECT pair_id, {TRUTH_CLASS.replace('truth', 'b_truth', 1)} AS f, {TRUTH_CLASS.replace('truth', 'a_truth', 1)} AS t FROM pr),
tc AS (SELECT pair_id, f, t, count(*) AS pixels FROM tp GROUP BY ALL), km AS (SELECT scene_id AS pair_id, {AREA} / 4096 AS km2 FROM ({SCENES_SQL})),
cls AS (SELECT unnest(['water','dense_vegetation','sparse_vegetation','built_up','bare_soil','cloud_or_snow']) AS k, unnest(range(6)) AS i)"""


@query("a5_transition_matrix", with_px("""
SELECT pair_id, f AS from_class, t AS to_class, pixels, f <> t AS is_change, CAST(rank AS INT) AS rank, round_even(pixels * km2, 4) AS area_km2,
  round_even(pixels / total, 6) AS fraction_of_scene
FROM (SELECT tc.*, sum(pixels) OVER (PARTITION BY pair_id) AS total,
        row_number() OVER (PARTITION BY pair_id, f <> t ORDER BY pixels DESC, c1.i, c2.i) AS rank
      FROM tc JOIN cls c1 ON c1.k = f JOIN cls c2 ON c2.k = t) JOIN km USING (pair_id)
WHERE rank <= CASE WHEN f <> t THEN 8 ELSE 6 END""", PAIR_CTE, TC))
def a5(spark, sf_dir):
    counts = change.transition_counts(truth_pair(spark, sf_dir))
    return change.transition_matrix(counts, pixel_km2(pixels(spark, sf_dir)))


@query("k2_top_transitions", with_px("""
SELECT pair_id, f AS from_class, t AS to_class, pixels, CAST(rank AS INT) AS rank FROM (
  SELECT tc.*, row_number() OVER (PARTITION BY pair_id ORDER BY pixels DESC, c1.i, c2.i) AS rank
  FROM tc JOIN cls c1 ON c1.k = f JOIN cls c2 ON c2.k = t WHERE f <> t) WHERE rank <= 2""", PAIR_CTE, TC))
def k2(spark, sf_dir):
    counts = change.transition_counts(truth_pair(spark, sf_dir))
    m = change.transition_matrix(counts, pixel_km2(pixels(spark, sf_dir)), top_changed=2)
    return m.where("is_change").select("pair_id", "from_class", "to_class", "pixels", "rank")


@query("a6_class_deltas", with_px("""
SELECT pair_id, class, nb AS pixels_before, na AS pixels_after, na - nb AS delta_pixels, round_even(nb * km2, 4) AS area_before_km2,
  round_even(na * km2, 4) AS area_after_km2, round_even((na - nb) * km2, 4) AS delta_area_km2, round_even(nb / total, 6) AS fraction_before,
  round_even(na / total, 6) AS fraction_after, CASE WHEN nb > 0 THEN round_even((na - nb) / nb * 100.0, 2) END AS relative_change_pct
FROM (SELECT pair_id, class, CAST(sum(b) AS BIGINT) AS nb, CAST(sum(a) AS BIGINT) AS na FROM (
        SELECT pair_id, f AS class, pixels AS b, 0 AS a FROM tc UNION ALL SELECT pair_id, t, 0, pixels FROM tc) GROUP BY ALL)
JOIN (SELECT pair_id, CAST(sum(pixels) AS BIGINT) AS total FROM tc GROUP BY 1) USING (pair_id) JOIN km USING (pair_id)""", PAIR_CTE, TC))
def a6(spark, sf_dir):
    counts = change.transition_counts(truth_pair(spark, sf_dir))
    return change.class_deltas(counts, pixel_km2(pixels(spark, sf_dir)))


def _sided(sql: str, p: str) -> str:
    for b in BANDS:
        sql = __import__("re").sub(rf"\b{b}\b", p + b, sql)
    return sql


DELTA_NAMES = ["NDVI", "MNDWI", "NBR", "NDBI"]
DELTA_CTE = "dl AS (" + " UNION ALL ".join(
    f"SELECT pair_id, '{k}' AS metric, {_sided(INDEX_SQL[k], 'b_')} AS before, {_sided(INDEX_SQL[k], 'a_')} AS after FROM pr" for k in DELTA_NAMES
) + "), dv AS (SELECT *, after - before AS v FROM dl)"


@query("a7_delta_stats", with_px("""
SELECT pair_id, metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90,
  round(avg((v > 0.05)::INT), 6) AS fraction_increased, round(avg((v < -0.05)::INT), 6) AS fraction_decreased,
  round(avg(before), 6) AS before_mean, round(avg(after), 6) AS after_mean, count(*) AS n FROM dv GROUP BY ALL""", PAIR_CTE, DELTA_CTE))
def a7(spark, sf_dir):
    d = change.index_deltas(co_observed(spark, sf_dir), DELTA_NAMES)
    return change.delta_stats(d).select("pair_id", "metric", "n", *[F.round(c, 6).alias(c) for c in (
        "mean", "std", "median", "p10", "p90", "fraction_increased", "fraction_decreased", "before_mean", "after_mean")])


@query("a7_delta_histogram", with_px("""
SELECT k.pair_id, k.metric, CAST(b.bin AS INT) AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT pair_id, metric FROM dv) k CROSS JOIN range(0, 40) b(bin)
LEFT JOIN (SELECT pair_id, metric, least(floor((v + 1.0) / 2.0 * 40), 39) AS bin, count(*) AS n FROM dv WHERE v BETWEEN -1 AND 1 GROUP BY ALL) h
  ON h.pair_id = k.pair_id AND h.metric = k.metric AND h.bin = b.bin""", PAIR_CTE, DELTA_CTE))
def a7h(spark, sf_dir):
    return change.delta_histogram(change.index_deltas(co_observed(spark, sf_dir), DELTA_NAMES))


# ------------------------------------------------------------------------- series
SPINE_SQL = """obs AS (SELECT *, least(1.0, n / 4.0) AS coverage FROM ({series})), sp AS (SELECT aoi_id, DATE '2024-01-29' - CAST(k * 2 AS INT) AS d
  FROM (SELECT DISTINCT aoi_id FROM obs) CROSS JOIN range(0, 12) t(k)),
ts AS (SELECT sp.aoi_id, sp.d, obs.mean, coverage, CASE WHEN coverage IS NULL THEN 'no_data' WHEN coverage < 0.5 THEN 'low_coverage' ELSE 'ok' END AS status
  FROM sp LEFT JOIN obs USING (aoi_id, d)), ok AS (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY d) - 1 AS x FROM ts WHERE status = 'ok')
""".format(series=duck(SERIES_SQL))


def daily_series(spark, sf_dir):
    obs = view(spark, sf_dir, SERIES_SQL).withColumn("coverage", F.least(F.lit(1.0), F.col("n") / 4.0))
    areas = obs.select("aoi_id").distinct().withColumn("anchor", F.lit("2024-01-29").cast("date"))
    return series.time_series(series.date_spine(areas, "anchor", 12, 2).drop("anchor"), obs, "aoi_id", 0.5)


@query("a13_time_series", f"WITH {SPINE_SQL} SELECT aoi_id, d, status, round(mean, 6) AS mean, round(coverage, 4) AS coverage FROM ts")
def a13(spark, sf_dir):
    return daily_series(spark, sf_dir).select("aoi_id", "d", "status", F.round("mean", 6).alias("mean"), F.round("coverage", 4).alias("coverage"))


@query("f15_date_spine", f"WITH {SPINE_SQL} SELECT aoi_id, d FROM sp")
def f15(spark, sf_dir):
    return daily_series(spark, sf_dir).select("aoi_id", "d")


@query("f15_sar_repeat_dates", f"""WITH {REQ_SQL} SELECT request_id, anchor + CAST(k * 12 AS INT) AS d FROM req CROSS JOIN range(-6, 7) t(k)
WHERE anchor + CAST(k * 12 AS INT) <= DATE '2024-03-01'""")
def f15s(spark, sf_dir):
    return series.sar_repeat_dates(requests(spark, sf_dir), "anchor", today=F.lit("2024-03-01").cast("date")).select("request_id", "d")


@query("a14_ols_trend", f"""WITH {SPINE_SQL} SELECT aoi_id, n, round(slope, 6) AS slope_per_step, round(icpt, 6) AS intercept,
  round(slope * (365.0::DOUBLE / 2), 4) AS slope_per_year, round(CASE WHEN vp * n > 1e-12 THEN r2 ELSE 0 END, 6) AS r2
FROM (SELECT aoi_id, count(*) AS n, regr_slope(mean, x) AS slope, regr_intercept(mean, x) AS icpt, regr_r2(mean, x) AS r2, var_pop(mean) AS vp
  FROM ok GROUP BY 1) WHERE n >= 3""")
def a14(spark, sf_dir):
    t = series.ols_trend(daily_series(spark, sf_dir), "aoi_id", 2)
    return t.select("aoi_id", "n", F.round("slope_per_step", 6).alias("slope_per_step"), F.round("intercept", 6).alias("intercept"),
                    F.round("slope_per_year", 4).alias("slope_per_year"), F.round("r2", 6).alias("r2"))


@query("a15_series_summary", f"""WITH {SPINE_SQL} SELECT aoi_id, count(*) AS observations, round(avg(mean), 9) AS mean, round(arg_min(mean, d), 6) AS first,
  round(arg_max(mean, d), 6) AS last, round(arg_max(mean, d) - arg_min(mean, d), 6) AS net_change, round(max(mean), 6) AS max, round(min(mean), 6) AS min,
  min(d) FILTER (mean = mx) AS max_date, min(d) FILTER (mean = mn) AS min_date, round(least(0.9, 0.4 + 0.06 * count(*))::DOUBLE, 4) AS confidence
FROM (SELECT *, max(mean) OVER (PARTITION BY aoi_id) AS mx, min(mean) OVER (PARTITION BY aoi_id) AS mn FROM ok) GROUP BY aoi_id""")
def a15(spark, sf_dir):
    s = series.series_summary(daily_series(spark, sf_dir), "aoi_id")
    return s.select("aoi_id", "observations", "max_date", "min_date", F.round("confidence", 4).alias("confidence"),
                    F.round("mean", 9).alias("mean"), *[F.round(c, 6).alias(c) for c in ("first", "last", "net_change", "max", "min")])


@query("u5_missing_dates", f"WITH {SPINE_SQL} SELECT aoi_id, d, status FROM ts WHERE status <> 'ok'")
def u5(spark, sf_dir):
    return series.missing_dates(daily_series(spark, sf_dir), "aoi_id")


@query("w11_usable_date_index", f"WITH {SPINE_SQL} SELECT aoi_id, d, CAST(x AS INT) AS x FROM ok")
def w11(spark, sf_dir):
    return series.usable_position(daily_series(spark, sf_dir), "aoi_id").select("aoi_id", "d", "x")
