"""Composite analyses, answers and streams (C, G3, J15, K3-K8, A12, A22, A23, T rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyframe import fixed_values as V
from skyframe import streaming
from skyframe.functions import geo
from skyframe.operators import facts as fact_ops
from skyframe.operators import pairing, quality
from skyframe.operators.landcover import segment_landcover
from skyframe.session import checkpoint_root, materialise
from skyframe.sources import tiff
from skyframe.plans import answers, change_analysis, landcover_report, regions, spectral, timeseries

from .expression_queries import AREA
from .fixtures import QUESTIONS_SQL, SCENES_SQL, duck, pixels, scenes, with_px
from .pairing_queries import BANDS, CVA_CTES, DELTA_NAMES, PAIR_CTE, co_observed, year_pairs
from .registry import query, table
from .spatial_queries import CELLS, KEY, built_cells
from .sql_parts import INDEX_SQL, component_ctes, grid_ctes, landcover_ctes, morph_ctes, otsu_ctes, region_ctes
from .text_queries import ALL_PLAN, TODAY, TRACE_SQL, places, plans, questions, trace

# ----------------------------------------------------------------- C1, A22, A23
WANTED = "CASE WHEN yr % 2 = 0 THEN ['NDVI', 'NBR'] ELSE ['NDVI'] END"
SPECTRAL = "long AS (" + " UNION ALL ".join(
    f"SELECT scene_id, '{k}' AS metric, {INDEX_SQL[k]} AS v FROM px WHERE {cond}" for k, cond in (
        ("NDVI", "yr % 3 <> 0"), ("NBR", "yr % 2 = 0 AND yr % 3 <> 0"), ("VARI", "yr % 3 = 0"))) + ")"


def mixed_pixels(spark, sf_dir):
    """Every third year has no infrared bands."""
    px = pixels(spark, sf_dir)
    gone = F.col("yr") % 3 == 0
    return px.withColumns({b: F.when(~gone, F.col(b)) for b in ("nir", "swir2")})


def spectral_products(spark, sf_dir):
    return spectral.spectral_index(mixed_pixels(spark, sf_dir), F.when(
        F.col("scene_id") % 2 == 0, F.array(F.lit("NDVI"), F.lit("NBR"))).otherwise(F.array(F.lit("NDVI"))))


INDEX_STATS = """st AS (SELECT scene_id, metric, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_pop(v) AS std, min(v) AS min, max(v) AS max,
  quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90, count(*) AS n FROM long GROUP BY ALL)"""
STAT_NAMES = [name for name, _ in spectral.STATS]


@query("c1_spectral_index", with_px("SELECT scene_id, metric, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in STAT_NAMES) + " FROM st", SPECTRAL, INDEX_STATS))
def c1(spark, sf_dir):
    st = spectral_products(spark, sf_dir)["stats"]
    return st.select("scene_id", "metric", "n", *[F.round(c, 6).alias(c) for c in STAT_NAMES])


@query("a23_to_facts", with_px("""SELECT scene_id, concat(lower(metric), '_', s) AS fact_key, concat(metric, ' ', MAP {'mean': 'mean', 'median': 'median', 'std': 'standard deviation',
    'min': 'minimum', 'max': 'maximum', 'p10': '10th percentile', 'p90': '90th percentile', 'valid_pixels': 'valid pixel count'}[s]) AS label,
  CASE s WHEN 'valid_pixels' THEN 'pixels' END AS unit, round_even(x, 6) AS value_num
FROM (SELECT scene_id, metric, s, x FROM (SELECT * EXCLUDE (n), CAST(n AS DOUBLE) AS valid_pixels FROM st) UNPIVOT (x FOR s IN (mean, median, std, min, max, p10, p90, valid_pixels)))""",
                               SPECTRAL, INDEX_STATS))
def a23(spark, sf_dir):
    return spectral_products(spark, sf_dir)["facts"].select("scene_id", "fact_key", "label", "unit", "value_num")


@query("a22_geometry_facts", with_px(f"""SELECT request_id, fact_key, value_num FROM (
  SELECT aoi AS request_id, unnest(['raster_width', 'raster_height', 'scene_count', 'scene_area_km2', 'pixel_area_km2']) AS fact_key,
    unnest([64.0::DOUBLE, 64, n, round_even(a, 2), round_even(round_even(a / 4096, 8), 6)]) AS value_num FROM (
      SELECT aoi, count(*) AS n, min({AREA}) AS a FROM ({SCENES_SQL}) GROUP BY 1))"""))
def a22(spark, sf_dir):
    s = scenes(pixels(spark, sf_dir)).withColumn("request_id", F.col("aoi"))
    return fact_ops.geometry_facts(s).select("request_id", "fact_key", "value_num")


# ----------------------------------------------------------------------- C4, C5
@query("c4_landcover_report", with_px(f"""SELECT scene_id, class, pixels, round_even(pixels / total * 100, 2) AS percent, round_even(pixels * km2, 4) AS area_km2, 0.82::DOUBLE AS confidence
FROM (SELECT scene_id, class, count(*) AS pixels FROM lc GROUP BY ALL) JOIN (SELECT scene_id, count(*) AS total FROM lc GROUP BY 1) USING (scene_id)
JOIN (SELECT scene_id, {AREA} / 4096 AS km2 FROM ({SCENES_SQL})) USING (scene_id) WHERE pixels / total > 0.0005""", *landcover_ctes()))
def c4(spark, sf_dir):
    px = pixels(spark, sf_dir)
    out = landcover_report.landcover_report(px, scenes(px))["composition"]
    return out.select("scene_id", "class", "pixels", "percent", "area_km2", "confidence")


REGION_OUT = "scene_id, rank, pixels, r0, r1, c0, c1, fill_ratio, area_km2, box_west, box_south, box_east, box_north, lon, lat"
GROUND = [*landcover_ctes(), f"sc AS ({SCENES_SQL})", "bu AS (SELECT scene_id, r, c, 1 AS v FROM lc WHERE class = 'built_up')",
          *grid_ctes("bu", "v", "0", out="bg"), "bmask AS (SELECT scene_id, r, c, valid AS m FROM bg)", *morph_ctes("bmask", "mo"),
          "moc AS (SELECT scene_id, r, c FROM mo WHERE m)", *component_ctes("moc", "cc"),
          "big AS (SELECT scene_id, component FROM cc GROUP BY ALL HAVING sum(c1 - c0 + 1) >= 12)", "kept AS (SELECT cc.* FROM cc JOIN big USING (scene_id, component))",
          *region_ctes("kept", "rg", "sc", min_pixels=40, top=6)]


@query("c5_ground_regions", with_px(f"SELECT {REGION_OUT} FROM rg", *GROUND))
def c5(spark, sf_dir):
    px = pixels(spark, sf_dir)
    labels, _ = segment_landcover(px)
    out = regions.ground_regions(labels.select("scene_id", "r", "c", "class"), scenes(px), "built_up")["regions"]
    return out.select(*REGION_OUT.split(", "))


# ------------------------------------------------------------------ C7, G3, A12
CHG = [*CVA_CTES, "chg AS (SELECT pair_id AS scene_id, r, c, (a_nir - a_red) / greatest(a_nir + a_red, 1e-6) - (b_nir - b_red) / greatest(b_nir + b_red, 1e-6) AS delta "
       "FROM mg JOIN cut USING (pair_id) WHERE magnitude > greatest(threshold, 0.04))", f"sc AS ({SCENES_SQL})", *component_ctes("chg", "cc"),
       *region_ctes("cc", "rg", "sc", min_pixels=10, top=6)]


def pair_scenes(px):
    return scenes(px).withColumnRenamed("scene_id", "pair_id")


def changed_cells(spark, sf_dir):
    from skyframe.functions.indices import index_expr
    from skyframe.operators import change

    both = co_observed(spark, sf_dir)
    out, _ = change.change_vector_analysis(both, BANDS)
    return out.where("changed").select("pair_id", "r", "c", (index_expr("NDVI", "a_") - index_expr("NDVI", "b_")).alias("delta"))


@query("g3_change_regions", with_px(f"SELECT {REGION_OUT.replace('scene_id', 'scene_id AS pair_id')} FROM rg", *CHG))
def g3(spark, sf_dir):
    out = regions.change_regions(changed_cells(spark, sf_dir), pair_scenes(pixels(spark, sf_dir)), ["pair_id"], min_pixels=10)
    return out.select(*REGION_OUT.replace("scene_id", "pair_id").split(", "))


@query("a12_region_direction", with_px("""SELECT rg.scene_id AS pair_id, rank, round(avg(delta), 6) AS mean_delta, CASE WHEN avg(delta) >= 0 THEN 'increase' ELSE 'decrease' END AS direction
FROM rg JOIN chg ON chg.scene_id = rg.scene_id AND chg.r BETWEEN r0 AND r1 AND chg.c BETWEEN c0 AND c1 GROUP BY ALL""", *CHG))
def a12(spark, sf_dir):
    out = regions.change_regions(changed_cells(spark, sf_dir), pair_scenes(pixels(spark, sf_dir)), ["pair_id"], min_pixels=10)
    return out.select("pair_id", "rank", F.round("mean_delta", 6).alias("mean_delta"), "direction")


SIDES_CTE = "both2 AS (" + " UNION ALL ".join(
    f"SELECT concat(pair_id, '{m}') AS scene_id, pair_id, r, c, {', '.join(f'{p}{b} AS {b}' for b in BANDS)} FROM pr" for p, m in (("b_", "b"), ("a_", "a"))) + ")"


def full_change(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return change_analysis.change_analysis(px, year_pairs(px), pair_scenes(px), BANDS)


@query("c7_change_analysis", with_px("""SELECT pair_id, b.class AS from_class, a.class AS to_class, count(*) AS pixels FROM (SELECT pair_id, r, c, class FROM lc WHERE scene_id LIKE '%b') b
JOIN (SELECT pair_id, r, c, class FROM lc WHERE scene_id LIKE '%a') a USING (pair_id, r, c) GROUP BY ALL""", PAIR_CTE, SIDES_CTE, *landcover_ctes("both2")))
def c7(spark, sf_dir):
    return full_change(spark, sf_dir)["transitions"].select("pair_id", "from_class", "to_class", "pixels")


@query("c7_change_summary", with_px("""SELECT pair_id, count(*) AS valid_pixels, count(*) FILTER (magnitude > greatest(threshold, 0.04)) AS changed_pixels, round(count(*) / 4096.0, 6) AS overlap,
  count(*) / 4096.0 < 0.5 AS partial, round(greatest(threshold, 0.04), 6) AS threshold FROM mg JOIN cut USING (pair_id) GROUP BY pair_id, threshold""", *CVA_CTES))
def c7s(spark, sf_dir):
    s = full_change(spark, sf_dir)["summary"]
    return s.select("pair_id", "valid_pixels", "changed_pixels", F.round("overlap", 6).alias("overlap"), "partial", F.round("threshold", 6).alias("threshold"))


# ----------------------------------------------------------------------------- C8
@query("c8_timeseries_analysis", with_px("""SELECT aoi, count(*) AS observations, round(regr_slope(m, x), 6) AS slope_per_step, round(regr_r2(m, x), 6) AS r2, round(arg_max(m, yr) - arg_min(m, yr), 6) AS net_change,
  round(least(0.9, 0.4 + 0.06 * count(*))::DOUBLE, 4) AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY yr) - 1 AS x FROM (SELECT aoi, yr, avg((nir - red) / greatest(nir + red, 1e-6)) AS m FROM px GROUP BY ALL HAVING count(*) / 4096.0 >= 0.25)) GROUP BY aoi"""))
def c8(spark, sf_dir):
    px = pixels(spark, sf_dir).withColumn("d", F.expr("date_sub(DATE '2001-07-01', 365 * (2001 - yr))"))
    areas = px.select("aoi").distinct().select("aoi", F.lit("2001-07-01").cast("date").alias("anchor"), F.lit(64).alias("width"), F.lit(64).alias("height"))
    s = timeseries.timeseries_analysis(px, areas, "NDVI", 8, 365)["summary"]
    return s.select("aoi", "observations", F.round("confidence", 4).alias("confidence"), *[F.round(c, 6).alias(c) for c in ("slope_per_step", "r2", "net_change")])


@query("c8_facts", with_px("""SELECT aoi, fact_key, round(v, 5) AS value_num, CAST(NULL AS VARCHAR) AS value_str FROM (
  SELECT aoi, CAST(count(*) AS DOUBLE) AS ts_observations, avg(m) AS ts_mean, arg_min(m, yr) AS ts_first, arg_max(m, yr) AS ts_last, arg_max(m, yr) - arg_min(m, yr) AS ts_net_change,
    regr_slope(m, x) AS ts_slope_per_step, regr_slope(m, x) AS ts_slope_per_year, regr_r2(m, x) AS ts_r2, max(m) AS ts_max, min(m) AS ts_min FROM sr GROUP BY aoi)
  UNPIVOT (v FOR fact_key IN (ts_observations, ts_mean, ts_first, ts_last, ts_net_change, ts_slope_per_step, ts_slope_per_year, ts_r2, ts_max, ts_min))
UNION ALL SELECT DISTINCT aoi, 'ts_index', NULL, 'NDVI' FROM sr""",
    """sr AS (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY yr) - 1 AS x FROM (
  SELECT aoi, yr, avg((nir - red) / greatest(nir + red, 1e-6)) AS m FROM px GROUP BY ALL HAVING count(*) / 4096.0 >= 0.25))"""))
def c8_facts(spark, sf_dir):
    px = pixels(spark, sf_dir).withColumn("d", F.expr("date_sub(DATE '2001-07-01', 365 * (2001 - yr))"))
    areas = px.select("aoi").distinct().select("aoi", F.lit("2001-07-01").cast("date").alias("anchor"), F.lit(64).alias("width"), F.lit(64).alias("height"))
    facts = timeseries.timeseries_analysis(px, areas, "NDVI", 8, 365)["facts"]
    return facts.select("aoi", "fact_key", F.round("value_num", 5).alias("value_num"), "value_str")


# --------------------------------------------------------------- facts per question
SPEC = [("wf", "water_fraction", "Water share", "fraction"), ("wa", "water_area_km2", "Water area", "km2"), ("bf", "bare_soil_fraction", "Bare soil share", "fraction"),
        ("uf", "built_up_fraction", "Built-up share", "fraction"), ("nm", "ndvi_mean", "NDVI mean", None), ("cf", "change_fraction", "Share of observed area that changed", "fraction"),
        ("wd", "water_delta_area_km2", "Water area change", "km2"), ("bd", "bare_soil_delta_area_km2", "Bare soil area change", "km2"),
        ("gr", "grounded_water_regions", "Water regions found", "regions"), ("gp", "grounded_water_pixels", "Water pixels", "pixels"),
        ("iou", "fusion_iou", "Optical-SAR water agreement (IoU)", None), ("cl", "cloud_or_snow_fraction", "Cloud or snow share", "fraction")]
AGG_SQL = """ag AS (SELECT l_orderkey AS request_id, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS wf, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS wa,
  sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS bf, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) / CAST(2 * count(*) AS DOUBLE) AS uf,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS nm, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS cf,
  CAST(sum(CAST(l_quantity AS BIGINT) - 25) AS DOUBLE) AS wd, CAST(sum(CAST(l_partkey % 50 AS BIGINT) - 25) AS DOUBLE) AS bd, CAST(count(*) AS DOUBLE) AS gr, CAST(sum(l_partkey) AS DOUBLE) AS gp,
  CASE WHEN l_orderkey % 2 = 0 THEN (l_orderkey % 100) / 100.0 END AS iou, (l_orderkey % 30) / 100.0 AS cl FROM {lineitem} GROUP BY l_orderkey)"""
FQ_SQL = AGG_SQL + ", fq AS (" + " UNION ALL ".join(
    f"SELECT request_id, {i} AS ord, '{k}' AS fact_key, '{label}' AS label, round_even(CAST({c} AS DOUBLE), 6) AS value_num, {repr(u) if u else 'NULL'} AS unit FROM ag WHERE {c} IS NOT NULL"
    for i, (c, k, label, u) in enumerate(SPEC)) + ")"
FQ = duck(FQ_SQL)


def question_facts(spark, sf_dir):
    ag = spark.sql("WITH " + AGG_SQL + " SELECT * FROM ag", lineitem=table(spark, sf_dir, "lineitem"))
    f = fact_ops.to_facts(ag, [(c, k, label, u, None) for c, k, label, u in SPEC], "measured")
    return materialise(f.withColumn("value_str", F.lit(None).cast("string")), "facts")


def question_plans(spark, sf_dir):
    """Annotated once and written, as the stages that answer and narrate would find them."""
    return materialise(plans(spark, sf_dir).withColumnRenamed("question_id", "request_id"), "plans")


@query("k4_top_classes", f"""WITH {FQ} SELECT request_id, replace(fact_key, '_fraction', '') AS class, value_num AS value, CAST(row_number() OVER (PARTITION BY request_id ORDER BY value_num DESC,
  list_position(['water_fraction', 'dense_vegetation_fraction', 'sparse_vegetation_fraction', 'built_up_fraction', 'bare_soil_fraction', 'cloud_or_snow_fraction'], fact_key)) AS INT) AS rank
FROM fq WHERE fact_key LIKE '%_fraction' AND fact_key <> 'change_fraction' AND value_num > 0.02""")
def k4(spark, sf_dir):
    return fact_ops.top_classes(question_facts(spark, sf_dir), 0.02, 4)


@query("k3_top_movers", f"""WITH {FQ} SELECT request_id, replace(fact_key, '_delta_area_km2', '') AS class, value_num AS value, CAST(row_number() OVER (PARTITION BY request_id ORDER BY abs(value_num) DESC, fact_key DESC) AS INT) AS rank
FROM fq WHERE fact_key LIKE '%_delta_area_km2' AND abs(value_num) > 0.01""")
def k3(spark, sf_dir):
    return fact_ops.top_movers(question_facts(spark, sf_dir))


@query("k8_pick_scene", """SELECT o_custkey AS request_id, arg_min(role, struct_pack(p := pos, k := o_orderkey)) AS role, min(o_orderkey) FILTER (pos = best) AS scene_id FROM (
  SELECT *, min(pos) OVER (PARTITION BY o_custkey) AS best FROM (SELECT o_custkey, o_orderkey, role, list_position(['primary', 'after', 'optical', 'sar', 'before'], role) AS pos FROM (
    SELECT *, ['before', 'sar', 'optical', 'after', 'primary', 'thumbnail'][o_orderkey % 6 + 1] AS role FROM orders)) WHERE pos IS NOT NULL) GROUP BY 1""")
def k8(spark, sf_dir):
    roles = F.array(*map(F.lit, ("before", "sar", "optical", "after", "primary", "thumbnail")))
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request_id"), F.get(roles, (F.col("o_orderkey") % 6).cast("int")).alias("role"), F.col("o_orderkey").alias("scene_id"))
    one = s.groupBy("request_id", "role").agg(F.min("scene_id").alias("scene_id"))
    return fact_ops.pick_scene(one)


def _keys(mapping: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {list(v)}" for k, v in mapping.items()) + "}"


HINTS = {c: [k + s for k in keys for s in ("", "_before", "_after")] for c, keys in V.CLASS_FACTS.items()}
CHANGED = f"(regexp_matches(text, '{V.DIRECTION}') OR task LIKE 'change%')"
FRONT = f"""list_reverse(list_concat(CASE WHEN {CHANGED} THEN list_concat(['change_fraction', 'change_area_km2'], flatten(list_transform(classes, lambda k: [concat(k, '_delta_area_km2'), concat(k, '_relative_change_pct'),
    concat(k, '_fraction_before'), concat(k, '_fraction_after')]))) ELSE []::VARCHAR[] END,
  CASE WHEN task = 'grounding' THEN flatten(list_transform(CASE WHEN len(classes) > 0 THEN classes ELSE ['water'] END, lambda k: [concat('grounded_', k, '_regions'), concat('grounded_', k, '_area_km2'), concat('grounded_', k, '_pixels')])) ELSE []::VARCHAR[] END,
  CASE WHEN task = 'optical_sar_fusion' THEN ['fusion_water_fraction', 'fusion_iou', 'fusion_cloud_recovered_pixels'] ELSE []::VARCHAR[] END))"""
NAMED = f"list_concat(flatten(list_transform(classes, lambda k: coalesce({_keys(HINTS)}[k], []))), flatten(list_transform(indices, lambda i: [concat(lower(i), '_mean'), concat(lower(i), '_median'), concat(lower(i), '_p90'), concat(lower(i), '_p10'), concat('d', lower(i), '_mean'), concat('d', lower(i), '_before'), concat('d', lower(i), '_after')])))"
ANSWER_CTES = f"""wn AS (SELECT question_id AS request_id, text, {FRONT} AS f, {NAMED} AS n, len(indices) > 0 AS swaps FROM an),
w2 AS (SELECT request_id, unnest(list_concat(list_transform(f, lambda k, i: {{'t': 0, 'p': i, 'k': k}}), list_transform(n, lambda k, i: {{'t': 1, 'p': i, 'k': k}}),
  CASE WHEN swaps THEN list_transform(['vari_mean', 'ndvi_mean', 'mndwi_mean', 'ndwi_mean'], lambda k, i: {{'t': 2, 'p': i, 'k': k}}) ELSE [] END)) AS w FROM wn),
rh0 AS (SELECT w2.request_id, w.t AS t, w.p AS p, fq.* EXCLUDE (request_id) FROM w2 JOIN fq ON fq.request_id = w2.request_id AND fq.fact_key = w.k),
rh1 AS (SELECT *, bool_or(t = 1) OVER (PARTITION BY request_id) AS named, row_number() OVER (PARTITION BY request_id, t ORDER BY p) AS ti FROM rh0),
rh2 AS (SELECT * FROM rh1 WHERE t < 2 OR (NOT named AND ti = 1) QUALIFY row_number() OVER (PARTITION BY request_id, fact_key ORDER BY t, p) = 1),
rh3 AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY t, p) - 1 AS rank FROM rh2),
lw AS (SELECT request_id, rank, fact_key, label, value_num, unit FROM rh3 WHERE rank < 4),
kw AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, fact_key DESC) - 1 AS rank, fact_key, label, value_num, unit FROM (
  SELECT wn.request_id, fq.* EXCLUDE (request_id), len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')), lambda x: contains(lower(concat(label, ' ', fact_key)), x))) AS score
  FROM wn JOIN fq USING (request_id) WHERE request_id NOT IN (SELECT request_id FROM lw)) WHERE score > 0),
picked AS (SELECT * FROM lw UNION ALL SELECT * FROM kw WHERE rank < 4)"""


@query("j15_resolve_answers", f"WITH {ALL_PLAN}, {FQ}, {ANSWER_CTES} SELECT request_id, CAST(rank AS INT) AS rank, fact_key FROM picked")
def j15(spark, sf_dir):
    return answers.resolve_answers(question_plans(spark, sf_dir), question_facts(spark, sf_dir)).select("request_id", F.col("rank").cast("int").alias("rank"), "fact_key")


LINE = """concat(label, ': ', CASE unit WHEN 'fraction' THEN format('{:.2f}%', round_even(value_num * 100, 2)) WHEN 'km2' THEN concat(format('{:,.2f}', value_num), ' km²')
  WHEN 'pixels' THEN concat(format('{:,}', CAST(floor(value_num) AS BIGINT)), ' pixels') WHEN 'regions' THEN concat(format('{:,}', CAST(floor(value_num) AS BIGINT)), ' regions') ELSE format('{:.4f}', round_even(value_num, 4)) END, '.')"""


@query("c12_answer", f"""WITH {ALL_PLAN}, {FQ}, {ANSWER_CTES} SELECT wn.request_id, CASE WHEN a IS NULL THEN 'no_data' ELSE 'ok' END AS status, a AS answer, k AS primary_fact
FROM wn LEFT JOIN (SELECT request_id, string_agg({LINE}, ' ' ORDER BY rank) AS a, arg_min(fact_key, rank) AS k FROM picked GROUP BY 1) USING (request_id)""")
def c12(spark, sf_dir):
    return answers.answer(question_plans(spark, sf_dir), question_facts(spark, sf_dir)).select("request_id", "status", "answer", "primary_fact")


def described_requests(spark, sf_dir):
    p = question_plans(spark, sf_dir)
    i = F.col("request_id")
    return p.withColumns({
        "source": F.concat(F.lit("archive "), (i % 3).cast("string")), "place": F.col("aoi_name"), "acq_date": F.get("dates", F.size("dates") - 1),
        "width": F.lit(64), "height": F.lit(64), "in_domain": F.lit(True), "status": F.when(i % 40 == 0, "no_data").otherwise("ok"),
        "bands": F.array(*map(F.lit, BANDS)), "warnings": F.when(i % 4 == 0, F.array(F.lit("cloud"))).otherwise(F.array().cast("array<string>")),
        "checked": F.lit(3), "verified": F.lit(3), "is_upload": i % 10 == 5})


NAME = {f"{k}_fraction": v.lower() for k, v in V.CLASS_LABELS.items()}
COMP = f"""cp AS (SELECT request_id, list(concat(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in NAME.items())}}}[fact_key], format(' {{:.1f}}%', round_even(value_num * 100, 1))) ORDER BY value_num DESC,
  list_position({list(NAME)}, fact_key)) AS l FROM fq WHERE fact_key IN ({', '.join(f"'{k}'" for k in NAME)}) AND value_num > 0.005 GROUP BY 1)"""


@query("c13_caption", f"""WITH {ALL_PLAN}, {FQ}, {COMP}, nd AS (SELECT request_id, max(value_num) FILTER (fact_key = 'ndvi_mean') AS nm, max(value_num) FILTER (fact_key = 'change_fraction') AS cf,
  max(value_num) FILTER (fact_key = 'cloud_or_snow_fraction') AS cl FROM fq GROUP BY 1)
SELECT request_id, CASE WHEN l IS NOT NULL OR nm IS NOT NULL OR cf IS NOT NULL OR cl > 0.2 THEN concat('archive ', request_id % 3, ' imaged ', coalesce(aoi, 'the requested area'), CASE WHEN len(dates) > 0 THEN concat(' on ', dates[-1]) ELSE '' END, ' at 64×64 pixels.',
  CASE WHEN l IS NOT NULL THEN concat(' The scene is dominated by ', array_to_string(l[1:3], ', '), '.') ELSE '' END, CASE WHEN len(l) > 3 THEN concat(' Also present: ', array_to_string(l[4:], ', '), '.') ELSE '' END,
  format(' Mean NDVI is {{:.3f}} (vegetation vigour).', round_even(nm, 3)), format(' Between the two dates, {{:.2f}}% of the co-observed area changed.', round_even(cf * 100, 2)),
  CASE WHEN cl > 0.2 THEN format(' Note that {{:.1f}}% of the scene is cloud or snow, which limits what could be measured.', round_even(cl * 100, 1)) ELSE '' END) END AS caption
FROM (SELECT question_id AS request_id, aoi, dates FROM an) LEFT JOIN nd USING (request_id) LEFT JOIN cp USING (request_id)""")
def c13(spark, sf_dir):
    return answers.caption(described_requests(spark, sf_dir), question_facts(spark, sf_dir)).select("request_id", "caption")


@query("c14_narrate")
def c14(spark, sf_dir):
    return answers.narrate(described_requests(spark, sf_dir), question_facts(spark, sf_dir))


@query("c16_summarise")
def c16(spark, sf_dir):
    s = answers.summarise(described_requests(spark, sf_dir), question_facts(spark, sf_dir))
    return s.select("request_id", "ord", "kind", "title", F.array_join("points", " | ").alias("points"))


# -------------------------------------------------------------------------- streams
METRICS = f"""{TRACE_SQL}, wn AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, tool, count(*) AS calls, count(*) FILTER (status = 'error') AS errors, round(avg(duration_ms), 4) AS mean_ms,
  max(duration_ms) AS max_ms, list_sort(list(duration_ms))[CAST(ceil(0.95 * count(*)) AS INT)] AS p95_ms FROM tr GROUP BY ALL)"""


@query("t2_stage_metrics", f"WITH {METRICS} SELECT CAST(window_start AS VARCHAR) AS window_start, tool, calls, errors, mean_ms, max_ms, p95_ms FROM wn")
def t2_batch(spark, sf_dir):
    m = streaming.stage_metrics(trace(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    return m.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "tool", "calls", "errors", F.round("mean_ms", 4).alias("mean_ms"), "max_ms", "p95_ms")


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("t2_stage_metrics_stream", f"""WITH {METRICS} SELECT CAST(window_start AS VARCHAR) AS window_start, tool, calls, errors, mean_ms, max_ms, p95_ms FROM wn
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM tr) - INTERVAL 2 HOUR""")
def t2(spark, sf_dir):
    i = F.col("event_id")
    tr = event_stream(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"),
        F.element_at(F.array(*map(F.lit, ("ok", "ok", "no_data", "error", "skipped"))), (i % 5 + 1).cast("int")).alias("status"),
        F.round(F.col("value") * 100).cast("bigint").alias("duration_ms"))
    m = streaming.run_to_table(streaming.stage_metrics_stream(tr), "stage-metrics")
    return m.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "tool", "calls", "errors", F.round("mean_ms", 4).alias("mean_ms"), "max_ms", "p95_ms")


@query("t3_latest_usable_scene", """SELECT aoi, scene_id, round(u, 4) AS usable_fraction FROM (SELECT user_id AS aoi, event_id AS scene_id, least(1.0, value / 60)::DOUBLE AS u, CAST(ts AS DATE) AS d FROM events)
WHERE u >= 0.3 QUALIFY row_number() OVER (PARTITION BY aoi ORDER BY u DESC, d DESC, scene_id DESC) = 1""")
def t3(spark, sf_dir):
    q = event_stream(spark, sf_dir).select(
        F.col("user_id").alias("aoi"), F.col("event_id").alias("scene_id"), F.least(F.lit(1.0), F.col("value") / 60).alias("usable_fraction"),
        F.col("ts").cast("date").alias("acq_date"))
    best = streaming.latest(streaming.run_to_table(streaming.latest_usable_scene(q), "latest-scene", "update"), "aoi")
    return best.select("aoi", "scene_id", F.round("usable_fraction", 4).alias("usable_fraction"))


#: Uploads planted from pages: every seventh is a copy of the one before it, and every third body is no image.
UPLOADS = """up AS (SELECT page_id, CASE WHEN page_id % 7 = 6 THEN page_id - 1 ELSE page_id END AS body FROM pages),
k AS (SELECT DISTINCT body % 4 = 3 AS pdf, CASE WHEN body % 3 = 0 THEN '' ELSE '89504E470D0A1A0A' END || hex(encode('upload of a scene, body number ' || body)) AS h FROM up)"""


@query("t1_ingest_stream", f"""WITH {UPLOADS} SELECT CAST(len(h) / 2 AS BIGINT) AS length, left(sha1(unhex(h)), 16) AS content_key,
  CASE WHEN NOT pdf AND h LIKE '89504E47%' THEN 'accepted' ELSE 'rejected' END AS status,
  CASE WHEN pdf THEN 'unsupported extension' WHEN h NOT LIKE '89504E47%' THEN 'contents are not an image' END AS reason FROM k""")
def t1(spark, sf_dir):
    """Files written from pages and read back as a stream, one row per content."""
    folder = f"{checkpoint_root(spark)}/uploads-{uuid.uuid4().hex}"

    def write(batches):
        system, name = tiff.filesystem(folder)
        system.create_dir(name)
        for batch in batches:
            for file, body in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with system.open_output_stream(f"{name}/{file}") as out:
                    out.write(body)
            yield batch.select(["file"])

    i = F.col("page_id")
    body = F.when(i % 7 == 6, i - 1).otherwise(i)
    content = F.concat(F.when(body % 3 == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.lit("89504E470D0A1A0A"))),
                       F.encode(F.concat(F.lit("upload of a scene, body number "), body.cast("string")), "UTF-8"))
    files = table(spark, sf_dir, "pages").select(F.concat(i.cast("string"), F.when(body % 4 == 3, ".pdf").otherwise(".png")).alias("file"), content.alias("content"))
    files.mapInArrow(write, "file string").write.format("noop").mode("overwrite").save()
    out = streaming.run_to_table(streaming.ingest_stream(spark, folder), "ingest")
    return out.select("length", "content_key", "status", "reason")
