"""Neighbourhoods, components, regions, radar and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.plans import tool_facts
from skyframe.functions import geo
from skyframe.operators import components, focal, radar
from skyframe.operators.landcover import segment_landcover
from skyframe.operators.stats import histogram

from .expression_queries import AREA, HALF_SQL, half_located
from .fixtures import SCENES_SQL, patches, pixels, scenes, with_px, PATCHES_DUCK
from .registry import query
from .sql_parts import box_ctes, component_ctes, grid_ctes, landcover_ctes, morph_ctes, otsu_ctes, region_ctes

KEY = ["scene_id"]
GRID = grid_ctes("px", "sar")


def radar_grid(spark, sf_dir):
    """Dense radar grids; cells never observed read 0 and are not valid."""
    px = pixels(spark, sf_dir)
    sc = scenes(px).select("scene_id", "width", "height")
    cells = px.select("scene_id", "r", "c", F.col("sar").alias("gray"), F.lit(True).alias("valid"))
    return focal.densify(cells, sc, {"gray": 0.0, "valid": False})


def radar_cells(spark, sf_dir):
    """Observed radar cells with the grid size; the filters read the others as 0."""
    px = pixels(spark, sf_dir)
    return px.select("scene_id", "r", "c", F.col("sar").alias("gray"), F.lit(True).alias("valid"), F.lit(64).alias("width"), F.lit(64).alias("height"))


@query("w3_box_mean", with_px("SELECT scene_id, r, c, round(s / 25, 6) AS mean FROM b5", *GRID, *box_ctes("b5", "grid", "gray", 5, "symmetric")))
def w3(spark, sf_dir):
    out = focal.box_mean(radar_grid(spark, sf_dir), "gray", 5, "mean")
    return out.select("scene_id", "r", "c", F.round("mean", 6).alias("mean"))


LEE = [*GRID, *box_ctes("b5", "grid", "gray", 5, "symmetric"),
       "va AS (SELECT scene_id, var_pop(gray) AS v FROM grid GROUP BY 1)",
       """lee AS (SELECT scene_id, r, c, valid, round(s / 25 + lv / greatest(lv + v, 1e-6) * (gray - s / 25), 9) AS filtered FROM (
         SELECT *, greatest(q / 25 - (s / 25) * (s / 25), 0) AS lv FROM b5 JOIN grid USING (scene_id, r, c)) JOIN va USING (scene_id))"""]


@query("w4_lee_filter", with_px("SELECT scene_id, r, c, filtered FROM lee", *LEE))
def w4(spark, sf_dir):
    out = focal.lee_filter(radar_grid(spark, sf_dir), "gray")
    return out.select("scene_id", "r", "c", F.round("filtered", 9).alias("filtered"))


TEX = [*LEE, *box_ctes("b7", "lee", "filtered", 7, "symmetric"),
       """tex AS (SELECT scene_id, r, c, valid, filtered, round(sqrt(greatest(q / 49 - (s / 49) * (s / 49), 0)) / greatest(s / 49, 1e-6), 9) AS texture
         FROM b7 JOIN lee USING (scene_id, r, c))"""]


@query("w5_local_texture", with_px("SELECT scene_id, r, c, texture FROM tex", *TEX))
def w5(spark, sf_dir):
    out = radar.backscatter_layers(radar_grid(spark, sf_dir))
    return out.select("scene_id", "r", "c", "texture")


PATCH = f"pt AS ({PATCHES_DUCK})"


def patch_grid(spark, sf_dir):
    return patches(spark, sf_dir).withColumns({"width": F.lit(8), "height": F.lit(8)})


@query("w6_local_std", "WITH " + ",\n".join([PATCH, *box_ctes("b3", "pt", "gray", 3, "reflect", "patch_id", 8), *box_ctes("b15", "pt", "gray", 15, "reflect", "patch_id", 8)]) + """
SELECT patch_id, r, c, round(sqrt(greatest(b3.q / 9 - (b3.s / 9) * (b3.s / 9), 0)), 6) AS std3,
  round(sqrt(greatest(b15.q / 225 - (b15.s / 225) * (b15.s / 225), 0)), 6) AS std15 FROM b3 JOIN b15 USING (patch_id, r, c)""")
def w6(spark, sf_dir):
    out = focal.local_std(patch_grid(spark, sf_dir), "gray", {"std3": 3, "std15": 15}, ["patch_id"])
    return out.select("patch_id", "r", "c", F.round("std3", 6).alias("std3"), F.round("std15", 6).alias("std15"))


@query("w7_gradient", f"""WITH {PATCH}
SELECT patch_id, r, c, round(CASE WHEN r = 0 THEN dn - gray WHEN r = 7 THEN gray - up ELSE (dn - up) / 2 END, 6) AS gy,
  round(CASE WHEN c = 0 THEN rt - gray WHEN c = 7 THEN gray - lf ELSE (rt - lf) / 2 END, 6) AS gx
FROM (SELECT *, lag(gray) OVER (PARTITION BY patch_id, c ORDER BY r) AS up, lead(gray) OVER (PARTITION BY patch_id, c ORDER BY r) AS dn,
  lag(gray) OVER (PARTITION BY patch_id, r ORDER BY c) AS lf, lead(gray) OVER (PARTITION BY patch_id, r ORDER BY c) AS rt FROM pt)""")
def w7(spark, sf_dir):
    out = focal.gradient(patch_grid(spark, sf_dir), "gray", ["patch_id"])
    return out.select("patch_id", "r", "c", F.round("gy", 6).alias("gy"), F.round("gx", 6).alias("gx"))


BUILT_GRID = ["bm AS (SELECT scene_id, r, c, 1 AS v FROM px WHERE truth = 'built')", *grid_ctes("bm", "v", "0", out="bg"),
              "bmask AS (SELECT scene_id, r, c, valid AS m FROM bg)"]


def dense_mask(px, condition):
    sc = scenes(px).select("scene_id", "width", "height")
    on = px.where(condition).select("scene_id", "r", "c", F.lit(True).alias("m"))
    return focal.densify(on, sc, {"m": False})


@query("w8_morphology", with_px("SELECT scene_id, r, c, m FROM mo", *BUILT_GRID, *morph_ctes("bmask", "mo")))
def w8(spark, sf_dir):
    mask = dense_mask(pixels(spark, sf_dir), F.col("truth") == "built")
    return focal.morphology(mask, "m").select("scene_id", "r", "c", "m")


CELLS = "cells AS (SELECT scene_id, r, c FROM px WHERE truth IN ('built', 'cloud'))"


def built_cells(spark, sf_dir):
    return pixels(spark, sf_dir).where("truth IN ('built', 'cloud')").select("scene_id", "r", "c")


@query("g1_connected_components", with_px("SELECT scene_id, r, c, component FROM (SELECT scene_id, r, component, CAST(unnest(range(c0, c1 + 1)) AS INT) AS c FROM cc)",
                                         CELLS, *component_ctes("cells", "cc")))
def g1(spark, sf_dir):
    return components.connected_components(built_cells(spark, sf_dir), KEY).select("scene_id", "r", "c", "component")


@query("g2_area_open", with_px("""SELECT scene_id, r, c FROM (SELECT scene_id, r, CAST(unnest(range(c0, c1 + 1)) AS INT) AS c FROM cc
  WHERE (scene_id, component) IN (SELECT (scene_id, component) FROM cc GROUP BY scene_id, component HAVING sum(c1 - c0 + 1) >= 30))""",
                               CELLS.replace("truth IN ('built', 'cloud')", "truth IN ('built', 'cloud') AND (r + c) % 4 <> 0"), *component_ctes("cells", "cc")))
def g2(spark, sf_dir):
    cells = built_cells(spark, sf_dir).where("(r + c) % 4 <> 0")
    return components.run_cells(components.area_open(cells, KEY, 30), KEY).select("scene_id", "r", "c")


REGION_COLS = ("scene_id, rank, component, pixels, r0, r1, c0, c1, cx, cy, fill_ratio, fraction_of_scene, area_km2, unit, "
               "box_west, box_south, box_east, box_north, lon, lat")


@query("a11_region_stats", with_px(f"SELECT {REGION_COLS} FROM rg", CELLS, HALF_SQL, *component_ctes("cells", "cc"),
                                  *region_ctes("cc", "rg", "half", min_pixels=4, top=1000000)))
def a11(spark, sf_dir):
    px = pixels(spark, sf_dir)
    regions = components.region_stats(components.connected_runs(built_cells(spark, sf_dir), KEY), KEY)
    ranked = components.rank_regions(regions, KEY, 4, 1_000_000)
    return components.locate_regions(ranked, half_located(scenes(px)), KEY)


@query("k1_top_regions", with_px("SELECT scene_id, rank, component, pixels FROM rg", CELLS, HALF_SQL, *component_ctes("cells", "cc"),
                                *region_ctes("cc", "rg", "half", min_pixels=8, top=3)))
def k1(spark, sf_dir):
    regions = components.region_stats(components.connected_runs(built_cells(spark, sf_dir), KEY), KEY)
    return components.rank_regions(regions, KEY, 8, 3).select("scene_id", "rank", "component", "pixels")


@query("w2_rank_regions", with_px("""SELECT scene_id, truth, pixels, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY pixels DESC, truth) AS INT) AS rank
FROM (SELECT scene_id, truth, count(*) AS pixels FROM px GROUP BY ALL)"""))
def w2(spark, sf_dir):
    n = pixels(spark, sf_dir).groupBy("scene_id", F.col("truth").alias("component")).agg(F.count("*").alias("pixels"))
    return components.rank_regions(n, KEY, 0, 1000).select("scene_id", F.col("component").alias("truth"), "pixels", "rank")


# -------------------------------------------------------------------------- radar
SAR_CTES = [
    *TEX, "lay AS (SELECT * FROM tex WHERE valid)", *otsu_ctes("wt", "lay", "scene_id", "filtered"),
    "mk AS (SELECT lay.*, least(0.42, greatest(0.06, threshold)) AS t_water, filtered < least(0.42, greatest(0.06, threshold)) AS water FROM lay JOIN wt USING (scene_id))",
    """sprd AS (SELECT scene_id, quantile_cont(filtered, 0.02) AS f2, quantile_cont(filtered, 0.98) AS f98, quantile_cont(texture, 0.02) AS x2,
      quantile_cont(texture, 0.98) AS x98 FROM mk WHERE NOT water GROUP BY 1)""",
    """sco AS (SELECT mk.*, round(0.5 * least(1.0, greatest(0.0, (filtered - f2) / greatest(f98 - f2, 1e-6))) + 0.5 * least(1.0, greatest(0.0,
      (texture - x2) / greatest(x98 - x2, 1e-6))), 9) AS score FROM mk LEFT JOIN sprd USING (scene_id))""",
    "tb AS (SELECT scene_id, quantile_cont(score, 0.8) AS t_built FROM sco WHERE NOT water GROUP BY 1)",
    "sarc AS (SELECT sco.*, coalesce(t_built, 1.0) AS t_built, NOT water AND coalesce(score > t_built, false) AS built_up FROM sco LEFT JOIN tb USING (scene_id))",
]


@query("c9_sar_segment", with_px("""SELECT scene_id, count(*) AS valid, count(*) FILTER (water) AS water, count(*) FILTER (built_up) AS built_up,
  round(any_value(t_water), 6) AS t_water, round(any_value(t_built), 5) AS t_built FROM sarc GROUP BY 1""", *SAR_CTES))
def c9(spark, sf_dir):
    cells, cuts = radar.sar_segment(radar_cells(spark, sf_dir))
    n = cells.groupBy("scene_id").agg(F.count("*").alias("valid"), F.count_if("water").alias("water"), F.count_if("built_up").alias("built_up"))
    return n.join(cuts, "scene_id").select("scene_id", "valid", "water", "built_up", F.round("t_water", 6).alias("t_water"),
                                           F.round("t_built", 5).alias("t_built"))


@query("k7_top_land_score", with_px("SELECT scene_id, r, c FROM sarc WHERE built_up", *SAR_CTES))
def k7(spark, sf_dir):
    cells, _ = radar.sar_segment(radar_cells(spark, sf_dir))
    return cells.where("built_up").select("scene_id", "r", "c")


@query("a9_sar_stats", with_px("""SELECT scene_id, count(*) AS valid_pixels, round(avg(filtered), 6) AS mean_backscatter, round(stddev_pop(filtered), 6) AS std_backscatter,
  round(quantile_cont(filtered, 0.5), 6) AS median_backscatter, round(quantile_cont(filtered, 0.1), 6) AS p10_backscatter,
  round(quantile_cont(filtered, 0.9), 6) AS p90_backscatter, round(avg(texture), 5) AS mean_texture, round(quantile_cont(texture, 0.75), 5) AS texture_threshold,
  count(*) FILTER (water) AS water_pixels, count(*) FILTER (built_up) AS builtup_pixels, round(count(*) FILTER (water) / count(*), 6) AS water_fraction,
  round(count(*) FILTER (NOT water) / count(*), 6) AS land_fraction FROM sarc GROUP BY 1""", *SAR_CTES))
def a9(spark, sf_dir):
    cells, _ = radar.sar_segment(radar_cells(spark, sf_dir))
    s = radar.sar_stats(cells)
    return s.select("scene_id", "valid_pixels", "water_pixels", "builtup_pixels", *[F.round(c, 6).alias(c) for c in (
        "mean_backscatter", "std_backscatter", "median_backscatter", "p10_backscatter", "p90_backscatter", "water_fraction", "land_fraction")],
        F.round("mean_texture", 5).alias("mean_texture"), F.round("texture_threshold", 5).alias("texture_threshold"))


@query("a2_backscatter_histogram", with_px("""SELECT s.scene_id, CAST(b AS INT) AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT scene_id FROM px) s
CROSS JOIN range(0, 48) t(b) LEFT JOIN (SELECT scene_id, least(floor(sar * 48), 47) AS bin, count(*) AS n FROM px WHERE sar BETWEEN 0 AND 1 GROUP BY ALL) h
ON h.scene_id = s.scene_id AND h.bin = b"""))
def a2sar(spark, sf_dir):
    return histogram(pixels(spark, sf_dir), KEY, "sar", 48, 0.0, 1.0)


MASKS = ["fz AS (SELECT scene_id, r, c, truth = 'water' AS o, sar < 0.1 AS s, truth = 'cloud' AS cloud FROM px)",
         f"km AS (SELECT scene_id, {AREA} / 4096 AS km2 FROM ({SCENES_SQL}))"]


def masks(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return px.select("scene_id", "r", "c", (F.col("truth") == "water").alias("optical_water"), (F.col("sar") < 0.1).alias("sar_water"),
                     (F.col("truth") == "cloud").alias("cloud"))


@query("u2_mask_set_operations", with_px("""SELECT scene_id, count(*) FILTER (o AND s) AS both, count(*) FILTER (o OR s) AS either,
  count(*) FILTER (o AND NOT s) AS optical_only, count(*) FILTER (s AND NOT o) AS sar_only FROM fz GROUP BY 1""", *MASKS))
def u2(spark, sf_dir):
    f = radar.fuse_water(masks(spark, sf_dir))
    return f.groupBy("scene_id").agg(F.count_if("both").alias("both"), F.count_if(F.col("optical_water") | F.col("sar_water")).alias("either"),
                                     F.count_if("optical_only").alias("optical_only"), F.count_if("sar_only").alias("sar_only"))


@query("u4_fused_decision", with_px("SELECT scene_id, r, c, CASE WHEN cloud THEN s ELSE o OR s END AS fused FROM fz", *MASKS))
def u4(spark, sf_dir):
    return radar.fuse_water(masks(spark, sf_dir)).select("scene_id", "r", "c", "fused")


FUSION = """SELECT scene_id, count(*) FILTER (o) AS optical_water_pixels, count(*) FILTER (s) AS sar_water_pixels, count(*) FILTER (o AND s) AS agreement_pixels,
  count(*) FILTER (CASE WHEN cloud THEN s ELSE o OR s END) AS fused_water_pixels, count(*) FILTER (cloud AND s AND NOT o) AS cloud_recovered_pixels,
  count(*) AS valid_pixels, round_even(count(*) FILTER (o AND s) / count(*) FILTER (o OR s), 4) AS iou,
  round_even(count(*) FILTER (CASE WHEN cloud THEN s ELSE o OR s END) * any_value(km2), 4) AS fused_water_km2,
  round_even(count(*) FILTER (cloud AND s AND NOT o) * any_value(km2), 4) AS cloud_recovered_km2 FROM {f} JOIN km USING (scene_id) GROUP BY 1"""
FUSION_COLS = ("scene_id", "optical_water_pixels", "sar_water_pixels", "agreement_pixels", "fused_water_pixels", "cloud_recovered_pixels",
               "valid_pixels", "iou", "fused_water_km2", "cloud_recovered_km2")


@query("a10_fusion_stats", with_px(FUSION.format(f="fz"), *MASKS))
def a10(spark, sf_dir):
    km2 = scenes(pixels(spark, sf_dir)).select("scene_id", geo.pixel_area_km2().alias("pixel_km2"))
    return radar.fusion_stats(radar.fuse_water(masks(spark, sf_dir)), km2).select(*FUSION_COLS)


@query("c10_optical_sar_fusion", with_px(FUSION.format(f="fu"), MASKS[1], *landcover_ctes(), *SAR_CTES,
                                        "fu AS (SELECT scene_id, r, c, class = 'water' AS o, water AS s, class = 'cloud_or_snow' AS cloud FROM (SELECT scene_id, r, c, class FROM lc) JOIN (SELECT scene_id, r, c, water FROM sarc) USING (scene_id, r, c))"))
def c10(spark, sf_dir):
    from skyframe.plans.fusion import optical_sar_fusion

    px = pixels(spark, sf_dir)
    km2 = scenes(px).select("scene_id", geo.pixel_area_km2().alias("pixel_km2"))
    _, stats = optical_sar_fusion(px, radar_cells(spark, sf_dir), km2)
    return stats.select(*FUSION_COLS)


SAR_FACTS = ("sar_mean_backscatter", "sar_median_backscatter", "sar_std_backscatter", "sar_water_fraction", "sar_water_pixels", "sar_builtup_fraction", "sar_mean_texture")


@query("c9_facts", with_px(f"""SELECT scene_id, fact_key, round_even(v, 6) AS value_num FROM (SELECT scene_id, avg(filtered) AS sar_mean_backscatter, quantile_cont(filtered, 0.5) AS sar_median_backscatter,
  stddev_pop(filtered) AS sar_std_backscatter, count(*) FILTER (water) / count(*) AS sar_water_fraction, CAST(count(*) FILTER (water) AS DOUBLE) AS sar_water_pixels,
  count(*) FILTER (built_up) / count(*) AS sar_builtup_fraction, avg(texture) AS sar_mean_texture FROM sarc GROUP BY 1) UNPIVOT (v FOR fact_key IN ({', '.join(SAR_FACTS)}))""", *SAR_CTES))
def c9_facts(spark, sf_dir):
    cells, _ = radar.sar_segment(radar_cells(spark, sf_dir))
    return tool_facts.sar_facts(radar.sar_stats(cells)).select("scene_id", "fact_key", "value_num")


@query("c10_facts", with_px(f"""SELECT scene_id, fact_key, round_even(v, 6) AS value_num FROM (SELECT scene_id, iou AS fusion_iou, optical_water_pixels / valid_pixels AS fusion_optical_water_fraction,
  sar_water_pixels / valid_pixels AS fusion_sar_water_fraction, fused_water_pixels / valid_pixels AS fusion_water_fraction,
  CAST(optical_water_pixels - agreement_pixels AS DOUBLE) AS fusion_optical_only_pixels, CAST(sar_water_pixels - agreement_pixels AS DOUBLE) AS fusion_sar_only_pixels,
  CAST(cloud_recovered_pixels AS DOUBLE) AS fusion_cloud_recovered_pixels, CAST(valid_pixels AS DOUBLE) AS fusion_coobserved_pixels,
  fused_water_km2 AS fusion_water_km2, cloud_recovered_km2 AS fusion_cloud_recovered_km2 FROM ({FUSION.format(f="fz")}))
  UNPIVOT (v FOR fact_key IN (fusion_iou, fusion_optical_water_fraction, fusion_sar_water_fraction, fusion_water_fraction, fusion_optical_only_pixels, fusion_sar_only_pixels,
  fusion_cloud_recovered_pixels, fusion_coobserved_pixels, fusion_water_km2, fusion_cloud_recovered_km2))""", *MASKS))
def c10_facts(spark, sf_dir):
    km2 = scenes(pixels(spark, sf_dir)).select("scene_id", geo.pixel_area_km2().alias("pixel_km2"))
    stats = radar.fusion_stats(radar.fuse_water(masks(spark, sf_dir)), km2)
    return tool_facts.fusion_facts(stats).select("scene_id", "fact_key", "value_num")


# ------------------------------------------------- fusion with its gates: planted refusals by year
def gated(spark, sf_dir):
    """Fusion where 1995 has no radar scene, 1996 hardly any radar cell and 1997 a radar scene that lies elsewhere."""
    from skyframe.plans import fusion

    px = pixels(spark, sf_dir)
    sc = scenes(px)
    radar_scenes = sc.where("yr <> 1995").withColumns({k: F.col(k) + F.when(F.col("yr") == 1997, 0.5).otherwise(0.0) for k in ("west", "east")})
    cells = radar_cells(spark, sf_dir).where("scene_id % 10000 <> 1995 AND (scene_id % 10000 <> 1996 OR r = 0)")
    return fusion, (px, cells, sc, radar_scenes)


FUSED_CELLS = "fu AS (SELECT scene_id, r, c, class = 'water' AS o, water AS s, class = 'cloud_or_snow' AS cloud FROM (SELECT scene_id, r, c, class FROM lc) JOIN (SELECT scene_id, r, c, water FROM sarc) USING (scene_id, r, c) WHERE scene_id % 10000 NOT IN (1995, 1996, 1997))"
GATED = [MASKS[1], *landcover_ctes(), *SAR_CTES, FUSED_CELLS]


@query("c10_status", with_px("""SELECT scene_id, CASE WHEN yr = 1995 THEN 'skipped' WHEN yr = 1997 THEN 'error' WHEN share < 0.02 THEN 'no_data' ELSE 'ok' END AS status,
  CASE WHEN yr = 1995 THEN 'no radar scene' WHEN yr = 1997 THEN 'corners lie apart by 0.500000 degrees'
    WHEN share < 0.02 THEN concat('both sensors observed only ', CAST(CAST(share * 100 AS DECIMAL(9, 1)) AS VARCHAR), ' % of the grid') END AS reason,
  CASE WHEN yr = 1997 THEN 0.5::DOUBLE WHEN yr <> 1995 THEN 0.0::DOUBLE END AS max_corner_offset_deg, CASE WHEN yr NOT IN (1995, 1997) THEN share END AS overlap
FROM (SELECT scene_id, yr, count(*) FILTER (yr <> 1996 OR r = 0) / 4096.0::DOUBLE AS share FROM px GROUP BY ALL)"""))
def c10_status(spark, sf_dir):
    fusion, given = gated(spark, sf_dir)
    return fusion.fusion_status(*given)


@query("c10_regions", with_px(f"SELECT {REGION_COLS} FROM rg", *GATED, "fw AS (SELECT scene_id, r, c, 1 AS v FROM fu WHERE CASE WHEN cloud THEN s ELSE o OR s END)",
                             *grid_ctes("fw", "v", "0", out="bg"), "bmask AS (SELECT scene_id, r, c, valid AS m FROM bg)", *morph_ctes("bmask", "mo"),
                             "moc AS (SELECT scene_id, r, c FROM mo WHERE m)", *component_ctes("moc", "cc"), f"sc AS ({SCENES_SQL})",
                             "big AS (SELECT scene_id, component FROM cc GROUP BY ALL HAVING sum(c1 - c0 + 1) >= 20)", "kept AS (SELECT cc.* FROM cc JOIN big USING (scene_id, component))",
                             *region_ctes("kept", "rg", "sc", min_pixels=40, top=6)))
def c10_regions(spark, sf_dir):
    fusion, given = gated(spark, sf_dir)
    return fusion.fuse_scenes(*given)["regions"]


@query("c10_plan_facts", with_px(f"""SELECT scene_id, fact_key, round_even(v, 6) AS value_num FROM (SELECT scene_id, iou AS fusion_iou, optical_water_pixels / valid_pixels AS fusion_optical_water_fraction,
  sar_water_pixels / valid_pixels AS fusion_sar_water_fraction, fused_water_pixels / valid_pixels AS fusion_water_fraction,
  CAST(optical_water_pixels - agreement_pixels AS DOUBLE) AS fusion_optical_only_pixels, CAST(sar_water_pixels - agreement_pixels AS DOUBLE) AS fusion_sar_only_pixels,
  CAST(cloud_recovered_pixels AS DOUBLE) AS fusion_cloud_recovered_pixels, CAST(valid_pixels AS DOUBLE) AS fusion_coobserved_pixels,
  fused_water_km2 AS fusion_water_km2, cloud_recovered_km2 AS fusion_cloud_recovered_km2 FROM ({FUSION.format(f="fu")}))
  UNPIVOT (v FOR fact_key IN (fusion_iou, fusion_optical_water_fraction, fusion_sar_water_fraction, fusion_water_fraction, fusion_optical_only_pixels, fusion_sar_only_pixels,
  fusion_cloud_recovered_pixels, fusion_coobserved_pixels, fusion_water_km2, fusion_cloud_recovered_km2))""", *GATED))
def c10_plan_facts(spark, sf_dir):
    fusion, given = gated(spark, sf_dir)
    return fusion.fuse_scenes(*given)["facts"].select("scene_id", "fact_key", "value_num")
