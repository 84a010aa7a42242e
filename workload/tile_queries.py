"""Tiles, patch features and classification (M, A16-A18, W9, W10, W12, J13, J14 rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe import fixed_values as V
from skyframe.operators import learn, tiles
from skyframe.plans import tool_facts

from .fixtures import PATCHES_DUCK, patches, pixels, scenes, with_px
from .registry import query, table
from .spatial_queries import PATCH
from .sql_parts import box_ctes

TILE_SQL = """tl AS (SELECT scene_id, o1 AS tile_r, o2 AS tile_c, count(*) AS n FROM px
  JOIN (SELECT CAST(i * 8 AS INT) AS o1 FROM range(0, 8) t(i)) a ON px.r >= o1 AND px.r < o1 + 16 AND o1 + 16 <= 64
  JOIN (SELECT CAST(i * 8 AS INT) AS o2 FROM range(0, 8) t(i)) b ON px.c >= o2 AND px.c < o2 + 16 AND o2 + 16 <= 64 GROUP BY ALL)"""


def tiled(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return tiles.tile_scenes(tiles.tile_pixels(px.select("scene_id", "r", "c"), scenes(px), 16, 8), 16, 0.8)


@query("m1_tile_scenes", with_px("SELECT scene_id, tile_r, tile_c, round(n / 256.0, 6) AS valid_share FROM tl WHERE n / 256.0 >= 0.8", TILE_SQL))
def m1(spark, sf_dir):
    return tiled(spark, sf_dir).select("scene_id", "tile_r", "tile_c", F.round("valid_share", 6).alias("valid_share"))


@query("w9_sample_evenly", with_px("""
SELECT scene_id, tile_r, tile_c FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY tile_r, tile_c) - 1 AS k, count(*) OVER (PARTITION BY scene_id) AS n
  FROM (SELECT * FROM tl WHERE n / 256.0 >= 0.8)) WHERE n <= 12 OR EXISTS (SELECT 1 FROM range(0, 12) t(i) WHERE (i * (n - 1)) // 11 = k)""", TILE_SQL).replace(
    "SELECT *, row_number()", "SELECT scene_id, tile_r, tile_c, row_number()"))
def w9(spark, sf_dir):
    return tiles.sample_evenly(tiled(spark, sf_dir), 12).select("scene_id", "tile_r", "tile_c")


def gray_patches(spark, sf_dir):
    g = F.col("gray")
    return patches(spark, sf_dir).select(F.col("patch_id").alias("tile_id"), "label", "r", "c", F.lit(8).alias("height"), F.lit(8).alias("width"),
                                         g.alias("red"), g.alias("green"), g.alias("blue"), "gray")


GRAY_CHANNELS = dict.fromkeys(("red", "green", "blue"), "gray") | dict.fromkeys(("vari", "exg", "gli", "ngrdi", "rbdiff", "saturation"), "0.0") | dict.fromkeys(
    ("chroma_r", "chroma_g", "chroma_b"), "gray / greatest(gray + gray + gray, 1e-6)") | {"brightness": "(gray + gray + gray) / 3.0"}
#: Every channel of a gray patch, and its moments.
ALL_CHANNELS = "ch AS (" + " UNION ALL ".join(f"SELECT patch_id AS tile_id, '{k}' AS channel, {v} AS v FROM pt" for k, v in GRAY_CHANNELS.items()) + ")"
MOMENT_CTES = [ALL_CHANNELS, "mm AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM ch WINDOW w AS (PARTITION BY tile_id, channel))",
               """mo AS (SELECT tile_id, channel, avg(v) AS mean, stddev_pop(v) AS std, avg(pow((v - m) / greatest(s, 1e-6), 3)) AS skew,
  avg(pow((v - m) / greatest(s, 1e-6), 4)) AS kurt, """ + ", ".join(f"quantile_cont(v, {q / 100}) AS p{q}" for q in (5, 25, 50, 75, 95)) + " FROM mm GROUP BY ALL)"]

@query("a16_patch_moments", "WITH " + ",\n".join([PATCH, *MOMENT_CTES]) + " SELECT tile_id, channel, " + ", ".join(
    f"round({c}, {5 if c in ('skew', 'kurt') else 6}) + 0.0 AS {c}" for c in ("mean", "std", "skew", "kurt", "p5", "p25", "p50", "p75", "p95")) + " FROM mo")
def a16(spark, sf_dir):
    m = tiles.patch_moments(tiles.channel_rows(gray_patches(spark, sf_dir)), ["tile_id", "channel"])
    return m.select("tile_id", "channel", *[(F.round(c, 5 if c in ("skew", "kurt") else 6) + 0.0).alias(c) for c in tiles.MOMENTS])


@query("w10_profiles", f"""WITH {PATCH}, a AS (SELECT patch_id, stddev_pop(m) AS rp FROM (SELECT patch_id, r, avg(gray) AS m FROM pt GROUP BY ALL) GROUP BY 1),
b AS (SELECT patch_id, stddev_pop(m) AS cp FROM (SELECT patch_id, c, avg(gray) AS m FROM pt GROUP BY ALL) GROUP BY 1)
SELECT patch_id AS tile_id, round(rp, 6) AS row_profile_std, round(cp, 6) AS col_profile_std, round(abs(rp - cp), 6) AS anisotropy FROM a JOIN b USING (patch_id)""")
def w10(spark, sf_dir):
    p = tiles.profiles(gray_patches(spark, sf_dir))
    return p.select("tile_id", *[F.round(c, 6).alias(c) for c in ("row_profile_std", "col_profile_std", "anisotropy")])


@query("w12_layout_grid", f"""WITH {PATCH} SELECT patch_id AS tile_id, CASE WHEN r < 2 THEN 0 WHEN r < 5 THEN 1 ELSE 2 END AS gi, CASE WHEN c < 2 THEN 0 WHEN c < 5 THEN 1 ELSE 2 END AS gj,
  round(avg(gray), 6) AS gray FROM pt GROUP BY ALL""")
def w12(spark, sf_dir):
    return tiles.layout_grid(gray_patches(spark, sf_dir), ["gray"]).select("tile_id", "gi", "gj", F.round("gray", 6).alias("gray"))


@query("a2_colour_histogram", f"""WITH {PATCH} SELECT patch_id AS tile_id, channel, CAST(least(floor(gray * 12), 11) AS INT) AS bin, round(count(*) / 64.0, 6) AS share
FROM pt, unnest(['red', 'green', 'blue']) t(channel) GROUP BY ALL""")
def a2c(spark, sf_dir):
    return tiles.channel_histogram(gray_patches(spark, sf_dir)).withColumn("share", F.round("share", 6))


M2_CTES = [PATCH, *MOMENT_CTES,
           *[x for k in (3, 7, 15) for x in box_ctes(f"b{k}", "pt", "gray", k, "reflect", "patch_id", 8)],
           *[f"t{k} AS (SELECT patch_id AS tile_id, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.9) AS p90 FROM (SELECT patch_id, sqrt(greatest(q / {k * k} - (s / {k * k}) * (s / {k * k}), 0)) AS v FROM b{k}) GROUP BY 1)"
             for k in (3, 7, 15)],
           """sl AS (SELECT patch_id, CASE WHEN r = 0 THEN dn - gray WHEN r = 7 THEN gray - up ELSE (dn - up) / 2 END AS gy,
  CASE WHEN c = 0 THEN rt - gray WHEN c = 7 THEN gray - lf ELSE (rt - lf) / 2 END AS gx
  FROM (SELECT *, lag(gray) OVER (PARTITION BY patch_id, c ORDER BY r) AS up, lead(gray) OVER (PARTITION BY patch_id, c ORDER BY r) AS dn,
    lag(gray) OVER (PARTITION BY patch_id, r ORDER BY c) AS lf, lead(gray) OVER (PARTITION BY patch_id, r ORDER BY c) AS rt FROM pt))""",
           """gr AS (SELECT patch_id AS tile_id, avg(sqrt(gx * gx + gy * gy)) AS grad_mean, stddev_pop(sqrt(gx * gx + gy * gy)) AS grad_std,
  quantile_cont(sqrt(gx * gx + gy * gy), 0.95) AS grad_p95, avg(CASE WHEN abs(gy) + abs(gx) > 0.06 THEN 1.0 ELSE 0.0 END) AS edge_density FROM sl GROUP BY 1)""",
           """hs AS (SELECT DISTINCT p.patch_id AS tile_id, b AS bin, coalesce(n, 0) / 64.0 AS share FROM pt p CROSS JOIN range(0, 12) t(b) LEFT JOIN (
  SELECT patch_id, least(floor(gray * 12), 11) AS bin, count(*) AS n FROM pt GROUP BY ALL) h ON h.patch_id = p.patch_id AND h.bin = b)""",
           """gd AS (SELECT patch_id AS tile_id, CASE WHEN r < 2 THEN 0 WHEN r < 5 THEN 1 ELSE 2 END AS gi, CASE WHEN c < 2 THEN 0 WHEN c < 5 THEN 1 ELSE 2 END AS gj, avg(gray) AS v FROM pt GROUP BY ALL)""",
           """pf AS (SELECT * FROM (SELECT patch_id AS tile_id, stddev_pop(m) AS rp FROM (SELECT patch_id, r, avg(gray) AS m FROM pt GROUP BY ALL) GROUP BY 1)
  JOIN (SELECT patch_id AS tile_id, stddev_pop(m) AS cp FROM (SELECT patch_id, c, avg(gray) AS m FROM pt GROUP BY ALL) GROUP BY 1) USING (tile_id))""",
           """named AS (SELECT tile_id, concat(channel, '_', k) AS name, v FROM mo UNPIVOT (v FOR k IN (mean, std, skew, kurt, p5, p25, p50, p75, p95))
""" + " ".join(f"UNION ALL SELECT tile_id, concat('texstd{k}_', k), v FROM t{k} UNPIVOT (v FOR k IN (mean, std, p90))" for k in (3, 7, 15)) + """
UNION ALL SELECT tile_id, k, v FROM gr UNPIVOT (v FOR k IN (grad_mean, grad_std, grad_p95, edge_density))
UNION ALL SELECT tile_id, concat('hist_', b, '_', CAST(bin AS INT)), share FROM hs, unnest(['red', 'green', 'blue']) t(b)
UNION ALL SELECT tile_id, concat('grid', gi, gj, '_', b), v FROM gd, unnest(['red', 'green', 'blue']) t(b)
UNION ALL SELECT tile_id, 'row_profile_std', rp FROM pf UNION ALL SELECT tile_id, 'col_profile_std', cp FROM pf UNION ALL SELECT tile_id, 'anisotropy', abs(rp - cp) FROM pf)"""]


@query("m2_patch_features", "WITH " + ",\n".join(M2_CTES) + f"""
SELECT tile_id, CAST(list_position({tiles.feature_names()}, name) - 1 AS INT) AS i, round(v, 5) + 0.0 AS v FROM named""")
def m2(spark, sf_dir):
    f = tiles.patch_features(gray_patches(spark, sf_dir))
    return f.select("tile_id", F.posexplode("features").alias("i", "v")).select("tile_id", "i", (F.round("v", 5) + 0.0).alias("v"))


@query("j13_map_coarse", f"""SELECT coarse, count(*) AS patches FROM (SELECT coalesce(MAP {{{', '.join(repr(k) + ': ' + repr(v) for k, v in V.EUROSAT_TO_COARSE.items())}}}[
  {list(V.EUROSAT_TO_COARSE) + ['Ship']}[vec_id % 11 + 1]], 'unclassified') AS coarse FROM embeddings) GROUP BY 1""")
def j13(spark, sf_dir):
    names = F.array(*map(F.lit, list(V.EUROSAT_TO_COARSE) + ["Ship"]))
    return table(spark, sf_dir, "embeddings").select(learn.map_coarse(F.get(names, (F.col("vec_id") % 11).cast("int"))).alias("coarse")).groupBy("coarse").agg(
        F.count("*").alias("patches"))


@query("j14_paint_tiles", with_px("""SELECT scene_id, r, c, label AS class FROM px LEFT JOIN (SELECT scene_id, r // 16 AS a, c // 16 AS b, CASE WHEN avg(nir) > 0.3 THEN 'dense_vegetation' ELSE 'bare_soil' END AS label
  FROM px WHERE (r // 16 + c // 16) % 3 <> 0 GROUP BY ALL) t ON t.scene_id = px.scene_id AND a = r // 16 AND b = c // 16""").replace("SELECT scene_id, r, c, label", "SELECT px.scene_id, r, c, label"))
def j14(spark, sf_dir):
    px = pixels(spark, sf_dir)
    t = px.groupBy("scene_id", F.expr("int(r div 16) * 16 AS tile_r"), F.expr("int(c div 16) * 16 AS tile_c")).agg(
        F.when(F.avg("nir") > 0.3, "dense_vegetation").otherwise("bare_soil").alias("class")).where("(tile_r / 16 + tile_c / 16) % 3 <> 0")
    return tiles.paint_tiles(t, px.select("scene_id", "r", "c"), 16)


#: Tiles of 16 pixels every 8 and every 12, with classes and confidences from their pixels.
VOTING = """vt AS (SELECT scene_id, o1 AS tile_r, o2 AS tile_c, CASE WHEN avg(nir) > 0.35 THEN 'dense_vegetation' WHEN avg(blue) > 0.25 THEN 'water' ELSE 'bare_soil' END AS class,
  count(*) / 256.0::DOUBLE AS confidence FROM px
  JOIN (SELECT CAST(i * {stride} AS INT) AS o1 FROM range(0, 8) t(i)) a ON px.r >= o1 AND px.r < o1 + 16 AND o1 + 16 <= 64
  JOIN (SELECT CAST(i * {stride} AS INT) AS o2 FROM range(0, 8) t(i)) b ON px.c >= o2 AND px.c < o2 + 16 AND o2 + 16 <= 64 WHERE (o1 / {stride} + o2) % 5 <> 0 GROUP BY ALL)"""
COVERED = "cv AS (SELECT px.scene_id, px.r, px.c, tile_r, tile_c, class, confidence FROM px LEFT JOIN vt ON px.scene_id = vt.scene_id AND px.r >= tile_r AND px.r < tile_r + 16 AND px.c >= tile_c AND px.c < tile_c + 16)"


def voting(spark, sf_dir, stride):
    px = pixels(spark, sf_dir)
    covered = tiles.tile_pixels(px.select("scene_id", "r", "c", "nir", "blue"), scenes(px), 16, stride).where(f"(tile_r / {stride} + tile_c) % 5 <> 0")
    label = F.when(F.avg("nir") > 0.35, "dense_vegetation").when(F.avg("blue") > 0.25, "water").otherwise("bare_soil")
    return px.select("scene_id", "r", "c"), covered.groupBy("scene_id", "tile_r", "tile_c").agg(label.alias("class"), (F.count("*") / 256.0).alias("confidence"))


@query("j14_paint_votes", with_px("""SELECT scene_id, r, c, class FROM (SELECT scene_id, r, c, class, round(sum(confidence), 9) AS w FROM cv GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY scene_id, r, c ORDER BY w DESC NULLS LAST, class) = 1""", VOTING.format(stride=12), COVERED))
def j14_votes(spark, sf_dir):
    px, t = voting(spark, sf_dir, 12)
    return tiles.paint_tiles(t, px, 16, 12)


@query("j14_paint_last", with_px("SELECT scene_id, r, c, class FROM cv QUALIFY row_number() OVER (PARTITION BY scene_id, r, c ORDER BY tile_r DESC NULLS LAST, tile_c DESC) = 1",
                                VOTING.format(stride=8), COVERED))
def j14_last(spark, sf_dir):
    px, t = voting(spark, sf_dir, 8)
    return tiles.paint_tiles(t, px, 16, 8, "last")


# planted predictions: the label, shifted for every third vector
PRED = """pr AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(CASE WHEN vec_id % 3 = 0 THEN (label + vec_id) % 10 ELSE label END AS VARCHAR) AS predicted,
  vec_id % 7 AS scene, 0.5 + (vec_id % 50) / 100.0::DOUBLE AS confidence FROM embeddings)"""


def planted(spark, sf_dir):
    i, lab = F.col("vec_id"), F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", lab.cast("string").alias("label"), F.when(i % 3 == 0, (lab + i) % 10).otherwise(lab).cast("string").alias("predicted"),
        (i % 7).alias("scene"), (F.lit(0.5) + (i % 50) / F.lit(100.0)).alias("confidence"))


@query("a17_class_distribution", f"""WITH {PRED}, d AS (SELECT scene, predicted, count(*) AS tiles, avg(confidence) AS mc FROM pr GROUP BY ALL)
SELECT scene, predicted, tiles, round(mc, 6) AS mean_confidence, round(tiles / sum(tiles) OVER (PARTITION BY scene), 6) AS fraction,
  CAST(row_number() OVER (PARTITION BY scene ORDER BY tiles DESC, predicted) AS INT) AS rank FROM d""")
def a17(spark, sf_dir):
    d = learn.class_distribution(planted(spark, sf_dir), ["scene"])
    return d.select("scene", "predicted", "tiles", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("fraction", 6).alias("fraction"), "rank")


@query("a18_evaluate", f"""WITH {PRED}, c AS (SELECT DISTINCT label AS class FROM pr), s AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (predicted = class) AS guessed,
  count(*) FILTER (label = class AND predicted = class) AS hits FROM pr, c GROUP BY 1), m AS (SELECT *, hits / guessed AS p, hits / support AS r FROM s)
SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round((SELECT avg((label = predicted)::INT) FROM pr), 6) AS accuracy,
  round((SELECT avg(2 * p * r / (p + r)) FROM m), 6) AS macro_f1 FROM m""")
def a18(spark, sf_dir):
    e = learn.evaluate(planted(spark, sf_dir), "label", "predicted")
    return e.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "macro_f1")])


@query("m3_stratified_split", """SELECT label, count(*) AS n, CAST(floor((count(*) - 1) * 0.25) + 1 AS BIGINT) AS held_out FROM embeddings GROUP BY 1""")
def m3_split(spark, sf_dir):
    s = learn.stratified_split(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id")
    return s.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("held_out"))


def trained(spark, sf_dir):
    feats = tiles.patch_features(gray_patches(spark, sf_dir))
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile_id"), "label")
    from skyframe.session import materialise

    rows = materialise(learn.stratified_split(feats.join(labels, "tile_id"), "label", "tile_id"), "patch-features")
    return learn.train(rows.where("NOT is_test"), trees=20, depth=5), rows


@query("m3_train_m4_predict")
def m4(spark, sf_dir):
    model, rows = trained(spark, sf_dir)
    out = learn.predict(model, rows.where("is_test"))
    return out.select("tile_id", "label", "predicted", F.round("confidence", 6).alias("confidence"))


#: Names of the classifier for what the fixture plants.
PLANTED_NAMES = {"water": "SeaLake", "veg": "Forest", "bare": "AnnualCrop", "built": "Industrial", "cloud": "Highway"}


def colour_tiles(spark, sf_dir):
    """Features of the colour tiles of all scenes, with the commonest planted class of each."""
    px = pixels(spark, sf_dir)
    covered = tiles.tile_pixels(px.select("scene_id", "r", "c", "red", "green", "blue", "truth"), scenes(px), 8)
    key = F.concat_ws("/", "scene_id", "tile_r", "tile_c").alias("tile_id")
    name = F.create_map(*[F.lit(x) for kv in PLANTED_NAMES.items() for x in kv])
    place = ["scene_id", "tile_r", "tile_c"]
    counts = covered.groupBy(*place, F.try_element_at(name, F.col("truth")).alias("label")).agg(F.count("*").alias("n"))
    labels = counts.groupBy(*place).agg(F.min(F.struct((-F.col("n")).alias("m"), "label"))["label"].alias("label")).select(key, "label")
    patches_ = covered.select(key, (F.col("r") - F.col("tile_r")).alias("r"), (F.col("c") - F.col("tile_c")).alias("c"), F.lit(8).alias("height"), F.lit(8).alias("width"),
                              "red", "green", "blue")
    return tiles.patch_features(patches_).join(labels, "tile_id")


def boosted(spark, sf_dir):
    rows = learn.stratified_split(colour_tiles(spark, sf_dir), "label", "tile_id", in_place=True)
    return learn.train(rows.where("NOT is_test"), algorithm="boosted", trees=4, depth=2), rows


@query("m3_train_boosted")
def m3_boosted(spark, sf_dir):
    model, rows = boosted(spark, sf_dir)
    return learn.predict(model, rows.where("is_test")).select("tile_id", "label", "predicted", F.round("confidence", 6).alias("confidence"))


def classified(spark, sf_dir):
    from skyframe.plans.classification import classify_scenes

    model, _ = boosted(spark, sf_dir)
    px = pixels(spark, sf_dir)
    return classify_scenes(px, scenes(px), model, tile=8)


@query("c11_classify_scenes")
def c11(spark, sf_dir):
    return classified(spark, sf_dir)


@query("c11_facts")
def c11_facts(spark, sf_dir):
    return tool_facts.classification_facts(classified(spark, sf_dir)).select("scene_id", "fact_key", "value_num", "value_str", "unit")
