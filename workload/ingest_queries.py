"""Ingest checks, band naming and scaling, catalogues, manifests and sinks (S rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyframe import fixed_values as V
from skyframe.operators import components
from skyframe.operators.focal import densify
from skyframe.session import checkpoint_root
from skyframe.sources import bands, catalog, images, scenes as scene_checks, sinks, tiff

from .expression_queries import AREA, HALF_SQL, BANDS_SQL, band_lists, half_located
from .fixtures import FACTS_SQL, SCENES_SQL, duck, pixels, scenes, with_px
from .registry import query, table
from .spatial_queries import CELLS, KEY, built_cells
from .sql_parts import component_ctes, region_ctes
from .text_queries import TRACE_SQL

EXT = ["png", "jpg", "tif", "bmp", "webp", "pdf", "geotiff", "tif"]
HEAD = ["89504E470D0A1A0A", "FFD8FF", "49492A00", "424D", "524946460000000057454250", "", "89504E470D0A1A0A", ""]
PICK = "[{}][page_id % 8 + 1]"


def file_rows(spark, sf_dir):
    """Pages as uploads: every eighth kind gets another extension and another leading signature."""
    i = (F.col("page_id") % 8 + 1).cast("int")
    head = F.unhex(F.element_at(F.array(*map(F.lit, HEAD)), i))
    body = F.when(F.col("page_id") % 10 == 0, F.encode(F.lit("short file"), "UTF-8")).otherwise(F.encode("html", "UTF-8"))
    content = F.when(F.col("page_id") % 25 == 7, F.unhex(F.lit(""))).otherwise(F.concat(head, body))
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, EXT)), i)).alias("path"),
        F.octet_length(content).cast("bigint").alias("length"), content.alias("content"))


@query("s2_validate_files", f"""
WITH f AS (SELECT page_id, {PICK.format(', '.join(map(repr, EXT)))} AS ext, CASE WHEN page_id % 25 = 7 THEN '' ELSE concat({PICK.format(', '.join(map(repr, HEAD)))},
    hex(encode(CASE WHEN page_id % 10 = 0 THEN 'short file' ELSE html END))) END AS h FROM pages),
k AS (SELECT *, CASE WHEN h LIKE '52494646%' AND substr(h, 17, 8) = '57454250' THEN 'WebP' WHEN h LIKE '49492A00%' OR h LIKE '4D4D002A%' THEN 'TIFF'
  WHEN h LIKE '49492B00%' OR h LIKE '4D4D002B%' THEN 'BigTIFF' WHEN h LIKE '89504E470D0A1A0A%' THEN 'PNG' WHEN h LIKE 'FFD8FF%' THEN 'JPEG' WHEN h LIKE '424D%' THEN 'BMP' END AS container FROM f),
r AS (SELECT *, CASE WHEN ext = 'pdf' THEN 'unsupported extension' WHEN len(h) = 0 THEN 'empty file' WHEN len(h) < 64 THEN 'too small to be an image'
  WHEN len(h) / 2 > 60 * 1024 * 1024 THEN 'over the size limit' WHEN container IS NULL THEN 'contents are not an image'
  WHEN ext IN ('tif', 'tiff', 'geotiff') AND container NOT LIKE '%TIFF' THEN concat('named TIFF but contains ', container) END AS reason FROM k)
SELECT concat('/in/', page_id, '.', ext) AS path, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason, container FROM r""")
def s2(spark, sf_dir):
    return images.validate_files(file_rows(spark, sf_dir))


@query("s1_scan_images", with_px("""
SELECT CAST(s.scene_id AS VARCHAR) AS scene_id, CAST(i // 64 AS INT) AS r, CAST(i % 64 AS INT) AS c, p.r IS NOT NULL AS valid, round(coalesce(red, 0), 6) AS red,
  round(coalesce(green, 0), 6) AS green, round(coalesce(blue, 0), 6) AS blue
FROM (SELECT DISTINCT scene_id FROM px) s CROSS JOIN range(0, 4096) t(i) LEFT JOIN px p ON p.scene_id = s.scene_id AND p.r = i // 64 AND p.c = i % 64"""))
def s1(spark, sf_dir):
    """Scenes packed as the image source delivers them (64 x 64, BGRA), then scanned back to pixels."""
    px = pixels(spark, sf_dir)
    grid = densify(px.select("scene_id", "r", "c", "red", "green", "blue", F.lit(255).alias("a")), scenes(px).select("scene_id", "width", "height"),
                   {"red": 0.0, "green": 0.0, "blue": 0.0, "a": 0})
    cell = F.concat(*[F.lpad(F.hex(F.round(c * 255).cast("int")), 2, "0") for c in (F.col("blue"), F.col("green"), F.col("red"))], F.lpad(F.hex("a"), 2, "0"))
    packed = grid.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("r", "c", cell.alias("b")))).alias("cells"))
    decoded = packed.select(F.col("scene_id").cast("string").alias("path"), F.lit(64).alias("height"), F.lit(64).alias("width"), F.lit(4).alias("nChannels"),
                            F.unhex(F.array_join(F.transform("cells", lambda x: x["b"]), "")).alias("data"))
    return images.explode_images(decoded).select("scene_id", "r", "c", "valid", *[F.round(b, 6).alias(b) for b in ("red", "green", "blue")])


PLANTED = ("blue", "green", "red", "nir", "swir2", "sar")
BAND_COUNTS = (2, 5, 6)
#: Bands of a planted scene by their position, under the names that follow from their number.
FILE_ROWS = "fr AS (" + " UNION ALL ".join(
    f"SELECT scene_id, r, c, '{name}' AS band, {source} AS v FROM px WHERE scene_id % 3 = {i}"
    for i, n in enumerate(BAND_COUNTS) for name, source in zip(V.BAND_PRESETS[n], PLANTED, strict=False)) + ")"


def planted_tiffs(spark, sf_dir):
    """A folder with a 16-bit file of 2, 5 or 6 bands per scene, in strips or tiles, packed or plain; cells never observed are 0, the no-data value."""
    folder = f"{checkpoint_root(spark)}/tiff-{uuid.uuid4().hex}"

    def write(table):
        import numpy as np

        scene = table.column("scene_id")[0].as_py()
        n = BAND_COUNTS[scene % 3]
        cube = np.zeros((64, 64, n), np.uint16)
        at = (table.column("r").to_numpy(), table.column("c").to_numpy())
        for k, band in enumerate(PLANTED[:n]):
            cube[..., k][at] = np.rint(table.column(band).to_numpy() * 65535)
        tiled = scene % 2 == 0
        body = tiff.encode(cube, tile=32 if tiled else None, rows_per_strip=None if tiled else 12, deflate=scene % 5 < 3, predictor=scene % 5 < 2, planar=scene % 7 == 0, nodata=0)
        system, name = tiff.filesystem(folder)
        system.create_dir(name)
        with system.open_output_stream(f"{name}/{scene}.tif") as out:
            out.write(body)
        return table.slice(0, 1).select(["scene_id"])

    px = pixels(spark, sf_dir).select("scene_id", "r", "c", *PLANTED)
    px.groupBy("scene_id").applyInArrow(write, "scene_id bigint").write.format("noop").mode("overwrite").save()
    return folder


def named_bands(px):
    """(scene_id, r, c, …, band, v) of file pixels, bands named by their number and position.

    The presets are a few fixed rows, so they go to the pixels: by their keys all pixels would meet in one task a band.
    """
    scene = F.substring_index(F.substring_index("path", "/", -1), ".", 1).cast("bigint")
    long = px.select(scene.alias("scene_id"), "r", "c", "factor", F.size("values").alias("n_bands"), F.posexplode("values").alias("pos", "v"))
    return long.join(F.broadcast(bands.band_presets(px.sparkSession)), ["n_bands", "pos"]).withColumnRenamed("preset", "band")


@query("s1_scan_tiff", with_px("SELECT scene_id, r, c, band, round(v, 6) AS v FROM fr", FILE_ROWS))
def s1_tiff(spark, sf_dir):
    _, px = tiff.scan_tiff(spark, planted_tiffs(spark, sf_dir))
    return named_bands(px.where("valid")).select("scene_id", "r", "c", "band", F.round(F.col("v") / 65535, 6).alias("v"))


@query("s6_reduced_scan", with_px("SELECT scene_id, 3 AS factor, CAST(r // 3 AS INT) AS r, CAST(c // 3 AS INT) AS c, band, round(avg(v), 6) AS v FROM fr WHERE r // 3 < 21 AND c // 3 < 21 GROUP BY ALL",
                               FILE_ROWS))
def s6_reduced(spark, sf_dir):
    _, px = tiff.scan_tiff(spark, planted_tiffs(spark, sf_dir), max_side=22, split_bytes=1 << 16)
    return named_bands(px.where("valid")).select("scene_id", "factor", "r", "c", "band", F.round(F.col("v") / 65535, 6).alias("v"))


@query("s1_tiff_scenes", with_px("""SELECT DISTINCT scene_id, 64 AS width, 64 AS height, CAST([2, 5, 6][scene_id % 3 + 1] AS INT) AS n_bands, 'uint16' AS dtype, 'accepted' AS status FROM px"""))
def s1_scenes(spark, sf_dir):
    found, _ = tiff.scan_tiff(spark, planted_tiffs(spark, sf_dir))
    return found.select(F.regexp_extract("path", r"([^/]+)\.tif$", 1).cast("bigint").alias("scene_id"), "width", "height", "n_bands", "dtype", "status")


#: Facts of the fixture, and the trace of the events.
FACT_SQL = f"f AS ({duck(FACTS_SQL)})"

DESC = ["B2", "b03", " Red ", "near infrared", "swir1", "B12"]


@query("s3_map_bands", f"""
WITH d AS (SELECT p_partkey AS scene_id, CAST(i AS INT) AS pos, CAST(p_partkey % 7 + 1 AS INT) AS n_bands,
  CASE WHEN p_partkey % 5 = 0 AND i = 0 THEN 'mystery' ELSE {DESC}[i + 1] END AS description FROM part, range(0, 7) t(i) WHERE i < p_partkey % 7 + 1),
m AS (SELECT *, MAP {{{', '.join(repr(k) + ': ' + repr(v) for k, v in V.BAND_DESCRIPTIONS.items())}}}[lower(trim(coalesce(description, '')))] AS named FROM d),
a AS (SELECT scene_id, bool_and(named IS NOT NULL) AS every FROM m GROUP BY 1),
p(n, names) AS (VALUES {', '.join(f"({n}, {list(names)})" for n, names in V.BAND_PRESETS.items())})
SELECT scene_id, pos, CASE WHEN every THEN named ELSE coalesce(names[pos + 1], concat('band_', pos + 1)) END AS band,
  CASE WHEN every THEN 'file metadata' ELSE 'inferred from band count' END AS mapping_source FROM m JOIN a USING (scene_id) LEFT JOIN p ON n = n_bands""")
def s3(spark, sf_dir):
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select(k.alias("scene_id"), (k % 7 + 1).cast("int").alias("n_bands")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("n_bands") - 1)).alias("pos")).withColumn(
        "description", F.when((F.col("scene_id") % 5 == 0) & (F.col("pos") == 0), "mystery").otherwise(F.get(F.array(*map(F.lit, DESC)), F.col("pos"))))
    return bands.map_bands(d)


@query("s4_infer_modality", f"""
SELECT p_partkey, CASE WHEN regexp_matches(n, 'sar|s1|sentinel1|sentinel-1|risat|grd|rtc') OR list_has_any(bands, ['vv', 'vh', 'hh', 'hv']) THEN 'sar'
  WHEN len(bands) = 1 THEN 'derived' WHEN len(bands) >= 4 THEN 'multispectral' ELSE 'optical' END AS modality
FROM (SELECT b.*, lower(concat(p_name, CASE WHEN b.p_partkey % 9 = 0 THEN '_GRD.tif' ELSE '.png' END)) AS n FROM ({BANDS_SQL}) b JOIN part USING (p_partkey))""")
def s4(spark, sf_dir):
    b = band_lists(spark, sf_dir).select("p_partkey", "bands").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    name = F.concat("p_name", F.when(F.col("p_partkey") % 9 == 0, "_GRD.tif").otherwise(".png"))
    return b.select("p_partkey", scene_checks.infer_modality(name, F.col("bands")).alias("modality"))


RAW = ("raw AS (SELECT l_suppkey AS scene_id, l_orderkey, l_linenumber, b, v FROM (" + " UNION ALL ".join(
    f"SELECT l_suppkey, l_orderkey, l_linenumber, '{b}' AS b, CAST({e} AS DOUBLE) AS v FROM lineitem"
    for b, e in (("price", "l_extendedprice"), ("quantity", "l_quantity"), ("discount", "l_discount"), ("flat", "7.0"))) + "))")


@query("s5_normalise_bands", f"""
WITH {RAW}, s AS (SELECT scene_id, b, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.02) AS q2, quantile_cont(v, 0.98) AS q98 FROM raw GROUP BY ALL)
SELECT scene_id, l_orderkey, l_linenumber, b AS band, round(CASE WHEN lo >= 0 AND hi <= 255 AND hi > 1.5 THEN v / 255.0 WHEN q98 - q2 < 1e-9 THEN 0
  ELSE least(1.0, greatest(0.0, (v - q2) / (q98 - q2))) END, 6) AS scaled FROM raw JOIN s USING (scene_id, b)""")
def s5(spark, sf_dir):
    vals = {"price": F.col("l_extendedprice"), "quantity": F.col("l_quantity"), "discount": F.col("l_discount"), "flat": F.lit(7.0)}
    raw = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scene_id"), "l_orderkey", "l_linenumber", *[v.cast("double").alias(k) for k, v in vals.items()])
    return bands.normalise_bands(raw, ["scene_id"], list(vals)).select("scene_id", "l_orderkey", "l_linenumber", "band", F.round("scaled", 6).alias("scaled"))


@query("s6_decimate", with_px("""
SELECT scene_id, 3 AS factor, CAST(r // 3 AS INT) AS r, CAST(c // 3 AS INT) AS c, round(avg(nir), 6) AS nir, round(avg(red), 6) AS red FROM px
WHERE r // 3 < 64 // 3 AND c // 3 < 64 // 3 GROUP BY ALL"""))
def s6(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return bands.decimate(px, scenes(px), ["nir", "red"], 24).select("scene_id", "factor", "r", "c", F.round("nir", 6).alias("nir"), F.round("red", 6).alias("red"))


LAYER_VALUES = "ly(layer_key, layer_id, platform, res, start, i) AS (VALUES " + ", ".join(
    f"('{r[0]}', '{r[1]}', '{r[3]}', {r[5]}::DOUBLE, DATE '{r[8]}', {i})" for i, r in enumerate(V.LAYERS)) + ")"


@query("s9_fetch_manifest", f"""
WITH {LAYER_VALUES}, rq AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 360 - 180 + 0.123456::DOUBLE AS w, o_orderkey % 160 - 80 + 0.5::DOUBLE AS s, o_orderkey % 10 AS i FROM orders)
SELECT o_orderkey, concat('{V.WMS_URL}?SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&CRS=EPSG:4326&FORMAT=image/png&TRANSPARENT=TRUE&LAYERS=', layer_id,
  '&WIDTH=512&HEIGHT=512&BBOX=', s, ',', w, ',', s + 1.0, ',', w + 1.0, '&TIME=', d) AS url,
  left(sha1(concat('{{"bbox": [', round(w, 5), ', ', round(s, 5), ', ', round(w + 1.0, 5), ', ', round(s + 1.0, 5), '], "d": "', d, '", "layer": "', layer_id, '", "s": 512}}')), 20) AS cache_key
FROM rq JOIN ly USING (i)""")
def s9(spark, sf_dir):
    k = F.col("o_orderkey")
    w, s = k % 360 - 180 + 0.123456, k % 160 - 80 + 0.5
    keys = F.array(*[F.lit(r[0]) for r in V.LAYERS])
    rq = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.get(keys, (k % 10).cast("int")).alias("layer_key"), F.col("o_orderdate").cast("date").alias("acq_date"),
        w.alias("west"), s.alias("south"), (w + 1.0).alias("east"), (s + 1.0).alias("north"))
    return sinks.fetch_manifest(rq).select("o_orderkey", "url", "cache_key")


@query("s10_layer_catalog", f"""WITH {LAYER_VALUES} SELECT layer_key, platform, res AS resolution_m, count(*) AS requests, count(*) FILTER (CAST(o_orderdate AS DATE) + 3000 >= start) AS answerable
FROM orders JOIN ly ON i = o_orderkey % 10 GROUP BY ALL""")
def s10_layers(spark, sf_dir):
    keys = F.array(*[F.lit(r[0]) for r in V.LAYERS])
    rq = table(spark, sf_dir, "orders").select(F.get(keys, (F.col("o_orderkey") % 10).cast("int")).alias("layer_key"),
                                               F.date_add(F.col("o_orderdate").cast("date"), 3000).alias("d"))
    return rq.join(catalog.layer_catalog(spark), "layer_key").groupBy("layer_key", "platform", "resolution_m").agg(
        F.count("*").alias("requests"), F.count_if(F.col("d") >= F.col("start")).alias("answerable"))


PLACE_VALUES = "pv(name, west, south, east, north, kind, i) AS (VALUES " + ", ".join(
    f"('{p[0]}', {p[1]}::DOUBLE, {p[2]}::DOUBLE, {p[3]}::DOUBLE, {p[4]}::DOUBLE, '{p[5]}', {i})" for i, p in enumerate(V.PLACES)) + ")"


@query("s10_gazetteer", f"""WITH {PLACE_VALUES} SELECT name, kind, round({AREA}, 1) AS area_km2, count(*) AS customers FROM customer JOIN pv ON i = c_custkey % {len(V.PLACES)} GROUP BY ALL""")
def s10_places(spark, sf_dir):
    g = catalog.gazetteer(spark).select("ord", "name", "kind", "area_km2")
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") % len(V.PLACES)).cast("int").alias("ord")).join(g, "ord").groupBy(
        "name", "kind", "area_km2").agg(F.count("*").alias("customers"))


@query("s10_index_and_class_catalog", with_px(
    "SELECT k.class, label, cr, pixels, reads FROM (SELECT CASE truth WHEN 'water' THEN 'water' WHEN 'veg' THEN 'dense_vegetation' WHEN 'built' THEN 'built_up' WHEN 'bare' THEN 'bare_soil' ELSE 'cloud_or_snow' END AS class, count(*) AS pixels FROM px GROUP BY 1) k "
    "JOIN cv ON cv.class = k.class LEFT JOIN iv ON iv.class = k.class",
    "cv(class, label, cr) AS (VALUES " + ", ".join(f"('{k}', '{v}', {V.CLASS_COLORS[k][0]})" for k, v in V.CLASS_LABELS.items()) + ")",
    "iv(class, reads) AS (VALUES " + ", ".join(f"('{k}', '{V.INDEX_INFO[v][1]}')" for k, v in V.CLASS_TO_INDEX.items()) + ")"))
def s10_classes(spark, sf_dir):
    from .expression_queries import truth_class

    n = pixels(spark, sf_dir).groupBy(truth_class().alias("class")).agg(F.count("*").alias("pixels"))
    table_ = F.create_map(*[F.lit(x) for kv in V.CLASS_TO_INDEX.items() for x in kv])
    idx = catalog.index_catalog(spark).select("index_name", "reads")
    return n.join(catalog.class_catalog(spark), "class").withColumn("index_name", F.try_element_at(table_, F.col("class"))).join(
        idx, "index_name", "left").select("class", "label", "cr", "pixels", "reads")


@query("s11_scene_listing", with_px(f"""
SELECT scene_id, width, height, array_to_string(bands, ',') AS bands, CAST(len(bands) AS INT) AS band_count, valid_pixels, round_even(valid_pixels / (width * height), 4) AS valid_fraction, west IS NOT NULL AS georeferenced
FROM half JOIN (SELECT scene_id, list_sort(list_filter([CASE WHEN count(blue) > 0 THEN 'blue' END, CASE WHEN count(green) > 0 THEN 'green' END, CASE WHEN count(red) > 0 THEN 'red' END,
  CASE WHEN count(CASE WHEN yr % 2 = 0 THEN nir END) > 0 THEN 'nir' END, CASE WHEN count(swir2) > 0 THEN 'swir2' END], lambda x: x IS NOT NULL)) AS bands, count(*) AS valid_pixels FROM px GROUP BY 1) USING (scene_id)""", HALF_SQL))
def s11(spark, sf_dir):
    px = pixels(spark, sf_dir)
    out = catalog.scene_listing(half_located(scenes(px)), px.withColumn("nir", F.when(F.col("yr") % 2 == 0, F.col("nir"))), ["blue", "green", "red", "nir", "swir2"])
    return out.select("scene_id", "width", "height", F.array_join("bands", ",").alias("bands"), "band_count", "valid_pixels", "valid_fraction", "georeferenced")


@query("s13_geojson", with_px("""
SELECT scene_id, count(*) AS features, round(sum(area_km2), 3) AS area_km2, min(box_west) AS west FROM rg WHERE box_west IS NOT NULL GROUP BY 1""", CELLS, HALF_SQL,
                              *component_ctes("cells", "cc"), *region_ctes("cc", "rg", "half", min_pixels=8, top=6)))
def s13(spark, sf_dir):
    px = pixels(spark, sf_dir)
    regions = components.rank_regions(components.region_stats(components.connected_runs(built_cells(spark, sf_dir), KEY), KEY), KEY, 8, 6)
    doc = sinks.geojson(components.locate_regions(regions, half_located(scenes(px)), KEY), "Built-up")
    parsed = doc.select("scene_id", F.from_json("geojson", "features array<struct<properties:struct<area_km2:double>,geometry:struct<coordinates:array<array<array<double>>>>>>").alias("j"))
    f = parsed.select("scene_id", F.explode("j.features").alias("f"))
    return f.groupBy("scene_id").agg(F.count("*").alias("features"), F.round(F.sum("f.properties.area_km2"), 3).alias("area_km2"),
                                     F.min(F.col("f.geometry.coordinates")[0][0][0]).alias("west"))


EURO = list(V.EUROSAT_TO_COARSE)


@query("s15_sample_labelled_patches", f"""
WITH f AS (SELECT concat('/data/', {EURO + ['Cloud']}[vec_id % 11 + 1], '/', vec_id, '.jpg') AS path FROM embeddings)
SELECT path, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(path, '#42'))) AS n FROM (SELECT *, split_part(path, '/', 3) AS label FROM f))
WHERE n <= 20 AND label <> 'Cloud'""")
def s15(spark, sf_dir):
    names = F.array(*map(F.lit, EURO + ["Cloud"]))
    files = table(spark, sf_dir, "embeddings").select(F.concat(
        F.lit("/data/"), F.get(names, (F.col("vec_id") % 11).cast("int")), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("path"))
    return images.sample_labelled(files, 20, 42).select("path", "label")


@query("s14_request_records", f"""WITH {FACT_SQL}, {TRACE_SQL.replace("SELECT user_id", "SELECT event_id AS step, user_id")}, pr AS (SELECT request_id FROM f GROUP BY 1),
it AS (SELECT request_id, 1 AS section, step AS ord, tool AS name, CAST(duration_ms AS DOUBLE) AS value FROM tr SEMI JOIN pr USING (request_id)
  UNION ALL SELECT request_id, 3, ord, fact_key, value_num FROM f
  UNION ALL SELECT s_suppkey, 5, 0, concat('archive ', s_suppkey % 4), NULL FROM supplier SEMI JOIN pr ON request_id = s_suppkey)
SELECT request_id, section, ord, name, round(value, 6) AS value, ord <> min(ord) OVER (PARTITION BY request_id, section) AS follows FROM it
UNION ALL SELECT request_id, section, NULL, NULL, NULL, false FROM pr, unnest([0, 2, 4, 6, 7]) t(section)""")
def s14(spark, sf_dir):
    from .text_queries import fx_facts, fx_narrations, provenance, trace
    from skyframe.operators import grounding

    n = fx_narrations(spark, sf_dir).withColumn("narrator", F.lit("template"))
    f, pv = fx_facts(spark, sf_dir), provenance(spark, sf_dir).withColumn("ord", F.lit(0))
    pieces = sinks.record_pieces(n.select("request_id", "narrator"), trace(spark, sf_dir), f, pv, grounding.verify_narrations(n, f, provenance(spark, sf_dir)))
    item = F.when(F.col("section") % 2 == 1, F.regexp_replace("piece", "^,", ""))
    field = {k: F.get_json_object(item, f"$.{k}") for k in ("tool", "fact_key", "source", "duration_ms", "value_num")}
    inner = F.col("section").isin(1, 3, 5)
    return pieces.select("request_id", "section", "ord", F.when(inner, F.coalesce(field["tool"], field["fact_key"], field["source"])).alias("name"),
                         F.when(inner, F.round(F.coalesce(field["duration_ms"], field["value_num"]).cast("double"), 6)).alias("value"),
                         "follows")
