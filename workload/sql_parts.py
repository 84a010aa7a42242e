"""SQL building blocks shared by the DuckDB oracles."""

from __future__ import annotations


def otsu_ctes(name: str, source: str, keys: str, v: str = "v") -> list[str]:
    """CTEs ending in ``name``(keys, threshold, eta, n)."""
    return [
        f"""{name}_span AS (SELECT {keys}, min({v}) AS lo, max({v}) AS hi, count(*) AS n, var_pop({v}) AS var
            FROM {source} WHERE {v} IS NOT NULL GROUP BY {keys})""",
        f"""{name}_bins AS (SELECT {keys}, CAST(CASE WHEN hi - lo < 1e-9 THEN 0
              ELSE least(floor(({v} - lo) / (hi - lo) * 256), 255) END AS BIGINT) AS bin, count(*) AS cnt
            FROM {source} JOIN {name}_span USING ({keys}) WHERE {v} IS NOT NULL GROUP BY ALL)""",
        f"""{name}_cum AS (SELECT {keys}, bin,
              CAST(sum(cnt) OVER (PARTITION BY {keys} ORDER BY bin) AS DOUBLE) AS n0,
              CAST(sum(cnt * (2 * bin + 1)) OVER (PARTITION BY {keys} ORDER BY bin) AS DOUBLE) AS s0,
              CAST(sum(cnt) OVER (PARTITION BY {keys}) AS DOUBLE) AS na,
              CAST(sum(cnt * (2 * bin + 1)) OVER (PARTITION BY {keys}) AS DOUBLE) AS sa
            FROM {name}_bins)""",
        f"""{name}_score AS (SELECT {keys}, bin, CASE WHEN na > n0
              THEN (n0 / na) * ((na - n0) / na) * pow(s0 / n0 - (sa - s0) / (na - n0), 2) ELSE 0.0 END AS score
            FROM {name}_cum)""",
        f"""{name}_pick AS (SELECT * FROM {name}_score
              QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, bin) = 1)""",
        f"""{name}_small AS (SELECT {keys}, median({v}) AS med FROM {source} WHERE {v} IS NOT NULL GROUP BY {keys})""",
        f"""{name} AS (SELECT {keys},
              CASE WHEN n < 16 THEN med WHEN hi - lo < 1e-9 THEN lo ELSE lo + (bin + 0.5) * ((hi - lo) / 256) END AS threshold,
              CASE WHEN n < 16 OR hi - lo < 1e-9 THEN 0.0 WHEN var > 1e-12
                   THEN least(1.0, greatest(0.0, score * pow((hi - lo) / 512, 2) / var)) ELSE 0.0 END AS eta, n
            FROM {name}_span JOIN {name}_pick USING ({keys}) JOIN {name}_small USING ({keys}))""",
    ]


NDVI = "(nir - red) / greatest(nir + red, 1e-6)"
NDWI = "(green - nir) / greatest(green + nir, 1e-6)"
MNDWI = "(green - swir2) / greatest(green + swir2, 1e-6)"
NBR = "(nir - swir2) / greatest(nir + swir2, 1e-6)"
NDBI = "(swir2 - nir) / greatest(swir2 + nir, 1e-6)"
BSI = "((swir2 + red) - (nir + blue)) / greatest((swir2 + red) + (nir + blue), 1e-6)"
VARI = ("(green - red) / CASE WHEN abs(green + red - blue) < 1e-6 THEN 1e-6 ELSE green + red - blue END")
INDEX_SQL = {"NDVI": NDVI, "NDWI": NDWI, "MNDWI": MNDWI, "NBR": NBR, "NDBI": NDBI, "BSI": BSI, "VARI": VARI}


def landcover_ctes(source: str = "px", out: str = "lc") -> list[str]:
    """Multispectral segmentation of ``source`` as CTEs; ends in ``out`` and ``{out}_cuts``."""
    p = out
    return [
        f"""{p}_in AS (SELECT *, {NDVI} AS ndvi, {NDBI} AS ndbi, {MNDWI} AS widx, (red + green + blue) / 3.0 AS bright
            FROM {source})""",
        f"{p}_l AS (SELECT *, (bright > 0.82 AND ndvi < 0.25) AS cloud FROM {p}_in)",
        f"{p}_ws AS (SELECT scene_id, widx AS v FROM {p}_l)",
        *otsu_ctes(f"{p}_w", f"{p}_ws", "scene_id"),
        f"{p}_ns AS (SELECT scene_id, nir AS v FROM {p}_l WHERE NOT cloud)",
        *otsu_ctes(f"{p}_n", f"{p}_ns", "scene_id"),
        f"{p}_p35 AS (SELECT scene_id, quantile_cont(v, 0.35) AS p35 FROM {p}_ns GROUP BY 1)",
        f"""{p}_c1 AS (SELECT w.scene_id, CASE WHEN w.eta < 0.75 THEN 0.10 ELSE least(0.45, greatest(0.02, w.threshold)) END AS t_water,
              w.eta AS eta_water, CASE WHEN n.eta < 0.75 THEN p35 ELSE n.threshold END AS nir_cut, n.eta AS nir_eta, w.n AS n_valid
            FROM {p}_w w LEFT JOIN {p}_n n USING (scene_id) LEFT JOIN {p}_p35 USING (scene_id))""",
        f"""{p}_s AS (SELECT l.*, c.t_water, c.nir_cut, (NOT cloud AND widx > t_water AND ndvi < 0.20 AND coalesce(nir < nir_cut, false)) AS water
            FROM {p}_l l JOIN {p}_c1 c USING (scene_id))""",
        f"{p}_ls AS (SELECT scene_id, ndvi AS v FROM {p}_s WHERE NOT cloud AND NOT water)",
        *otsu_ctes(f"{p}_v", f"{p}_ls", "scene_id"),
        f"""{p}_c2 AS (SELECT scene_id, CASE WHEN n > 256 THEN least(0.40, greatest(0.04, threshold)) ELSE 0.15 END AS t_veg,
              n > 256 AS split_veg FROM {p}_v)""",
        f"""{p}_cov AS (SELECT s.*, t_veg, split_veg FROM {p}_s s JOIN {p}_c2 USING (scene_id) WHERE NOT cloud AND NOT water)""",
        f"{p}_ds AS (SELECT scene_id, ndvi AS v FROM {p}_cov WHERE split_veg AND ndvi >= t_veg)",
        *otsu_ctes(f"{p}_d", f"{p}_ds", "scene_id"),
        f"{p}_bs AS (SELECT scene_id, ndbi AS v FROM {p}_cov WHERE ndvi < t_veg)",
        *otsu_ctes(f"{p}_b", f"{p}_bs", "scene_id"),
        f"""{p}_c3 AS (SELECT c2.*, CASE WHEN NOT split_veg THEN 0.35 WHEN d.n > 128 THEN least(0.75, greatest(t_veg + 0.02, d.threshold))
                ELSE t_veg + 0.10 END AS t_dense,
              CASE WHEN b.n > 256 THEN least(0.45, greatest(-0.05, b.threshold)) END AS t_built,
              CASE WHEN b.n > 256 THEN b.eta END AS eta_built
            FROM {p}_c2 c2 LEFT JOIN {p}_d d USING (scene_id) LEFT JOIN {p}_b b USING (scene_id))""",
        f"""{p}_gap AS (SELECT scene_id, coalesce(avg(v) FILTER (v >= t_built) - avg(v) FILTER (v < t_built), 0.0) AS gap_built
            FROM {p}_bs JOIN {p}_c3 USING (scene_id) WHERE t_built IS NOT NULL GROUP BY 1)""",
        f"""{p}_cuts AS (SELECT c1.*, t_veg, t_dense, t_built, eta_built, gap_built,
              coalesce(eta_built >= 0.82 AND gap_built >= 0.18, false) AS split_built
            FROM {p}_c1 c1 LEFT JOIN {p}_c3 USING (scene_id) LEFT JOIN {p}_gap USING (scene_id))""",
        f"""{p} AS (SELECT s.* EXCLUDE (t_water, nir_cut), CASE WHEN cloud THEN 'cloud_or_snow' WHEN water THEN 'water'
              WHEN ndvi >= t_dense THEN 'dense_vegetation' WHEN ndvi >= t_veg THEN 'sparse_vegetation'
              WHEN split_built AND ndbi >= t_built THEN 'built_up' ELSE 'bare_soil' END AS class
            FROM {p}_s s JOIN {p}_cuts USING (scene_id))""",
    ]


def rgb_ctes(source: str = "px", out: str = "rgb") -> list[str]:
    """Visible-only segmentation as CTEs; ends in ``out`` and ``{out}_cuts``."""
    p = out
    return [
        f"""{p}_in AS (SELECT scene_id, r, c, blue, green, red, (red + green + blue) / 3.0 AS bright,
              (greatest(red, green, blue) - least(red, green, blue)) / greatest(red, green, blue, 1e-6) AS sat,
              (blue - red) / greatest(blue + red, 1e-6) AS blueness, {VARI} AS vari FROM {source})""",
        f"{p}_l AS (SELECT *, (bright > 0.85 AND sat < 0.15) AS cloud FROM {p}_in)",
        f"{p}_ws AS (SELECT scene_id, blueness AS v FROM {p}_l WHERE NOT cloud)",
        *otsu_ctes(f"{p}_w", f"{p}_ws", "scene_id"),
        f"{p}_p45 AS (SELECT scene_id, quantile_cont(bright, 0.45) AS dark_cut FROM {p}_l WHERE NOT cloud GROUP BY 1)",
        f"""{p}_c1 AS (SELECT w.scene_id, CASE WHEN eta < 0.75 THEN 0.12 ELSE least(0.45, greatest(0.02, threshold)) END AS t_water,
              eta AS eta_water, dark_cut FROM {p}_w w JOIN {p}_p45 USING (scene_id))""",
        f"""{p}_s AS (SELECT l.*, (NOT cloud AND blueness > t_water AND bright < dark_cut) AS water
            FROM {p}_l l JOIN {p}_c1 USING (scene_id))""",
        f"{p}_ls AS (SELECT scene_id, vari AS v FROM {p}_s WHERE NOT cloud AND NOT water)",
        *otsu_ctes(f"{p}_v", f"{p}_ls", "scene_id"),
        f"""{p}_c2 AS (SELECT scene_id, CASE WHEN n > 256 THEN least(0.45, greatest(0.02, threshold)) ELSE 0.05 END AS t_veg,
              n > 256 AS split_veg FROM {p}_v)""",
        f"{p}_cov AS (SELECT s.*, t_veg, split_veg FROM {p}_s s JOIN {p}_c2 USING (scene_id) WHERE NOT cloud AND NOT water)",
        f"{p}_ds AS (SELECT scene_id, vari AS v FROM {p}_cov WHERE split_veg AND vari >= t_veg)",
        *otsu_ctes(f"{p}_d", f"{p}_ds", "scene_id"),
        f"{p}_bs AS (SELECT scene_id, bright AS v FROM {p}_cov WHERE vari < t_veg)",
        *otsu_ctes(f"{p}_b", f"{p}_bs", "scene_id"),
        f"""{p}_c3 AS (SELECT c2.*, CASE WHEN NOT split_veg THEN 0.20 WHEN d.n > 128 THEN least(0.8, greatest(t_veg + 0.02, d.threshold))
                ELSE t_veg + 0.10 END AS t_dense, CASE WHEN b.n > 256 THEN b.threshold END AS t_built,
              CASE WHEN b.n > 256 THEN b.eta END AS eta_built
            FROM {p}_c2 c2 LEFT JOIN {p}_d d USING (scene_id) LEFT JOIN {p}_b b USING (scene_id))""",
        f"""{p}_gap AS (SELECT scene_id, coalesce(avg(v) FILTER (v >= t_built) - avg(v) FILTER (v < t_built), 0.0) AS gap_built
            FROM {p}_bs JOIN {p}_c3 USING (scene_id) WHERE t_built IS NOT NULL GROUP BY 1)""",
        f"""{p}_cuts AS (SELECT c1.*, t_veg, t_dense, t_built, eta_built, gap_built,
              coalesce(eta_built >= 0.75 AND gap_built >= 0.08, false) AS split_built
            FROM {p}_c1 c1 LEFT JOIN {p}_c3 USING (scene_id) LEFT JOIN {p}_gap USING (scene_id))""",
        f"""{p} AS (SELECT s.*, CASE WHEN cloud THEN 'cloud_or_snow' WHEN water THEN 'water'
              WHEN vari >= t_dense THEN 'dense_vegetation' WHEN vari >= t_veg THEN 'sparse_vegetation'
              WHEN split_built AND bright >= t_built THEN 'built_up' ELSE 'bare_soil' END AS class
            FROM {p}_s s JOIN {p}_cuts USING (scene_id))""",
    ]


def grid_ctes(source: str, value: str, fill: str = "0.0", key: str = "scene_id", side: int = 64, out: str = "grid") -> list[str]:
    """Dense side x side grid per key with gray and valid."""
    return [f"""{out} AS (SELECT s.{key}, r.r, c.c, coalesce(p.{value}, {fill}) AS gray, p.{value} IS NOT NULL AS valid
      FROM (SELECT DISTINCT {key} FROM {source}) s CROSS JOIN (SELECT CAST(i AS INT) AS r FROM range({side}) t(i)) r
      CROSS JOIN (SELECT CAST(i AS INT) AS c FROM range({side}) t(i)) c LEFT JOIN {source} p ON p.{key} = s.{key} AND p.r = r.r AND p.c = c.c)"""]


def box_ctes(out: str, source: str, value: str, k: int, edge: str, key: str = "scene_id", side: int = 64) -> list[str]:
    """``out``({key}, r, c, s, q): box sums of value and its square with mirrored edges."""
    h = k // 2
    lo, hi = ("-1 - x", f"{2 * side - 1} - x") if edge == "symmetric" else ("0 - x", f"{2 * side - 2} - x")
    mapped = f"SELECT i, CASE WHEN x < 0 THEN {lo} WHEN x >= {side} THEN {hi} ELSE x END AS j FROM (SELECT i, i + d AS x FROM range({side}) a(i) CROSS JOIN range({-h}, {h + 1}) b(d))"
    return [
        f"{out}_m AS ({mapped})",
        f"{out}_v AS (SELECT g.{key}, m.i AS r, g.c, sum({value}) AS s, sum({value} * {value}) AS q FROM {source} g JOIN {out}_m m ON m.j = g.r GROUP BY ALL)",
        f"{out} AS (SELECT g.{key}, g.r, m.i AS c, sum(s) AS s, sum(q) AS q FROM {out}_v g JOIN {out}_m m ON m.j = g.c GROUP BY ALL)",
    ]


def morph_ctes(source: str, out: str, key: str = "scene_id") -> list[str]:
    """Closing then opening with a 3 x 3 square of boolean m on a dense grid, step by step."""
    def step(name: str, src: str, test: str) -> str:
        return f"""{name} AS (SELECT a.{key}, a.r, a.c, {test} AS m FROM {src} a JOIN {src} b ON b.{key} = a.{key}
          AND b.r IN (a.r - 1, a.r, a.r + 1) AND b.c IN (a.c - 1, a.c, a.c + 1) GROUP BY ALL)"""

    grow, shrink = "bool_or(b.m)", "count(*) FILTER (b.m) = 9"
    return [step(f"{out}_1", source, grow), step(f"{out}_2", f"{out}_1", shrink), step(f"{out}_3", f"{out}_2", shrink),
            step(out, f"{out}_3", grow)]


def component_ctes(cells: str, out: str, key: str = "scene_id") -> list[str]:
    """``out``(key, r, c0, c1, node, component): 8-connected runs by transitive closure."""
    return [
        f"""{out}_runs AS (SELECT {key}, r, min(c) AS c0, max(c) AS c1, CAST(r AS BIGINT) * 4294967296 + min(c) AS node FROM (
          SELECT {key}, r, c, c - row_number() OVER (PARTITION BY {key}, r ORDER BY c) AS g FROM {cells}) GROUP BY {key}, r, g)""",
        f"""{out}_adj AS (SELECT a.{key}, a.node AS x, b.node AS y FROM {out}_runs a JOIN {out}_runs b ON a.{key} = b.{key}
          AND abs(a.r - b.r) = 1 AND a.c0 <= b.c1 + 1 AND a.c1 >= b.c0 - 1)""",
        f"""{out}_reach AS (SELECT {key}, node AS x, node AS y FROM {out}_runs UNION
          SELECT {out}_reach.{key}, {out}_reach.x, j.y FROM {out}_reach JOIN {out}_adj j ON j.{key} = {out}_reach.{key} AND j.x = {out}_reach.y)""",
        f"""{out} AS (SELECT runs.*, component FROM {out}_runs runs JOIN (SELECT {key}, x AS node, min(y) AS component FROM {out}_reach GROUP BY 1, 2)
          USING ({key}, node))""",
    ]


def region_ctes(runs: str, out: str, scenes: str, key: str = "scene_id", min_pixels: int = 30, top: int = 8) -> list[str]:
    """Ranked, located regions; ``scenes`` has key, width, height, west, south, east, north."""
    return [
        f"""{out}_all AS (SELECT {key}, component, CAST(sum(c1 - c0 + 1) AS BIGINT) AS pixels, min(r) AS r0, max(r) AS r1, min(c0) AS c0, max(c1) AS c1,
          sum((c1 - c0 + 1) * r) / sum(c1 - c0 + 1) AS cy, sum((c1 - c0 + 1) * (c0 + c1)) / sum(c1 - c0 + 1) / 2 AS cx FROM {runs} GROUP BY ALL)""",
        f"""{out} AS (SELECT {key}, CAST(rank AS INT) AS rank, component, pixels, r0, r1, c0, c1, round_even(cx, 1) AS cx, round_even(cy, 1) AS cy,
          round_even(pixels / ((r1 - r0 + 1) * (c1 - c0 + 1)), 4) AS fill_ratio, round_even(pixels / (width * height), 6) AS fraction_of_scene,
          round_even(pixels * (abs((north - south) * 110.574 * (east - west) * 111.320 * cos(radians((south + north) / 2.0))) / (width * height)), 4) AS area_km2,
          CASE WHEN west IS NULL THEN 'pixels' ELSE 'km2' END AS unit,
          round_even(west + (c0 + 0.5) / width * (east - west), 5) AS box_west, round_even(north - (r1 + 0.5) / height * (north - south), 5) AS box_south,
          round_even(west + (c1 + 0.5) / width * (east - west), 5) AS box_east, round_even(north - (r0 + 0.5) / height * (north - south), 5) AS box_north,
          round_even(west + (cx + 0.5) / width * (east - west), 5) AS lon, round_even(north - (cy + 0.5) / height * (north - south), 5) AS lat
          FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY pixels DESC, component) AS rank FROM {out}_all WHERE pixels >= {min_pixels})
          JOIN {scenes} USING ({key}) WHERE rank <= {top})""",
    ]
