"""Manifests of archive requests, GeoJSON and per-request records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stats import attach

from .. import fixed_values as V
from .catalog import layer_catalog


def fetch_manifest(requests: DataFrame, size: int = 512) -> DataFrame:
    """Request URL and cache key of each (layer_key, west, south, east, north, acq_date)."""
    layers = layer_catalog(requests.sparkSession).select("layer_key", "layer_id")
    n = {c: F.col(c).cast("string") for c in ("west", "south", "east", "north")}
    day = F.col("acq_date").cast("string")
    url = F.concat(
        F.lit(f"{V.WMS_URL}?SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&CRS=EPSG:4326&FORMAT=image/png&TRANSPARENT=TRUE&LAYERS="),
        F.col("layer_id"), F.lit(f"&WIDTH={size}&HEIGHT={size}&BBOX="),
        F.concat_ws(",", n["south"], n["west"], n["north"], n["east"]), F.lit("&TIME="), day)
    box = F.concat_ws(", ", *[F.round(c, 5).cast("string") for c in ("west", "south", "east", "north")])
    blob = F.concat(F.lit('{"bbox": ['), box, F.lit('], "d": "'), day, F.lit('", "layer": "'), F.col("layer_id"), F.lit(f'", "s": {size}}}'))
    return requests.join(layers, "layer_key").withColumns({"url": url, "cache_key": F.substring(F.sha1(blob), 1, 20)})


def geojson(regions: DataFrame, label: str, by: str = "scene_id") -> DataFrame:
    """(scene_id, geojson): one feature collection per scene; regions without a position are left out.

    Regions are the ranked few per scene, so a collection is small by construction.
    """
    w, s, e, n = (F.col(c) for c in ("box_west", "box_south", "box_east", "box_north"))
    ring = F.array(F.array(w, s), F.array(e, s), F.array(e, n), F.array(w, n), F.array(w, s))
    direction = F.col("direction") if "direction" in regions.columns else F.lit(None).cast("string")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct("rank", F.lit(label).alias("label"), "area_km2", "pixels", direction.alias("direction"),
                 F.array("lon", "lat").alias("centroid")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    ranked = regions.where("box_west IS NOT NULL").groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("rank", feature.alias("f")))).alias("fs"))
    return ranked.select(by, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"),
                                                F.transform("fs", lambda x: x["f"]).alias("features"))).alias("geojson"))


def write_geojson(regions: DataFrame, label: str, path: str) -> None:
    geojson(regions, label).select("geojson").write.mode("overwrite").text(path)


def record_pieces(plans: DataFrame, trace: DataFrame, facts: DataFrame, provenance: DataFrame, grounding: DataFrame,
                  by: str = "request_id") -> DataFrame:
    """(by, section, ord, follows, piece): the nested record of every request as pieces of its JSON text, children in order.

    Joined in the order of these columns the pieces of a request are one JSON object with its plan, trace, facts, provenance and
    verdict (null without one). A child is a row, so nothing grows with the number of children, and every size has one layout.
    """
    children = [(trace, "step", "execution_trace"), (facts, "ord", "facts"), (provenance, "ord", "provenance")]
    requests = plans.select(by)
    none = F.lit(None).cast("bigint")

    def fixed(df: DataFrame, section: int, text: Column) -> DataFrame:
        return df.select(by, F.lit(section).alias("section"), none.alias("ord"), F.lit(False).alias("follows"), text.alias("piece"))

    plan = F.struct(by, F.struct(*[c for c in plans.columns if c != by]).alias("plan"))
    # the opening is the object of id and plan, left open
    opening = F.concat(F.expr("left(_json, length(_json) - 1)"), F.lit(f',"{children[0][2]}":['))
    out = fixed(plans.withColumn("_json", F.to_json(plan, {"ignoreNullFields": "false"})), 0, opening)
    for k, (df, order, _) in enumerate(children):
        named = df.select(by, F.col(order).cast("bigint").alias("ord"), F.to_json(F.struct(order, *[c for c in df.columns if c not in (by, order)]), {"ignoreNullFields": "false"}).alias("piece"))
        # equal children are one row with their number until the first child of each request is known
        mine = attach(named, requests, [by]).groupBy(by, "ord", "piece").agg(F.count("*").alias("_n"))
        place = F.struct(F.coalesce("ord", F.lit(-(2**63))), "piece")
        first = mine.groupBy(by).agg(F.min(place).alias("_first"))
        single = attach(mine, first, [by]).select(by, "ord", "piece", (place == F.col("_first")).alias("_leads"), F.explode(F.sequence(F.lit(1), "_n")).alias("_copy"))
        follows = ~(F.col("_leads") & (F.col("_copy") == 1))
        out = out.unionByName(single.select(by, F.lit(2 * k + 1).alias("section"), "ord", follows.alias("follows"), F.when(follows, F.concat(F.lit(","), "piece")).otherwise(F.col("piece")).alias("piece")))
        closing = f'],"{children[k + 1][2]}":[' if k + 1 < len(children) else '],"grounding":'
        out = out.unionByName(fixed(requests, 2 * k + 2, F.lit(closing)))
    verdict = requests.join(grounding.select(by, F.to_json(F.struct(*[c for c in grounding.columns if c != by]), {"ignoreNullFields": "false"}).alias("_json")), by, "left")
    return out.unionByName(fixed(verdict, 2 * len(children) + 1, F.concat(F.coalesce("_json", F.lit("null")), F.lit("}"))))


def write_records(pieces: DataFrame, path: str, by: str = "request_id") -> None:
    """Pieces in order over the part files of a folder: one JSON object after the other, each over as many lines as it has pieces."""
    order = [by, "section", F.col("ord").asc_nulls_first(), "follows", "piece"]
    width = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces.repartitionByRange(width, *order).sortWithinPartitions(*order).select("piece").write.mode("overwrite").text(path)


def write_facts(facts: DataFrame, path: str, partition: str = "tool") -> None:
    facts.write.mode("overwrite").partitionBy(partition).parquet(path)
