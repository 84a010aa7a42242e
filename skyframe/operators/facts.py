"""Fact tables: (request_id, ord, fact_key, label, value_num, value_str, unit, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.geo import bbox_area_km2, pixel_area_km2
from ..functions.numbers import half_even

REQ = "request_id"


def last_write_wins(facts: DataFrame) -> DataFrame:
    """One row per (request, key): the latest value at the position of the first."""
    others = [c for c in facts.columns if c not in (REQ, "fact_key", "ord")]
    return facts.groupBy(REQ, "fact_key").agg(
        F.min("ord").alias("ord"), F.max_by(F.struct(*others), "ord").alias("_v")).select(REQ, "ord", "fact_key", "_v.*")


def dedupe_provenance(provenance: DataFrame) -> DataFrame:
    """First record of each (request, source, acquisition date)."""
    others = [c for c in provenance.columns if c not in (REQ, "source", "acquisition_date")]
    return provenance.groupBy(REQ, "source", "acquisition_date").agg(
        F.min_by(F.struct(*others), "ord").alias("_v")).select(REQ, "source", "acquisition_date", "_v.*")


def workload_summary(trace: DataFrame) -> DataFrame:
    """Per request: calls by status, total time, mean confidence of what worked."""
    ok = F.col("status") == "ok"
    return trace.groupBy(REQ).agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "no_data", "error", "skipped")],
        F.sum("duration_ms").alias("total_ms"), half_even(F.avg(F.when(ok, F.col("confidence"))), 3).alias("confidence"),
        F.when(F.count_if(ok) == 0, "no_data").otherwise("ok").alias("status"))


def _filled(text: str | None) -> Column:
    """A text whose {column} placeholders are filled from the row."""
    if text is None:
        return F.lit(None).cast("string")
    pieces, rest = [], text
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [F.lit(head), F.col(name).cast("string")]
    return F.concat(*pieces, F.lit(rest))


def to_facts(stats: DataFrame, spec: list[tuple], tool: str, by: str = REQ, extra: dict[str, Column] | None = None) -> DataFrame:
    """Wide measurement rows to fact rows.

    ``spec`` rows are (value column, key, label, unit, method); key, label and method
    may hold {column} placeholders filled from the same row. NULL values give no fact.
    """
    rows = F.array(*[
        F.struct(F.lit(i).alias("ord"), _filled(key).alias("fact_key"), _filled(label).alias("label"),
                 half_even(F.col(col).cast("double"), 6).alias("value_num"), F.lit(unit).cast("string").alias("unit"),
                 _filled(method).alias("method"))
        for i, (col, key, label, unit, method) in enumerate(spec)])
    keep = list((extra or {}))
    return stats.withColumns(extra or {}).select(by, *[c for c in keep if c != by], F.inline(rows)).where(
        "value_num IS NOT NULL").withColumn("tool", F.lit(tool))


def to_text_facts(stats: DataFrame, spec: list[tuple], tool: str, by: str = REQ) -> DataFrame:
    """Fact rows whose value is a text; ``spec`` rows are (text column, key, label, method). NULL texts give no fact."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("ord"), _filled(key).alias("fact_key"), _filled(label).alias("label"), F.lit(None).cast("double").alias("value_num"),
                 F.col(col).cast("string").alias("value_str"), F.lit(None).cast("string").alias("unit"), _filled(method).alias("method"))
        for i, (col, key, label, method) in enumerate(spec)])
    return stats.select(by, F.inline(rows)).where("value_str IS NOT NULL").withColumn("tool", F.lit(tool))


def geometry_facts(scenes: DataFrame) -> DataFrame:
    """Grid size, scene count and areas of each request, from its scenes."""
    per = scenes.groupBy(REQ).agg(
        F.max("width").alias("width"), F.max("height").alias("height"), F.count("*").alias("scene_count"),
        *[F.first(c, ignorenulls=True).alias(c) for c in ("west", "south", "east", "north")])
    per = per.withColumns({"area": half_even(bbox_area_km2(), 2), "px_area": half_even(pixel_area_km2(), 8)})
    method = "scene area / ({width} x {height}) pixels"
    facts = to_facts(per, [
        ("width", "raster_width", "Raster width", "pixels", "width of the analysis grid"),
        ("height", "raster_height", "Raster height", "pixels", "height of the analysis grid"),
        ("scene_count", "scene_count", "Scenes retrieved", "scenes", "number of rasters of this request"),
        ("area", "scene_area_km2", "Analysed area", "km2", "area of the bounding box"),
        ("px_area", "pixel_area_km2", "Ground area per pixel", "km2", method)], "data_acquisition")
    return facts


def first_facts(facts: DataFrame, limit: int = 60) -> DataFrame:
    """The first facts of each request, in publication order."""
    return facts.selectExpr("*", f"row_number() OVER (PARTITION BY {REQ} ORDER BY ord) AS _n").where(
        F.col("_n") <= limit).drop("_n")


def class_rows(facts: DataFrame, suffix: str) -> DataFrame:
    """Facts named <class><suffix> as (request_id, class, value); classes in catalogue order."""
    wanted = {c + suffix: c for c in V.CLASS_LABELS}
    names = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    return facts.where(F.col("fact_key").isin(*wanted)).select(
        REQ, F.element_at(names, F.col("fact_key")).alias("class"), F.col("value_num").alias("value"))


def _class_order() -> Column:
    return F.array_position(F.array(*map(F.lit, V.CLASS_LABELS)), F.col("class"))


def top_classes(facts: DataFrame, above: float = 0.02, limit: int = 4) -> DataFrame:
    rows = class_rows(facts, "_fraction").where(F.col("value") > above).withColumn("_o", _class_order())
    return rows.selectExpr(REQ, "class", "value", f"row_number() OVER (PARTITION BY {REQ} ORDER BY value DESC, _o) AS rank").where(
        F.col("rank") <= limit)


def top_movers(facts: DataFrame, above: float = 0.01, limit: int = 3) -> DataFrame:
    rows = class_rows(facts, "_delta_area_km2").where(F.abs("value") > above)
    return rows.selectExpr(REQ, "class", "value", f"row_number() OVER (PARTITION BY {REQ} ORDER BY abs(value) DESC, class DESC) AS rank").where(
        F.col("rank") <= limit)


def pick_scene(scenes: DataFrame, preference=V.ROLE_PREFERENCE) -> DataFrame:
    """The scene whose role is most preferred, per request."""
    order = F.array_position(F.array(*map(F.lit, preference)), F.col("role"))
    others = [c for c in scenes.columns if c != REQ]
    return scenes.where(F.col("role").isin(*preference)).groupBy(REQ).agg(
        F.min_by(F.struct(*others), order).alias("_v")).select(REQ, "_v.*")


def fact_columns(facts: DataFrame, keys: list[str], texts: tuple[str, ...] = ()) -> DataFrame:
    """(request_id, nums, texts): the latest value of each wanted fact, as fields of two structs.

    Facts are first reduced to one row per (request, key), combining before the shuffle; ``keys`` is a fixed
    vocabulary, so a row stays small however many rows one request has. Numbers are aggregated apart from the
    few texts, which only a sort could aggregate. Structs keep the joins that follow narrow: code for a
    hundred columns is too long to be compiled.
    """

    def latest(names: list[str], value: str, out: str) -> DataFrame:
        at = F.array_position(F.array(*map(F.lit, names)), F.col("fact_key")).cast("int").alias("_at")
        single = facts.where(F.col("fact_key").isin(*names)).select(REQ, "ord", value, at).groupBy(REQ, "_at").agg(F.max_by(value, "ord").alias("_v"))
        return single.groupBy(REQ).agg(F.struct(*[F.max(F.when(F.col("_at") == i, F.col("_v"))).alias(k) for i, k in enumerate(names, 1)]).alias(out))

    numbers = latest(list(keys), "value_num", "nums")
    return numbers.join(latest(list(texts), "value_str", "texts"), REQ, "full") if texts else numbers


# ------------------------------------------------------------------- parameters
def param_rules(spark: SparkSession) -> DataFrame:
    rows = [(*r[:6], list(r[6]) if r[6] else None) for r in V.PARAM_RULES]
    return spark.createDataFrame(rows, "tool string, param string, kind string, preset string, low double, high double, choices array<string>")


def validate_parameters(requested: DataFrame, rules: DataFrame) -> DataFrame:
    """(request_id, tool, param, value, note): coerced, clamped and completed parameters.

    Input values are text, lists comma-separated. Rejected rows keep their note with
    a NULL value; presets fill what is missing.
    """
    v, kind = F.col("value"), F.col("kind")
    number = F.when(kind == "int", v.try_cast("bigint").cast("double")).when(kind == "float", v.try_cast("double"))
    listed = F.split(v, ",")
    kept = F.filter(listed, lambda x: F.array_contains(F.col("choices"), x))
    bounded = F.greatest(F.least(number, F.coalesce("high", number)), F.coalesce("low", number))
    shown = F.when(kind == "int", bounded.cast("bigint").cast("string")).when(kind == "float", bounded.cast("string"))
    bad_type = kind.isin("int", "float") & number.isNull() | (kind == "bool") & v.try_cast("boolean").isNull()
    off_list = (kind != "list") & F.col("choices").isNotNull() & ~F.array_contains("choices", v)
    note = (
        F.when(kind.isNull(), "rejected: not permitted").when(bad_type, F.concat(F.lit("rejected: cannot coerce to "), kind))
        .when(off_list, "rejected: not a permitted choice")
        .when((kind == "list") & (F.size(kept) < F.size(listed)), "clamped: dropped values outside the permitted choices")
        .when(number < F.col("low"), "clamped: below minimum").when(number > F.col("high"), "clamped: above maximum"))
    clean = requested.join(rules, ["tool", "param"], "left").withColumn("note", note).select(
        REQ, "tool", "param",
        F.when(F.coalesce(F.startswith(F.col("note"), F.lit("rejected")), F.lit(False)), F.lit(None)).when(
            kind == "list", F.array_join(kept, ",")).when(kind.isin("int", "float"), shown).otherwise(v).alias("value"), "note")
    presets = requested.select(REQ, "tool").distinct().join(rules.where("preset IS NOT NULL"), "tool").select(
        REQ, "tool", "param", F.col("preset").alias("value"), F.lit("default").alias("note"))
    missing = presets.join(clean.where("value IS NOT NULL"), [REQ, "tool", "param"], "left_anti")
    return clean.unionByName(missing)
