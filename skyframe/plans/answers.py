"""Prose from facts: answers, captions, narrations and digests (J15, C12-C14, C16).

Facts reach a request as fields, one for each key its text can use; every sentence is
then an expression over the request's own row. A sentence whose facts are missing is
NULL and drops out of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.numbers import half_even
from ..functions.text import format_fact, sentence_list
from ..operators.facts import REQ, fact_columns, top_classes
from ..session import materialise

def _each(*suffixes: str) -> list[str]:
    return [f"{c}_{s}" for c in V.CLASS_LABELS for s in suffixes]


def _spread(*names: str) -> list[str]:
    return [f"{n}_{s}" for n in names for s in ("mean", "p10", "p90")]


# the facts that each text reads
ANSWER_KEYS = [*_each("delta_area_km2", "relative_change_pct", "fraction_before", "fraction_after"), "change_fraction"]
CAPTION_KEYS = [*_each("fraction"), *_spread("ndvi", "mndwi", "nbr", "ndbi"), "scene_area_km2", "rs_dominant_fraction", "rs_tiles", "rs_mean_confidence",
                "sar_water_fraction", "change_fraction"]
NARRATION_KEYS = [
    *_each("fraction", "delta_area_km2", "relative_change_pct"), *_spread("ndvi", "mndwi", "nbr", "ndbi"),
    *[f"d{n}_{s}" for n in ("ndvi", "mndwi", "nbr") for s in ("mean", "before", "after")], "scene_area_km2", "change_fraction", "change_area_km2", "change_threshold",
    "coobserved_fraction", "fusion_iou", "fusion_optical_water_fraction", "fusion_sar_water_fraction", "fusion_water_fraction", "fusion_cloud_recovered_pixels",
    "fusion_cloud_recovered_km2", "ts_observations", "ts_first", "ts_last", "ts_net_change", "ts_slope_per_year", "ts_r2", "rs_dominant_fraction",
    "rs_model_test_accuracy", "sar_water_fraction"]
DIGEST_KEYS = [
    *_each("fraction", "delta_area_km2"), *[f"grounded_{k}" for k in _each("regions", "area_km2", "pixels")], "ndvi_mean", "mndwi_mean", "vari_mean",
    "change_fraction", "change_area_km2", "fusion_water_fraction", "fusion_iou", "fusion_cloud_recovered_km2", "ts_observations", "ts_slope_per_year", "ts_r2",
    "scene_count", "scene_area_km2"]


def _map(pairs: dict, value) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), value(v))])


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _per_request(df: DataFrame) -> DataFrame:
    """A table that has rows for every request, to be met by a shuffle.

    Its rows are many and alike, so its files are far smaller than its rows: by the size of the files it would be sent out
    whole by the driver.
    """
    return df.hint("merge")


def val(key: str) -> Column:
    return F.col("nums")[key]


def worded(key: str) -> Column:
    return F.col("texts")[key]


def fixed(value: Column, digits: int, sign: bool = False, commas: bool = False) -> Column:
    flags = ("+" if sign else "") + ("," if commas else "")
    return F.when(value.isNotNull(), F.format_string(f"%{flags}.{digits}f", half_even(value, digits)))


def percent(value: Column, digits: int = 2) -> Column:
    return F.concat(fixed(value * 100, digits), F.lit("%"))


def say(*parts) -> Column:
    """Concatenation of text and columns; NULL when any column is NULL."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def maybe(*parts) -> Column:
    """Like ``say`` but empty instead of NULL."""
    return F.coalesce(say(*parts), F.lit(""))


# ------------------------------------------------------------------ choosing facts
def _wanted(q: Column) -> Column:
    """array<struct(tier, key)> in order of preference.

    Tier 0 are the keys the task puts first, tier 1 the classes and indices named,
    tier 2 substitutes used only when tier 1 finds nothing.
    """
    classes, indices, task = F.col("target_classes"), F.col("indices"), F.col("task")
    hints = _map({c: [k + s for k in keys for s in ("", "_before", "_after")] for c, keys in V.CLASS_FACTS.items()}, _strings)
    none = F.array().cast("array<string>")
    named = F.flatten(F.transform(classes, lambda c: F.coalesce(F.try_element_at(hints, c), none)))
    per_index = F.flatten(F.transform(indices, lambda i: F.array(*[
        F.concat(F.lit(a), F.lower(i), F.lit(b)) for a, b in (
            ("", "_mean"), ("", "_median"), ("", "_p90"), ("", "_p10"), ("d", "_mean"), ("d", "_before"), ("d", "_after"))])))
    changed = q.rlike(V.DIRECTION) | F.startswith(task, F.lit("change"))
    change = F.concat(_strings(("change_fraction", "change_area_km2")), F.flatten(F.transform(classes, lambda c: F.array(*[
        F.concat(c, F.lit(s)) for s in ("_delta_area_km2", "_relative_change_pct", "_fraction_before", "_fraction_after")]))))
    targets = F.when(F.size(classes) > 0, classes).otherwise(_strings(("water",)))
    ground = F.flatten(F.transform(targets, lambda c: F.array(*[
        F.concat(F.lit("grounded_"), c, F.lit(s)) for s in ("_regions", "_area_km2", "_pixels")])))
    fusion = _strings(("fusion_water_fraction", "fusion_iou", "fusion_cloud_recovered_pixels"))
    # each group is put in front of what is there, so the last one named comes first
    front = F.reverse(F.concat(F.when(changed, change).otherwise(none), F.when(task == "grounding", ground).otherwise(none),
                               F.when(task == "optical_sar_fusion", fusion).otherwise(none)))
    swap = F.when(F.size(indices) > 0, _strings(("vari_mean", "ndvi_mean", "mndwi_mean", "ndwi_mean"))).otherwise(none)

    def tier(keys: Column, n: int) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(n).alias("tier"), k.alias("fact_key")))

    return F.concat(tier(front, 0), tier(F.concat(named, per_index), 1), tier(swap, 2))


def resolve_answers(plans: DataFrame, facts: DataFrame, text: str = "text", limit: int = 4) -> DataFrame:
    """(request_id, rank, fact columns): the facts that answer each question, best first.

    Keys implied by the question are matched first; then facts whose wording overlaps
    the question; then the measured composition.
    """
    cols = ["fact_key", "label", "value_num", "value_str", "unit"]
    wanted = plans.select(REQ, F.posexplode(_wanted(F.col(text))).alias("pos", "w")).select(REQ, "pos", "w.tier", "w.fact_key")
    facts = _per_request(facts.select(REQ, *cols))
    hits = wanted.join(facts, [REQ, "fact_key"])
    # the wanted list of a question is short, so its hits are too
    named = hits.groupBy(REQ).agg(F.array_sort(F.collect_list(F.struct("tier", "pos", *cols))).alias("h"))
    has_named = F.exists("h", lambda x: x["tier"] == 1)
    first_swap = F.array_min(F.filter("h", lambda x: x["tier"] == 2))
    used = F.filter("h", lambda x: (x["tier"] < 2) | (~has_named & (x == first_swap)))
    named = named.withColumn("h", used)
    keys = F.transform("h", lambda x: x["fact_key"])
    named = named.withColumn("h", F.filter("h", lambda x, i: F.array_position(keys, x["fact_key"]) == i + 1)).where(F.size("h") > 0)
    direct = named.select(REQ, F.posexplode(F.slice("h", 1, limit)).alias("rank", "x")).select(REQ, "rank", "x.*").drop("tier", "pos")
    # read several times below
    direct = materialise(direct, "answers-direct")

    rest = plans.join(_per_request(direct.select(REQ).distinct()), REQ, "left_anti")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]{4,}"), F.lit(0)))
    hay = F.lower(F.concat_ws(" ", "label", "fact_key"))
    scored = rest.select(REQ, words.alias("_w")).join(facts, REQ).withColumn(
        "score", F.size(F.filter("_w", lambda w: F.contains(hay, w)))).where("score > 0")
    found = materialise(scored.selectExpr(REQ, f"row_number() OVER (PARTITION BY {REQ} ORDER BY score DESC, fact_key DESC) - 1 AS rank", *cols).where(
        F.col("rank") < limit), "answers-worded")

    last = _per_request(rest.join(_per_request(found.select(REQ).distinct()), REQ, "left_anti").select(REQ))
    comp = top_classes(facts.join(last, REQ, "left_semi"), 0.02, limit).select(
        REQ, (F.col("rank") - 1).alias("rank"), F.concat("class", F.lit("_fraction")).alias("fact_key"))
    composed = comp.join(facts, [REQ, "fact_key"]).select(REQ, "rank", *cols)
    return direct.unionByName(found).unionByName(composed)


def _direction_sentence() -> Column:
    """Sentence for the first named class with a measured change."""
    found = F.lit(None).cast("string")
    options = []
    for c, label in V.CLASS_LABELS.items():
        area, rel = val(f"{c}_delta_area_km2"), val(f"{c}_relative_change_pct")
        delta = F.coalesce(area, val(f"{c}_fraction_after") - val(f"{c}_fraction_before"))
        word = F.when(delta > 0, "increased").when(delta < 0, "decreased").otherwise("stayed level")
        text = F.when(delta.isNotNull(), say(
            f"Yes — {label.lower()} ", word, maybe(" by ", fixed(F.abs(area), 2, commas=True), " km²"),
            maybe(" (", fixed(rel, 2, sign=True), "% relative to the earlier date)"), "."))
        options.append(F.struct(F.array_position("target_classes", c).alias("at"), text.alias("text")))
    named = F.filter(F.array(*options), lambda o: (o["at"] > 0) & o["text"].isNotNull())
    found = F.array_min(named)["text"]
    return F.coalesce(found, say("Measured change affects ", percent(val("change_fraction")), " of the co-observed area."))


def answer(plans: DataFrame, facts: DataFrame, text: str = "text") -> DataFrame:
    """(request_id, status, answer, primary_fact, confidence) from measured facts only."""
    chosen = resolve_answers(plans, facts, text)
    line = say("" , F.col("label"), ": ", format_fact(F.col("value_num"), F.col("value_str"), F.col("unit")), ".")
    per = chosen.groupBy(REQ).agg(F.array_sort(F.collect_list(F.struct("rank", "fact_key", line.alias("line")))).alias("a"))
    q = F.col(text)
    out = plans.select(REQ, text, "target_classes").join(_per_request(per), REQ, "left").join(_per_request(fact_columns(facts, ANSWER_KEYS)), REQ, "left")
    first = F.get("a", F.lit(0))
    opening = F.when(q.rlike(V.YES_NO) & q.rlike(V.DIRECTION), F.coalesce(_direction_sentence(), F.lit(""))).otherwise(first["line"])
    rest = F.transform(F.slice("a", 2, 3), lambda x: x["line"])
    return out.select(
        REQ, F.when(F.col("a").isNull(), "no_data").otherwise("ok").alias("status"),
        F.when(F.col("a").isNotNull(), F.trim(F.array_join(F.concat(F.array(opening), rest), " "))).alias("answer"),
        first["fact_key"].alias("primary_fact"), F.when(F.col("a").isNotNull(), 0.85).alias("confidence"))


# --------------------------------------------------------------------- descriptions
def _ranked(items: list[tuple[Column, Column]], limit: int | None = None) -> Column:
    """The structs whose condition holds, in their order, from (condition, struct) pairs.

    Without functions over arrays, which Spark evaluates uncompiled with all that is below them.
    """
    kept = sum((F.coalesce(on, F.lit(False)).cast("int") for on, _ in items), F.lit(0))
    ordered = F.sort_array(F.array(*[F.when(on, item) for on, item in items]))  # those left out come first
    return F.slice(ordered, F.lit(len(items) + 1) - kept, kept if limit is None else F.least(kept, F.lit(limit)))


def _composition(above: float, **texts) -> Column:
    """Classes above a share, largest first, as array<struct(neg, ord, label, v, …)>; ``texts`` are made from label and share."""
    items = []
    for i, (c, label) in enumerate(V.CLASS_LABELS.items()):
        v = val(f"{c}_fraction")
        items.append((v > above, F.struct((-v).alias("neg"), F.lit(i).alias("ord"), F.lit(label).alias("label"), v.alias("v"),
                                          *[text(label, v).alias(name) for name, text in texts.items()])))
    return _ranked(items)


def _listed(items: Column, digits: int, lower: bool = True, sep: str = " ") -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(
        F.lower(x["label"]) if lower else x["label"], F.lit(sep), percent(x["v"], digits))), ", ")


def _index_sentences(digits: int, spread) -> list[Column]:
    out = []
    for name in ("NDVI", "MNDWI", "NBR", "NDBI"):
        k = name.lower()
        out.append(say(f"Mean {name} is ", fixed(val(f"{k}_mean"), digits), f" ({V.INDEX_INFO[name][1]})",
                       F.coalesce(spread(val(f"{k}_p10"), val(f"{k}_p90")), F.lit("")), "."))
    return out


def _in_domain() -> Column:
    return F.coalesce("in_domain", F.lit(True)) & worded("rs_dominant_class").isNotNull()


def caption(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """(request_id, caption, confidence); requests carry source, place, acq_date, width, height and in_domain."""
    out = requests.join(_per_request(fact_columns(facts, CAPTION_KEYS, ("rs_dominant_class",))), REQ, "left")
    comp = _composition(0.005)
    head = say(F.col("source"), " imaged ", F.coalesce("place", F.lit("the requested area")), maybe(" on ", F.col("acq_date").cast("string")),
               maybe(" covering ", fixed(val("scene_area_km2"), 0, commas=True), " km²"), " at ", F.col("width").cast("string"), "×",
               F.col("height").cast("string"), " pixels.")
    label = F.when(_in_domain(), say(
        "The scene classifier labels the scene predominantly '", worded("rs_dominant_class"), "'",
        maybe(" (", percent(val("rs_dominant_fraction"), 1), " of ", fixed(F.coalesce(val("rs_tiles"), F.lit(0.0)), 0), " tiles)"),
        maybe(", mean confidence ", fixed(val("rs_mean_confidence"), 2)), "."))
    cloud = val("cloud_or_snow_fraction")
    body = [
        F.when(F.size("_c") > 0, say("The scene is dominated by ", _listed(F.slice("_c", 1, 3), 1), ".")),
        F.when(F.size("_c") > 3, say("Also present: ", _listed(F.slice("_c", 4, 9), 1), ".")), label,
        *_index_sentences(3, lambda a, b: say(", with 80% of pixels between ", fixed(a, 3), " and ", fixed(b, 3))),
        say("Radar puts low-backscatter open water at ", percent(val("sar_water_fraction")), " of the scene."),
        say("Between the two dates, ", percent(val("change_fraction")), " of the co-observed area changed."),
        F.when(cloud > 0.2, say("Note that ", percent(cloud, 1), " of the scene is cloud or snow, which limits what could be measured."))]
    out = out.withColumn("_c", comp).withColumn("_body", sentence_list(body))
    return out.select(REQ, F.when(F.col("_body") != "", F.concat(head, F.lit(" "), F.col("_body"))).alias("caption"),
                      F.when(F.col("_body") != "", 0.86).alias("confidence"))


def _movers(limit: int, sentence) -> Column:
    items = []
    for c, label in V.CLASS_LABELS.items():
        d = val(f"{c}_delta_area_km2")
        items.append((F.abs(d) > 0.01, F.struct((-F.abs(d)).alias("neg"), F.lit(label).alias("label"), sentence(c, F.lit(label), d).alias("text"))))
    ranked = _ranked(items, limit)
    return F.when(F.size(ranked) > 0, F.array_join(ranked["text"], " "))


def narrate(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """(request_id, narrator, text): template narration by task; every number is a fact."""
    out = requests.join(_per_request(fact_columns(facts, NARRATION_KEYS, ("ts_index", "rs_dominant_class"))), REQ, "left")
    first, last = F.get("dates", F.lit(0)).cast("string"), F.try_element_at("dates", F.lit(-1)).cast("string")
    span = F.when(F.size("dates") == 1, say(" for ", first)).when(F.size("dates") > 1, say(" for ", first, " and ", last))
    head = say("The analysis used ", F.col("source"), " over ", F.coalesce("place", F.lit("the requested area")), F.coalesce(span, F.lit("")),
               maybe(", covering ", fixed(val("scene_area_km2"), 0, commas=True), " km²"), " at ", F.col("width").cast("string"), "×",
               F.col("height").cast("string"), " pixels.")
    changed = sentence_list([
        say("Change Vector Analysis flags ", percent(val("change_fraction")), " of the co-observed area as changed",
            maybe(" (", fixed(val("change_area_km2"), 2, commas=True), " km²)"),
            maybe(", using an Otsu magnitude threshold of ", fixed(val("change_threshold"), 4)), "."),
        _movers(3, lambda c, label, d: say(label, F.when(d > 0, " grew by ").otherwise(" shrank by "), fixed(F.abs(d), 2, commas=True), " km²",
                                            maybe(" (", fixed(val(f"{c}_relative_change_pct"), 2, sign=True), "% relative to the earlier date)"), ".")),
        *[say(f"Mean {n} moved by ", fixed(val(f"d{n.lower()}_mean"), 4, sign=True),
              maybe(", from ", fixed(val(f"d{n.lower()}_before"), 4), " to ", fixed(val(f"d{n.lower()}_after"), 4)), ".") for n in ("NDVI", "MNDWI", "NBR")]])
    recovered = val("fusion_cloud_recovered_pixels")
    fused = sentence_list([
        say("The optical channel puts open water at ", percent(val("fusion_optical_water_fraction")), " of the scene while the co-registered SAR channel puts it at ",
            percent(val("fusion_sar_water_fraction")), "."),
        say("The two sensors agree on ", fixed(val("fusion_iou"), 3), " intersection-over-union, and the fused decision surface gives ",
            percent(val("fusion_water_fraction")), " water coverage."),
        F.when(recovered > 0, say("Radar recovered ", fixed(recovered, 0, commas=True), " pixels of water that cloud hid from the optical sensor",
                                  maybe(", equivalent to ", fixed(val("fusion_cloud_recovered_km2"), 2, commas=True), " km²"), "."))])
    idx = worded("ts_index")
    trend = sentence_list([
        say("The ", idx, " series is built from ", fixed(val("ts_observations"), 0), " usable acquisitions."),
        say(idx, " moved from ", fixed(val("ts_first"), 4), " at the start of the series to ", fixed(val("ts_last"), 4), " at the end, a net change of ",
            fixed(val("ts_net_change"), 4, sign=True), "."),
        say("The ordinary-least-squares trend is ", fixed(val("ts_slope_per_year"), 4, sign=True), " ", idx, " per year with R² of ", fixed(val("ts_r2"), 3), ".")])
    cover = sentence_list([
        F.when(F.size("_c") > 0, say("Land-cover segmentation gives ", _listed(F.slice("_c", 1, 4), 2), ".")),
        *_index_sentences(4, lambda a, b: say(", with the 10th-90th percentile range spanning ", fixed(a, 4), " to ", fixed(b, 4))),
        F.when(_in_domain(), say("The scene classifier labels the scene mainly '", worded("rs_dominant_class"), "'",
                                 maybe(" (", percent(val("rs_dominant_fraction")), " of tiles)"),
                                 maybe("; that model scores ", percent(val("rs_model_test_accuracy")), " on its held-out split"), ".")),
        say("The SAR channel independently measures low-backscatter open water at ", percent(val("sar_water_fraction")), " of the scene.")])
    task, cloud, co = F.col("task"), val("cloud_or_snow_fraction"), val("coobserved_fraction")
    body = F.when(task.isin("change_detection", "change_vqa"), changed).when(task == "optical_sar_fusion", fused).when(
        task == "time_series", trend).otherwise(cover)
    notes = sentence_list([
        F.when(cloud > 0.15, say("Note that ", percent(cloud), " of the optical scene is cloud or snow, so the surface measurements describe the remaining clear pixels only.")),
        F.when(co < 0.9, say("Only ", percent(co), " of the grid was observed on both dates; all change statistics are computed over that overlap."))])
    out = out.withColumn("_c", _composition(0.005)).withColumn("_body", F.trim(F.concat_ws(" ", body, notes)))
    full = F.concat(head, F.lit(" "), F.when(F.col("_body") != "", F.col("_body")).otherwise("No further quantitative measurement was produced for this request."))
    return out.select(REQ, F.lit("template").alias("narrator"), full.alias("text"))


def no_data_text(plans: DataFrame, reason: str = "reason") -> DataFrame:
    """The explanation of a request nothing could be measured for."""
    return plans.select(REQ, say("The required data is not available, so no answer can be given for ", F.coalesce("aoi_name", F.lit("the requested area")),
                                 ". ", F.col(reason), " No value has been estimated or substituted.").alias("text"))


def summarise(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """(request_id, ord, kind, title, points): the digest of each finished request.

    Requests carry task, status, place, dates, bands, width, height, box, warnings,
    confidence, checked, verified, is_upload and interpretation. Sections without
    content are dropped and every number is a fact or a plan field.
    """
    out = requests.join(_per_request(fact_columns(facts, DIGEST_KEYS, ("ts_index",))), REQ, "left")
    first, last = F.get("_days", F.lit(0)), F.try_element_at("_days", F.lit(-1))
    period = F.when(F.size("_days") == 1, first).when(F.size("_days") > 1, say(first, " to ", last))
    located, upload = F.col("west").isNotNull(), F.col("is_upload")
    task, ok = F.col("task"), F.col("status") == "ok"
    titles = _map(V.TASK_TITLES, F.lit)

    # what a point lacks leaves it NULL; such points are dropped once the sections are rows
    points = F.array
    headline = F.when(task.isin("change_detection", "change_vqa"), points(
        say(percent(val("change_fraction"), 1), " of the area changed", maybe(" (", fixed(val("change_area_km2"), 1, commas=True), " km²)")),
        _movers(3, lambda c, label, d: say(label, F.when(d > 0, " grew by ").otherwise(" shrank by "), fixed(F.abs(d), 1, commas=True), " km².")))
    ).when(task == "optical_sar_fusion", points(
        say("Fused water coverage: ", percent(val("fusion_water_fraction"), 1)), say("Optical/SAR agreement (IoU): ", fixed(val("fusion_iou"), 4)),
        F.when(val("fusion_cloud_recovered_km2") > 0, say("Radar recovered ", fixed(val("fusion_cloud_recovered_km2"), 1, commas=True), " km² hidden by cloud")))
    ).when(task == "time_series", points(
        say(worded("ts_index"), " across ", fixed(val("ts_observations"), 0), " usable dates"),
        say("Trend: ", fixed(val("ts_slope_per_year"), 4, sign=True), " per year", maybe(" (R² ", fixed(val("ts_r2"), 2), ")")))
    ).when(task == "grounding", points(*[F.when(F.array_contains("target_classes", c), say(
        fixed(val(f"grounded_{c}_regions"), 0), f" {label.lower()} region(s) located",
        F.coalesce(say(", ", fixed(val(f"grounded_{c}_area_km2"), 2, commas=True), " km² total"),
                   say(", ", fixed(val(f"grounded_{c}_pixels"), 0, commas=True), " px total"), F.lit("")))) for c, label in V.CLASS_LABELS.items()])
    ).otherwise(F.array().cast("array<string>"))
    # a function over an array keeps this step out of the join's code, which would be too long to be compiled
    out = out.withColumns({
        "_days": F.transform("dates", lambda d: d.cast("string")), "_headline": headline, "_c": _composition(0.02, found=lambda label, v: say(label, ": ", percent(v, 1)), seen=lambda label, v: say(label, " (", percent(v, 0), ")"))})
    room = F.greatest(4 - F.size(F.array_compact("_headline")), F.lit(0))
    composition = F.slice("_c", F.lit(1), room)["found"]
    measured = [say(f"Mean {n}: ", fixed(val(f"{n.lower()}_mean"), 4), f" ({V.INDEX_INFO[n][1]})") for n in ("NDVI", "MNDWI", "VARI")]
    basis = F.when(F.arrays_overlap("bands", _strings(("nir",))), "multispectral").otherwise("RGB")
    outcome = {"no_data": "No usable data for this request", "needs_clarification": "More information needed",
               "unsupported": "This request is not supported", "error": "The analysis could not complete"}
    sections = [
        ("outcome", "Outcome", F.when(~ok, points(F.try_element_at(_map(outcome, F.lit), F.col("status"))))),
        ("understanding", "What you asked", points(
            F.col("interpretation"), F.try_element_at(titles, task), F.when(upload, "Area: your uploaded image").otherwise(
                F.coalesce(say("Location identified: ", F.col("place")), F.lit("Location: none resolved from the question"))), say("Time period: ", period))),
        ("performed", "What the system did", F.when(ok, points(
            say("Data used: ", F.col("source")), say(fixed(val("scene_count"), 0), " scene(s) retrieved and checked for compatibility")))),
        ("findings", "Key findings", F.when(ok, F.concat("_headline", composition))),
        ("detected", "Detected features", F.when(ok, F.col("_c")["seen"])),
        ("measure", "Measurements", F.when(ok, points(*measured))),
        ("location", "Location", F.when(ok & located, points(
            F.when(~upload, F.col("place")),
            say("Lon ", fixed(F.col("west"), 3), " to ", fixed(F.col("east"), 3), ", lat ", fixed(F.col("south"), 3), " to ", fixed(F.col("north"), 3)),
            say("Area covered: ", fixed(val("scene_area_km2"), 0, commas=True), " km²")))),
        ("image", "Image", F.when(ok, points(
            say(F.col("width").cast("string"), " × ", F.col("height").cast("string"), " pixels"), say(F.size("bands").cast("string"), "-band ", basis, " image"),
            say("Bands: ", F.array_join("bands", ", "))))),
        ("geo", "Geographic information", F.when(ok, F.when(located, points(F.lit("Sizes reported in km²"))).otherwise(points(
            F.lit("No geographic metadata in this image"), F.lit("Sizes reported in pixels, not km²"))))),
        ("quality", "Result quality", F.when(ok, points(
            F.when(F.col("checked") > 0, say(F.col("verified").cast("string"), "/", F.col("checked").cast("string"), " numbers traced to measurements")),
            say("Confidence: ", fixed(F.col("confidence"), 2)),
            F.when(F.size("warnings") > 0, say(F.size("warnings").cast("string"), " caveat(s) raised"))))),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("kind"), F.lit(title).alias("title"), pts.alias("points"))
                     for i, (kind, title, pts) in enumerate(sections)])
    # the sections are a column of their own, as inside the generator they would be evaluated uncompiled; without
    # ``outer`` a filter on their number, which is fixed, would evaluate them a second time
    shown = out.select(REQ, rows.alias("_rows")).select(REQ, F.inline_outer("_rows"))
    return shown.withColumn("points", F.array_compact("points")).where("size(points) > 0")
