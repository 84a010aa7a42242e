"""Tracing every numeral in prose to a measured fact."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import COUNT_NOUNS, NUMBER, NUMERIC_FLOOR, NUMERIC_TOLERANCE, STRUCTURAL_NUMBER

REQ = "request_id"


def mask_structural(text: Column) -> Column:
    """Same text with dates, grid sizes, band names … replaced by # of equal length."""
    between = F.split(text, STRUCTURAL_NUMBER, -1)
    hits = F.regexp_extract_all(text, F.lit(STRUCTURAL_NUMBER), F.lit(0))
    return F.array_join(F.zip_with(
        between, hits, lambda b, h: F.concat(b, F.coalesce(F.repeat(F.lit("#"), F.length(h)), F.lit("")))), "")


def extract_claims(narrations: DataFrame, text: str = "text") -> DataFrame:
    """(request_id, claim_ord, raw, value): numerals that state a finding.

    Offsets come from the pieces between the numerals, so no row leaves the JVM.
    Small whole numbers next to a counting noun are not claims.
    """
    out = narrations.select(REQ, mask_structural(F.col(text)).alias("_m"))
    out = out.select(REQ, "_m", F.split("_m", NUMBER, -1).alias("_gaps"), F.regexp_extract_all("_m", F.lit(NUMBER), F.lit(0)).alias("_nums"))

    def total(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.length(p))

    placed = F.transform("_nums", lambda raw, i: F.struct(
        raw.alias("raw"), (total(F.slice("_gaps", 1, i + 1)) + total(F.slice("_nums", 1, i))).alias("start")))
    out = out.select(REQ, "_m", F.posexplode(placed).alias("claim_ord", "_c"))
    raw, start = F.col("_c.raw"), F.col("_c.start")
    left = F.greatest(start - 24, F.lit(0))
    window = F.lower(F.substring(F.col("_m"), left + 1, start + F.length(raw) + 24 - left))
    value = F.replace(raw, F.lit(","), F.lit("")).try_cast("double")
    counted = (value == F.floor(value)) & (F.abs(value) <= 12) & window.rlike(COUNT_NOUNS)
    return out.select(REQ, "claim_ord", raw.alias("raw"), value.alias("value"), counted.alias("_skip")).where(
        "value IS NOT NULL AND NOT _skip").drop("_skip")


def fact_representations(facts: DataFrame) -> DataFrame:
    """Every form a numeric fact may take in prose, numbered in order of preference."""
    v = F.col("value_num")
    small = v.between(-1.0, 1.0)
    forms = [(F.lit(True), v, "value"), (v < 0, -v, "magnitude of signed value"), (small, v * 100.0, "percentage of fraction"),
             (small & (v < 0), -v * 100.0, "magnitude as percentage"), (F.abs(v) >= 1000, v / 1000.0, "thousands")]
    array = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(i).alias("form_ord"), target.alias("target"), F.lit(kind).alias("kind")))
        for i, (cond, target, kind) in enumerate(forms)]))
    return facts.where(v.isNotNull()).select(REQ, "ord", "fact_key", F.inline(array))


def _band(x: Column, tolerance: float) -> Column:
    """Monotone bucket number: fixed width near zero, one tolerance step per bucket beyond."""
    knee = NUMERIC_FLOOR / tolerance
    a = F.abs(x)
    far = knee / NUMERIC_FLOOR + F.log(F.greatest(a, F.lit(knee)) / knee) / math.log1p(tolerance)
    return F.floor(F.signum(x) * F.when(a <= knee, a / NUMERIC_FLOOR).otherwise(far)).cast("bigint")


def match_claims(claims: DataFrame, facts: DataFrame, tolerance: float = NUMERIC_TOLERANCE) -> DataFrame:
    """Claims with the first fact form they agree with, or NULL.

    A band join: fact forms are placed in the few value buckets their tolerance
    reaches, so claims only meet facts of similar size, however many one request has.
    """
    t = F.col("target")
    reach = F.when(t == 0, 1e-9).otherwise(F.greatest(F.abs(t) * tolerance, F.lit(NUMERIC_FLOOR)))
    slack = 1e-9 * (1 + F.abs(t))
    forms = fact_representations(facts).withColumn("_reach", reach).withColumn("_band", F.explode(F.sequence(
        _band(t - F.col("_reach") - slack, tolerance), _band(t + F.col("_reach") + slack, tolerance))))
    near = F.when(t == 0, F.abs("value") < 1e-9).otherwise(F.abs(F.col("value") - t) <= F.col("_reach"))
    hits = claims.withColumn("_band", _band(F.col("value"), tolerance)).join(forms, [REQ, "_band"]).where(near)
    best = hits.groupBy(REQ, "claim_ord").agg(
        F.min(F.struct("ord", "form_ord", "fact_key", "kind")).alias("_best"))
    return claims.join(best, [REQ, "claim_ord"], "left").select(
        *claims.columns, F.col("_best").isNotNull().alias("verified"), F.col("_best.fact_key").alias("matched_fact"),
        F.coalesce(F.col("_best.kind"), F.lit("no measured fact supports this number")).alias("reason"))


def rejected_claims(claims: DataFrame, facts: DataFrame) -> DataFrame:
    return match_claims(claims, facts).where("NOT verified")


def grounding_report(narrations: DataFrame, matched: DataFrame, facts: DataFrame, provenance: DataFrame) -> DataFrame:
    """Per request: claims checked, verified and rejected, facts, and whether all sources are real."""
    counts = matched.groupBy(REQ).agg(F.count("*").alias("checked"), F.count_if("verified").alias("verified"))
    n = facts.groupBy(REQ).agg(F.count_distinct("fact_key").alias("fact_count"))
    real = provenance.groupBy(REQ).agg(F.bool_and(F.col("origin") != "synthetic_demo").alias("real"), F.count("*").alias("sources"))
    out = narrations.select(REQ, "narrator").join(counts, REQ, "left").join(n, REQ, "left").join(real, REQ, "left")
    return out.na.fill(0, ["checked", "verified", "fact_count", "sources"]).select(
        REQ, "narrator", "checked", "verified", (F.col("checked") - F.col("verified")).alias("rejected"), "fact_count", "sources",
        F.coalesce("real", F.lit(True)).alias("all_sources_real"), (F.col("checked") == F.col("verified")).alias("passed"))


def verify_narrations(narrations: DataFrame, facts: DataFrame, provenance: DataFrame, strict: bool = True) -> DataFrame:
    """Reports with the text that ships.

    ``narrations`` has (request_id, narrator, text[, fallback]). In strict mode a
    rejected text gives way to its fallback, and the fallback is verified in turn.
    """
    def audit(texts: DataFrame) -> DataFrame:
        report = grounding_report(texts, match_claims(extract_claims(texts), facts), facts, provenance)
        return report.join(texts.select(REQ, "text"), REQ)

    first = audit(narrations)
    if not strict or "fallback" not in narrations.columns:
        return first
    failed = first.where("NOT passed").select(REQ)
    retry = narrations.where("fallback IS NOT NULL").join(failed, REQ, "left_semi").select(
        REQ, F.lit("rejected_fallback_template").alias("narrator"), F.col("fallback").alias("text"))
    return first.join(retry.select(REQ), REQ, "left_anti").unionByName(audit(retry))
