"""Dates named in free text, found row by row without a shuffle.

Each rule yields an array of (d, text) hits; a later rule looks at the hits of the
earlier ones, so a looser reading never repeats what a stricter one covered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import MONTH_NAMES, RELATIVE_DATES, SEASONS, UNIT_DAYS

YEAR = r"((?:19|20)\d{2})"
MONTH = "(" + "|".join(sorted({n for m in MONTH_NAMES for n in (m, m[:3])}, key=lambda n: (-len(n), n))) + ")"
HIT = "array<struct<d:date,text:string>>"


def _found(text: Column, pattern: str, groups: int, build) -> Column:
    """Hits of one pattern; ``build`` maps (whole, group…) to a date."""
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in range(groups + 1)])
    hits = F.transform(parts, lambda m: F.struct(build(*[m[str(i)] for i in range(groups + 1)]).alias("d"), m["0"].alias("text")))
    return F.filter(hits, lambda h: h["d"].isNotNull())


def _day(year: Column, month: Column, day: Column) -> Column:
    """NULL for a day that does not exist."""
    return F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")


def _month_number(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, m in enumerate(MONTH_NAMES) for x in (m[:3], i + 1)])
    return F.element_at(table, F.substring(name, 1, 3))


def extract_dates(df: DataFrame, text: str, today: Column) -> DataFrame:
    """Adds ``dates`` (distinct, ascending) and ``date_texts`` (first wording of each)."""
    latest = F.date_sub(today, 2)

    def clamp(d: Column) -> Column:
        return F.when(d.isNotNull(), F.least(d, latest))

    def mid(year: Column, month: Column) -> Column:
        return clamp(_day(year, month, F.lit("15")))

    def one(when: Column, days: Column | int, label: Column) -> Column:
        return F.when(when, F.array(F.struct(clamp(F.date_sub(today, days)).alias("d"), label.alias("text")))).otherwise(
            F.array().cast(HIT))

    t, hits = F.col("_t"), F.col("_hits")
    none = F.array().cast(HIT)
    # one cheap look at the text decides which groups of rules can match at all
    dated, seasonal, worded = F.col("_dated"), F.col("_seasonal"), F.col("_worded")
    out = df.withColumn("_t", F.lower(F.col(text))).withColumns({
        "_dated": t.rlike(r"(?:19|20)\d{2}"), "_seasonal": t.rlike("|".join(sorted({name.split("-")[-1].split()[-1] for name, _, _ in SEASONS}))),
        "_worded": t.rlike("month|week|yesterday|today|year|ago|recent|now|current|latest")})
    out = out.withColumn("_hits", F.when(~dated, none).otherwise(F.concat(
        _found(t, rf"\b{YEAR}-(\d{{1,2}})-(\d{{1,2}})\b", 3, lambda w, y, m, d: clamp(_day(y, m, d))),
        _found(t, rf"\b(\d{{1,2}})\s+{MONTH}\.?\s+{YEAR}\b", 3, lambda w, d, m, y: clamp(_day(y, _month_number(m), d))),
        _found(t, rf"\b{MONTH}\.?\s+(\d{{1,2}}),?\s+{YEAR}\b", 3, lambda w, m, d, y: clamp(_day(y, _month_number(m), d))))))

    month_year = F.array_distinct(_found(t, rf"\b{MONTH}\.?\s+{YEAR}\b", 2, lambda w, m, y: mid(y, _month_number(m))))
    out = out.withColumn("_hits", F.when(~dated, none).otherwise(F.concat(hits, F.filter(
        month_year, lambda n: ~F.exists(hits, lambda h: F.contains(h["text"], n["text"]))))))

    # a bare month takes the last year named elsewhere in the sentence
    year = F.array_max(F.transform(hits, lambda h: F.year(h["d"])))
    bare = _found(t, rf"\b{MONTH}\.?\b(?!\s*\.?\s*(?:\d{{1,2}},?\s*)?(?:19|20)\d{{2}})", 1,
                  lambda w, m: mid(F.col("_year").cast("string"), _month_number(m)))
    out = out.withColumn("_year", year).withColumn("_bare", F.when(F.size(hits) > 0, bare).otherwise(none))
    months = F.transform("_bare", lambda h: F.trunc(h["d"], "month"))
    out = out.withColumn("_hits", F.concat(hits, F.filter("_bare", lambda n, i: (
        F.array_position(months, F.trunc(n["d"], "month")) == i + 1)
        & ~F.exists(hits, lambda h: F.trunc(h["d"], "month") == F.trunc(n["d"], "month")))))

    seasons = [
        _found(t, rf"\b{name}\s+(?:of\s+)?{YEAR}\b", 1,
               lambda w, y, m=((a + b) // 2 if b >= a else 1): mid(y, F.lit(str(m))))
        for name, a, b in SEASONS]
    out = out.withColumn("_hits", F.when(dated & seasonal, F.concat(hits, *seasons)).otherwise(hits))

    def june(w: Column, y: Column) -> Column:
        y = y.cast("int")
        return F.when(y < F.year(today), clamp(F.make_date(y, F.lit(6), F.lit(15)))).when(
            y == F.year(today), clamp(F.date_sub(today, 30)))

    years = F.array_distinct(_found(t, rf"\b{YEAR}\b", 1, june))
    out = out.withColumn("_hits", F.when(~dated, hits).otherwise(F.concat(hits, F.filter(
        years, lambda n: ~F.exists(hits, lambda h: F.year(h["d"]) == n["text"].cast("int"))))))

    ago = _found(t, r"\b(\d{1,2})\s+(year|month|week|day)s?\s+ago\b", 2, lambda w, n, unit: clamp(F.date_sub(
        today, n.cast("int") * F.element_at(F.create_map(*[F.lit(x) for kv in UNIT_DAYS.items() for x in kv]), unit))))
    relative = [one(t.rlike(pattern), days, F.lit(pattern)) for pattern, days in RELATIVE_DATES]
    ordered = F.transform(F.when(worded, F.concat(hits, *relative, ago)).otherwise(hits), lambda h, i: F.struct(h["d"].alias("d"), i.alias("i"), h["text"].alias("text")))
    out = out.withColumn("_all", F.array_sort(ordered))
    first = F.filter("_all", lambda h, i: (i == 0) | (h["d"] != F.get("_all", i - 1)["d"]))
    return out.withColumn("_all", first).withColumns({
        "dates": F.transform("_all", lambda h: h["d"]), "date_texts": F.transform("_all", lambda h: h["text"]),
    }).drop("_t", "_hits", "_year", "_bare", "_all", "_dated", "_seasonal", "_worded")
