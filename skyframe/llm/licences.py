"""Licence notices in texts: MinHash bands over overlapping windows, then exact shingle containment.

Everything is a DataFrame expression.  Templates are grouped by their number of words; a group with at most L words looks
at windows of 2 L words, one every L words, so that a notice always lies inside a window.  A window and a template are a
candidate when one of BANDS minima over their hashed 5-word shingles agrees.  A template has at least a seventh of the
shingles of its window, which no band sees with a chance of at most (6 / 7) ** 64, or 5e-5.  A band can only agree where
the text holds the shingle behind the template's minimum, so texts without any of these take no further part.  A template
of fewer than five words is one shingle of its own length, and its windows are those of a group of that length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 64
#: Share of a template's shingles that a window must hold.
CONTAINED = 0.8
#: Most words of a template in each group of templates.
LENGTHS = (5, 8, 16, 32)

# The notices that are looked for.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Notices too short for a 5-word shingle.
SHORT_NOTICES = {"all-rights-reserved": "All rights reserved."}


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(hashes: Column, size: int = SHINGLE) -> Column:
    """Hash of each shingle of ``size`` words, in order; none for fewer words."""
    n = F.greatest(F.size(hashes) - (size - 1), F.lit(0))
    return F.transform(F.slice(hashes, F.lit(1), n), lambda h, i: F.xxhash64(h, *(F.get(hashes, i + j) for j in range(1, size))))


def minima(found: Column) -> Column:
    """(band, least value) over the shingles of a window."""
    bands = F.sequence(F.lit(1), F.lit(BANDS))
    return F.transform(bands, lambda k: F.struct(k.alias("band"), F.array_min(F.transform(found, lambda s: F.xxhash64(s, k))).alias("least")))


def _hashed(df: DataFrame, text: str) -> DataFrame:
    # explode keeps the optimiser from copying the hashes into the expression of every shingle
    rows = df.withColumn("w", F.explode(F.array(F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))))
    return rows.withColumn("s", shingles(F.col("w")))


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    """(licence, n_words, span, wanted): the templates with the length of their group, and their shingles."""
    rows = _hashed(spark.createDataFrame(sorted(templates.items()), "licence string, template string"), "template")
    whole = F.coalesce(*(F.when(F.size("w") == n, shingles(F.col("w"), n)) for n in range(1, SHINGLE)), F.col("s"))
    span = F.when(F.size("w") < SHINGLE, F.size("w")).otherwise(F.coalesce(*(F.when(F.size("w") <= n, F.lit(n)) for n in LENGTHS), F.size("w")))
    return rows.select("licence", F.size("w").alias("n_words"), span.alias("span"), F.array_distinct(whole).alias("wanted"))


def _short_hits(texts: DataFrame, size: int, named: dict[str, int]) -> DataFrame:
    """(doc_id, licence, start, containment) of notices of ``size`` words, at the one or two windows that hold each."""
    wanted = texts.sparkSession.createDataFrame(sorted(named.items()), "licence string, g bigint")
    grams = texts.select("doc_id", F.explode(F.array(shingles(F.col("w"), size))).alias("grams"))
    found = grams.filter(F.arrays_overlap("grams", F.array(*(F.lit(h) for h in sorted(named.values()))))).select("doc_id", F.posexplode("grams").alias("at", "g"))
    at = F.col("at")
    # windows start every ``size`` words and are twice as long
    held = F.when((at % size == 0) & (at > 0), F.array(at - size, at)).otherwise(F.array(at - at % size))
    return found.join(F.broadcast(wanted), "g").select("doc_id", "licence", F.explode(held).alias("start"), F.lit(1.0).alias("containment"))


def _long_hits(texts: DataFrame, known: list[Row]) -> DataFrame:
    """(doc_id, licence, start, containment) of the templates with 5-word shingles."""
    behind = sorted({s for r in known for s in r["behind"]})
    bands = texts.sparkSession.createDataFrame([(r["span"], k, v, r["licence"], r["wanted"]) for r in known for k, v in enumerate(r["least"], 1)],
                                  "span int, band int, least bigint, licence string, wanted array<bigint>")
    possible = texts.filter(F.arrays_overlap("s", F.lit(behind)))
    spans = F.explode(F.array(*(F.lit(n) for n in sorted({r["span"] for r in known})))).alias("span")
    starts = F.explode(F.sequence(F.lit(0), F.size("s") - 1, F.col("span"))).alias("start")
    windows = possible.select("doc_id", "s", spans).select("doc_id", "s", "span", starts)
    windows = windows.select("doc_id", "span", "start", F.slice("s", F.col("start") + 1, 2 * F.col("span") - (SHINGLE - 1)).alias("s"))
    hits = windows.select("doc_id", "span", "start", "s", F.inline(minima(F.col("s")))).join(F.broadcast(bands), ["span", "band", "least"])
    share = F.size(F.array_intersect("s", "wanted")) / F.size("wanted")
    return hits.withColumn("containment", share).filter(F.col("containment") >= CONTAINED).select("doc_id", "licence", "start", "containment")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and licence found: doc_id, licence, n_windows, first_word, containment.

    first_word is where the first matching window starts, n_windows their number, and containment the largest share of
    the template's distinct shingles in one of them.  A template without words is an error.  Null and empty texts, and those shorter than a template,
    do not match it; repeated rows of an id count together, as do rows without an id; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = template_table(spark, TEMPLATES | SHORT_NOTICES if templates is None else templates)
    short: dict[int, dict[str, int]] = {}
    for r in table.filter(F.col("n_words") < SHINGLE).collect():
        if not r["n_words"]:
            raise ValueError(f"the template of {r['licence']} has no words")
        short.setdefault(r["n_words"], {})[r["licence"]] = r["wanted"][0]
    table = table.filter(F.col("n_words") >= SHINGLE)
    # a fixed, small set of texts: its minima become literals of the plan
    known = table.select("licence", "span", "wanted", F.transform(minima(F.col("wanted")), lambda m: m["least"]).alias("least"),
                         F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda k: F.array_min(F.transform("wanted", lambda s: F.struct(F.xxhash64(s, k).alias("h"), s.alias("shingle"))))["shingle"]).alias("behind")).collect()
    texts = _hashed(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), "text").select("doc_id", "w", "s")
    parts = [_long_hits(texts, known)] if known else []
    parts += [_short_hits(texts, size, named) for size, named in sorted(short.items())]
    if not parts:
        return spark.createDataFrame([], "doc_id bigint, licence string, n_windows bigint, first_word bigint, containment double")
    return (reduce(DataFrame.unionByName, parts).groupBy("doc_id", "licence", "start").agg(F.max("containment").alias("containment"))
            .groupBy("doc_id", "licence").agg(F.count(F.lit(1)).alias("n_windows"), F.min("start").cast("bigint").alias("first_word"), F.max("containment").alias("containment")))
