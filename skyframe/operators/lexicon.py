"""Reading questions: place, task, classes, indices, modalities, phenomenon.

Rule tables are small and constant, so each rule is one literal pattern in the row's
own expression: patterns compile once and nothing is shuffled. Places are found by
one automaton of all names where the list is short enough to send out, and otherwise
by a join of the few n-grams that a filter of names lets through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.numbers import half_even
from ..functions.text import fold_key, normalise_text
from ..sources.catalog import place_keys
from .dates import extract_dates
from .stats import attach


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _any_of(words) -> str:
    """One pattern matching any of the words at word boundaries."""
    escaped = [re.escape(w) for w in sorted(words, key=len, reverse=True)]
    return r"\b(?:" + "|".join(escaped) + r")\b"


def _labels(text: Column, table: dict) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(_any_of(words)), F.lit(k)) for k, words in table.items()]))


def match_classes(text: Column) -> Column:
    return _labels(F.lower(text), V.CLASS_SYNONYMS)


def match_indices(text: Column, classes: Column) -> Column:
    """Named indices, or else the usual index of each named class."""
    named = _labels(F.lower(text), V.INDEX_SYNONYMS)
    table = F.create_map(*[F.lit(x) for kv in V.CLASS_TO_INDEX.items() for x in kv])
    implied = F.array_distinct(F.array_compact(F.transform(classes, lambda c: F.try_element_at(table, c))))
    return F.when(F.size(named) > 0, named).otherwise(implied)


def match_modalities(text: Column) -> Column:
    return _labels(F.lower(text), V.MODALITY_HINTS)


def classify_task(text: Column) -> Column:
    """struct(task, confidence): the heaviest task any of whose patterns matches."""
    t = F.lower(text)
    hits = F.array_compact(F.array(*[
        F.when(t.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(task)) for task, _, patterns in V.TASK_PATTERNS]))
    asks = F.contains(text, F.lit("?")) | t.rlike(V.INTERROGATIVE)
    task = F.when(F.size(hits) > 0, F.get(hits, F.lit(0))).when(asks, "vqa").otherwise("caption")
    confidence = F.when(F.size(hits) > 0, F.least(0.6 + F.least(F.size(hits), F.lit(3)) * 0.08, F.lit(0.92))).when(
        asks, 0.55).otherwise(0.4)
    return F.struct(task.alias("task"), confidence.alias("confidence"))


_BY_PRIORITY = sorted(V.EVENTS, key=lambda e: -e[-1])


def detect_event(normalised: Column) -> Column:
    """Key of the highest-priority phenomenon named in a normalised, lower-case text."""
    t = normalised
    out = F.lit(None).cast("string")
    for event in reversed(_BY_PRIORITY):
        out = F.when(t.rlike("|".join(f"(?:{p})" for p in event[2])), F.lit(event[0])).otherwise(out)
    return out


def event_field(key: Column, field: int) -> Column:
    """A column of the phenomenon table for the given key."""
    pairs = [(e[0], e[field]) for e in V.EVENTS if e[field] is not None]
    values = [_strings(v) if isinstance(v, tuple) else F.lit(v) for _, v in pairs]
    return F.try_element_at(F.create_map(*[x for (k, _), v in zip(pairs, values) for x in (F.lit(k), v)]), key)


def interpret(event: Column, normalised: Column, n_dates: Column) -> Column:
    """Task implied by phenomenon and action verb; NULL when neither is present.

    Two dates turn a phenomenon into a comparison, and an explicit action overrides
    it, except that locating never displaces a comparison or a series.
    """
    t = normalised
    base = F.when((n_dates >= 2) & event_field(event, 4).isNotNull(), event_field(event, 4)).otherwise(event_field(event, 3))
    out = base
    for task, pattern, _ in reversed(V.ACTIONS):
        applies = t.rlike(pattern)
        if task == "grounding":
            applies = applies & ~F.coalesce(base.isin("change_detection", "time_series"), F.lit(False))
        out = F.when(applies, F.lit(task)).otherwise(out)
    return out


def action_note(event: Column, normalised: Column, n_dates: Column) -> Column:
    implied = interpret(event, normalised, n_dates)
    t = normalised
    out = F.lit(None).cast("string")
    for task, pattern, note in reversed(V.ACTIONS):
        out = F.when(t.rlike(pattern) & (implied == task), F.lit(note)).otherwise(out)
    return out


#: Bytes of place names up to which every task gets an automaton of them all.
AUTOMATON_BYTES = 8 << 20
#: Bits of the filter that stands for longer lists.
FILTER_BITS = 1 << 23


@lru_cache(maxsize=2)
def _automaton(keys: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    """All keys as whole words, each with its length and its place in the list, so that the larger pair wins."""
    out = ahocorasick.Automaton()
    for key, seen in keys:
        out.add_word(f" {key} ", (len(key), -seen, key))
    out.make_automaton()
    return out


def _longest(keys: tuple[tuple[str, int], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(keys)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("_folded").to_pylist()):
                # the blank between two names ends one and begins the other, and a match may use it twice
                best = max((value for _, value in automaton.iter(f" {text} ")), default=None) if text else None
                if best:
                    at.append(i)
                    found.append(best[2])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=[batch.schema.names[0], "key"])

    return run


def _slots(gram: str) -> tuple[int, int]:
    h = int.from_bytes(blake2b(gram.encode(), digest_size=8).digest(), "little")
    return h % FILTER_BITS, (h >> 32) % FILTER_BITS


def _known_grams(packed: bytes, lengths: tuple[int, ...]):
    """(key, n-gram) of the texts' word sequences that the filter of names lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("_folded").to_pylist()):
                words, seen = (text or "").split(), set()
                for n in lengths:
                    for k in range(len(words) - n + 1):
                        gram = " ".join(words[k : k + n])
                        if gram not in seen and all(bits[s] for s in _slots(gram)):
                            seen.add(gram)
                at += [i] * len(seen)
                found += sorted(seen)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=[batch.schema.names[0], "key"])

    return run


def _filter_of(keys: DataFrame) -> tuple[bytes, tuple[int, ...]]:
    """The bits of all names, and the numbers of words they have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes = np.zeros(FILTER_BITS, bool), set()
        for batch in batches:
            for key in batch.column("key").to_pylist():
                bits[list(_slots(key))] = True
                sizes.add(len(key.split()))
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary()), pa.array([sorted(sizes)], pa.list_(pa.int32()))], names=["bits", "sizes"])

    out, lengths = np.zeros(FILTER_BITS // 8, np.uint8), set()
    for row in keys.select("key").coalesce(16).mapInArrow(run, "bits binary, sizes array<int>").toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
        lengths |= set(row["sizes"])
    return out.tobytes(), tuple(sorted(lengths))


def resolve_place(questions: DataFrame, places: DataFrame, text: str = "text", key: str = "question_id", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(key, place …): the longest place name or alias contained in each text, however many words it has.

    Up to ``automaton_bytes`` of names, measured first, every task searches its texts with one automaton of all names, and only the
    name found goes on. A longer list is met by a join of n-grams, of which a filter of fixed size lets hardly any but names through.
    """
    keys = place_keys(places)
    folded = questions.select(key, fold_key(F.col(text)).alias("_folded"))
    kind = questions.schema[key].dataType.simpleString()
    keys = keys.where("key <> ''")
    if (keys.agg(F.sum(F.octet_length("key") + 16)).first()[0] or 0) <= automaton_bytes:
        listed = tuple(sorted((r["key"], r["seen"]) for r in keys.groupBy("key").agg(F.min("first_seen").alias("seen")).collect()))
        named = folded.mapInArrow(_longest(listed), f"`{key}` {kind}, key string")
    else:
        named = folded.mapInArrow(_known_grams(*_filter_of(keys)), f"`{key}` {kind}, key string")
    others = [c for c in keys.columns if c not in ("key", "first_seen")]
    met = attach(named, keys, ["key"])
    return met.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.length("key"), -F.col("first_seen"))).alias("p")).select(key, "p.*")


def annotate_queries(questions: DataFrame, places: DataFrame, today: Column, text: str = "text",
                     key: str = "question_id") -> DataFrame:
    """One analysis plan per question (place, dates, task, classes, indices, modalities …).

    A plan follows from the text alone, so equal texts are read once and every question takes the plan of its text.
    """
    # a text that is NULL keeps a plan too
    wording = F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit("")).alias("_wording")
    width = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # pattern matching is the work here: texts that small files or adaptive coalescing would leave to few tasks are spread over all
    texts = questions.select(text, wording).distinct().repartition(width, "_wording")
    read = _read_texts(texts, places, today, text, "_wording").drop(text)
    return questions.withColumn("_wording", wording).join(read, "_wording").drop("_wording")


def _read_texts(texts: DataFrame, places: DataFrame, today: Column, text: str, key: str) -> DataFrame:
    out = extract_dates(texts.withColumn("normalised", normalise_text(F.col(text))), text, today)
    t, low = F.col(text), F.lower("normalised")
    out = out.withColumn("_low", low)
    out = out.withColumns({"_task": classify_task(t), "event_key": detect_event(F.col("_low")), "_cls": match_classes(t)})
    n = F.size("dates")
    implied = interpret(F.col("event_key"), F.col("_low"), n)
    out = out.withColumns({"_implied": implied, "_idx": match_indices(t, F.col("_cls")), "_mod": match_modalities(t)})
    weak = F.col("_task.task").isin("caption", "vqa") & (F.col("_task.confidence") < 0.62)
    short = (F.size(F.split("normalised", " ")) <= 5) & ~F.contains(t, F.lit("?"))
    take = F.col("_implied").isNotNull() & (weak | short)
    none = F.array().cast("array<string>")
    event = F.col("event_key")
    out = out.withColumns({
        "task": F.when(take, F.col("_implied")).otherwise(F.col("_task.task")),
        "_conf": F.when(take, F.greatest("_task.confidence", F.lit(0.68))).otherwise(F.col("_task.confidence")),
        "target_classes": F.array_union("_cls", F.coalesce(event_field(event, 5), none)),
        "indices": F.when(F.size("_idx") > 0, F.col("_idx")).otherwise(F.coalesce(event_field(event, 6), none)),
        "_mod": F.array_union("_mod", F.coalesce(event_field(event, 7), none)),
        "event": event_field(event, 1),
        "unsupported": event.isin(*V.UNMEASURABLE_EVENTS),
    })
    located = resolve_place(texts, places, text, key).select(key, F.col("name").alias("aoi_name"), "west", "south", "east", "north")
    out = out.join(located, key, "left")
    change = F.col("task").isin("change_detection", "change_vqa")
    fusion = F.col("task") == "optical_sar_fusion"
    placed = F.col("aoi_name").isNotNull()
    out = out.withColumns({
        "input_configuration": F.when(change, "bitemporal_pair").when(fusion, "cross_modal_pair").when(
            F.col("task") == "time_series", "no_image").otherwise("single_image"),
        "modalities": F.when(fusion, F.array_union("_mod", _strings(("sar", "optical")))).otherwise(F.col("_mod")),
        "ambiguities": F.array_compact(F.array(
            F.when(~placed, "no_location"), F.when(n == 0, "no_date"),
            F.when(change & (n < 2), "change_needs_two_dates"),
            F.when(F.coalesce("unsupported", F.lit(False)), "out_of_scope_quantity"))),
        "confidence": half_even(F.least(
            F.col("_conf") + F.when(placed, 0.05).otherwise(0.0) + F.when(n > 0, 0.03).otherwise(0.0), F.lit(0.95)), 3),
    })
    return out.withColumn("interpretation", restate()).drop("_task", "_cls", "_implied", "_idx", "_mod", "_conf", "_low")


def restate(uploaded: Column | None = None) -> Column:
    """One sentence saying how the question was read; only resolved fields appear."""
    verb = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in V.TASK_PHRASES.items() for x in kv]), F.col("task")), F.lit("analyse"))
    dates = F.transform(F.col("dates"), lambda d: d.cast("string"))
    head = F.concat(F.lit("Analyse satellite imagery to "), verb, F.lit(" "),
                    F.coalesce("aoi_name", F.lit("an area that still needs to be named")))
    if uploaded is not None:
        head = F.when(uploaded, F.concat(F.lit("Analyse the image you uploaded to "), verb, F.lit(" it"))).otherwise(head)
    return F.concat(
        head,
        F.coalesce(F.concat(F.lit(", focusing on "), F.lower(F.col("event"))), F.lit("")),
        F.when(F.size(dates) == 1, F.concat(F.lit(", observed around "), F.get(dates, F.lit(0)))).when(
            F.size(dates) > 1, F.concat(F.lit(", comparing "), F.get(dates, F.lit(0)), F.lit(" with "), F.element_at(dates, -1))).otherwise(""),
        F.when(F.size("indices") > 0, F.concat(F.lit(", using "), F.array_join("indices", ", "))).otherwise(""),
        F.lit("."))


def apply_overrides(plans: DataFrame, client: DataFrame, key: str = "question_id") -> DataFrame:
    """Client-supplied box, place and dates win over what was read from the text."""
    c = client.select(key, *[F.col(x).alias("_" + x) for x in ("aoi_name", "west", "south", "east", "north", "dates")])
    boxed = F.col("_west").isNotNull()
    out = plans.join(c, key, "left")
    return out.withColumns({
        **{x: F.coalesce("_" + x, x) for x in ("west", "south", "east", "north")},
        "aoi_name": F.when(boxed, F.coalesce("_aoi_name", "aoi_name", F.lit("custom area"))).otherwise(F.coalesce("_aoi_name", "aoi_name")),
        "dates": F.coalesce(F.array_sort("_dates"), "dates"),
    }).drop(*[c for c in out.columns if c.startswith("_")])


def plan_status(plans: DataFrame, measured: str = "tools_ok") -> DataFrame:
    """needs_clarification, no_data or ok, with the list of issues."""
    no_place = F.col("west").isNull() & ~F.col("has_scene") & (F.col("task") != "unsupported")
    early = F.exists("dates", lambda d: d < F.lit(V.ARCHIVE_START).cast("date")) & ~F.col("has_scene")
    change = F.col("task").isin("change_detection", "change_vqa") & ~F.col("has_scene") & (F.size("dates") < 2)
    unknown = F.array_except("indices", _strings(V.INDEX_BANDS))
    return plans.withColumns({
        "issues": F.array_compact(F.array(
            F.when(no_place, "no area of interest"), F.when(early, "dates before archive start"),
            F.when(change, "change analysis defaulted its comparison dates"),
            F.when(F.size(unknown) > 0, "unsupported indices"))),
        "status": F.when(early, "no_data").when(no_place, "needs_clarification").when(F.col(measured) == 0, "no_data").otherwise("ok")})
