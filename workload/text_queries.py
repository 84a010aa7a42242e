"""Questions, dates, places, parameters, facts and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyframe.functions.numbers import half_even

from skyframe import fixed_values as V
from skyframe.functions import text as T
from skyframe.operators import dates, facts, grounding, lexicon, pairing
from skyframe.operators.lexicon import _any_of
from skyframe.sources import catalog

from .fixtures import FACTS_SQL, NARRATIONS_SQL, QUESTIONS_SQL, duck, view
from .registry import query, table

TODAY = "2025-11-01"
Q = f"q AS ({duck(QUESTIONS_SQL)})"


def questions(spark, sf_dir):
    return view(spark, sf_dir, QUESTIONS_SQL)


def today():
    return F.lit(TODAY).cast("date")


def places(spark, sf_dir):
    """Nations as a gazetteer: a one-degree box per nation key."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.alias("ord"), F.col("n_name").alias("name"), (k * 5.0 - 60).alias("west"), (k * 2.0 - 20).alias("south"),
        (k * 5.0 - 59).alias("east"), (k * 2.0 - 19).alias("north"), F.lit("country").alias("kind"), F.col("n_name").alias("country"),
        F.array(F.concat(F.lit("Republic of "), F.col("n_name"))).alias("aliases"))


# messy free text: chat words glued to document openings
CHAT = """chat AS (SELECT doc_id, concat(['please ', 'Hey, can you ', 'show me ', ''][doc_id % 4 + 1], 'floods & crops in ', text,
  CASE WHEN doc_id % 3 = 0 THEN '?' ELSE '' END) AS text FROM documents)"""


def chat(spark, sf_dir):
    i = F.col("doc_id")
    lead = F.element_at(F.array(*map(F.lit, ("please ", "Hey, can you ", "show me ", ""))), (i % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(lead, F.lit("floods & crops in "), "text", F.when(i % 3 == 0, "?").otherwise("")).alias("text"))


NORMAL = f"trim(regexp_replace(replace(regexp_replace(text, '(?i){V.FILLER}', ' ', 'g'), '&', ' and '), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))"


@query("f1_normalise_text", f"WITH {CHAT} SELECT doc_id, {NORMAL} AS normalised FROM chat")
def f1(spark, sf_dir):
    return chat(spark, sf_dir).select("doc_id", T.normalise_text(F.col("text")).alias("normalised"))


@query("f2_fold_key", f"""WITH {CHAT} SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9 ]+', ' ', 'g')) AS key FROM chat""")
def f2(spark, sf_dir):
    return chat(spark, sf_dir).select("doc_id", T.fold_key(F.col("text")).alias("key"))


@query("f3_is_short_query", f"WITH {Q} SELECT question_id, len(string_split({NORMAL}, ' ')) <= 5 AND NOT contains(text, '?') AS short FROM q")
def f3(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id", T.is_short_query(F.col("text")).alias("short"))


WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"
SINGULAR = """CASE WHEN {w} LIKE '%ies' AND len({w}) > 4 THEN concat(left({w}, len({w}) - 3), 'y') WHEN regexp_matches({w}, '[sxzh]es$') AND len({w}) > 4
  THEN left({w}, len({w}) - 2) WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND len({w}) > 3 THEN left({w}, len({w}) - 1) ELSE {w} END"""


@query("f4_singularise", f"WITH {WORDS} SELECT word, {SINGULAR.format(w='word')} AS singular FROM w")
def f4(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.distinct().select("word", T.singularise(F.col("word")).alias("singular"))


STOP = "[" + ", ".join(f"'{w}'" for w in V.STOP_WORDS) + "]"


@query("f5_geocodable_terms", f"""WITH {CHAT} SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(
    regexp_replace(lower(text), '''s\\b', '', 'g'), '[a-z'']+'), lambda w: trim(w, '''-')),
  lambda w: len(w) >= 3 AND NOT list_contains({STOP}, w) AND NOT list_contains({STOP}, {SINGULAR.format(w='w')})), ' ') AS terms FROM chat""")
def f5(spark, sf_dir):
    return chat(spark, sf_dir).select("doc_id", T.geocodable_terms(F.col("text")).alias("terms"))


# ---------------------------------------------------------------- dates and plans
MONTH_RX = dates.MONTH
DATE_CTES = f"""
h1 AS (SELECT question_id, least(CAST(x AS DATE), DATE '{TODAY}' - 2) AS d, x AS txt, 1 AS rule FROM (
  SELECT question_id, unnest(regexp_extract_all(lower(text), '\\b(?:19|20)\\d{{2}}-\\d{{1,2}}-\\d{{1,2}}\\b')) AS x FROM q)),
h2 AS (SELECT question_id, least(make_date(CAST(right(x, 4) AS INT), list_position({[m[:3] for m in V.MONTH_NAMES]}, left(x, 3)), 15), DATE '{TODAY}' - 2) AS d, x AS txt, 2 AS rule
  FROM (SELECT question_id, unnest(regexp_extract_all(lower(text), '\\b{MONTH_RX}\\.?\\s+(?:19|20)\\d{{2}}\\b')) AS x FROM q)),
h12 AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2),
h3 AS (SELECT question_id, make_date(CAST(x AS INT), 6, 15) AS d, x AS txt, 3 AS rule FROM (
  SELECT question_id, unnest(regexp_extract_all(lower(text), '\\b(?:19|20)\\d{{2}}\\b')) AS x FROM q)
  WHERE NOT EXISTS (SELECT 1 FROM h12 WHERE h12.question_id = q.question_id AND year(h12.d) = CAST(x AS INT))),
dd AS (SELECT question_id, d, arg_min(txt, rule) AS txt FROM (SELECT * FROM h12 UNION ALL SELECT * FROM h3) GROUP BY ALL),
dl AS (SELECT question_id, list(CAST(d AS VARCHAR) ORDER BY d) AS dates FROM dd GROUP BY 1)""".replace("FROM q)\n  WHERE NOT EXISTS", "FROM q) q\n  WHERE NOT EXISTS")


@query("f6_extract_dates", f"WITH {Q}, {DATE_CTES} SELECT question_id, d, txt FROM dd")
def f6(spark, sf_dir):
    out = dates.extract_dates(questions(spark, sf_dir), "text", today())
    return out.select("question_id", F.explode(F.arrays_zip("dates", "date_texts")).alias("z")).select(
        "question_id", F.col("z.dates").alias("d"), F.col("z.date_texts").alias("txt"))


def _sql_labels(textual: str, groups: dict) -> str:
    return "list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches({textual}, '{_any_of(words)}') THEN '{k}' END" for k, words in groups.items()) + "], lambda x: x IS NOT NULL)"


CLS_SQL = _sql_labels("lower(text)", V.CLASS_SYNONYMS)
IDX_SQL = _sql_labels("lower(text)", V.INDEX_SYNONYMS)
MOD_SQL = _sql_labels("lower(text)", V.MODALITY_HINTS)
MAPPED = f"list_distinct(list_filter(list_transform({CLS_SQL}, lambda k: MAP {{{', '.join(repr(k) + ': ' + repr(v) for k, v in V.CLASS_TO_INDEX.items())}}}[k]), lambda x: x IS NOT NULL))"


@query("j11_match_lexicon", f"""WITH {Q} SELECT question_id, array_to_string({CLS_SQL}, ',') AS classes,
  array_to_string(CASE WHEN len({IDX_SQL}) > 0 THEN {IDX_SQL} ELSE {MAPPED} END, ',') AS indices, array_to_string({MOD_SQL}, ',') AS modalities FROM q""")
def j11(spark, sf_dir):
    t = F.col("text")
    c = lexicon.match_classes(t)
    return questions(spark, sf_dir).select("question_id", F.array_join(c, ",").alias("classes"), F.array_join(lexicon.match_indices(t, c), ",").alias("indices"),
                                           F.array_join(lexicon.match_modalities(t), ",").alias("modalities"))


TASK_HITS = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(lower(text), '{'|'.join('(?:' + p + ')' for p in pats)}') THEN '{task}' END" for task, _, pats in V.TASK_PATTERNS) + "], lambda x: x IS NOT NULL)"
ASKS = f"(contains(text, '?') OR regexp_matches(lower(text), '{V.INTERROGATIVE}'))"
TASK_SQL = f"""tk AS (SELECT question_id, text, CASE WHEN len(h) > 0 THEN h[1] WHEN {ASKS} THEN 'vqa' ELSE 'caption' END AS task,
  CASE WHEN len(h) > 0 THEN least(0.6::DOUBLE + least(len(h), 3) * 0.08::DOUBLE, 0.92) WHEN {ASKS} THEN 0.55 ELSE 0.4 END AS conf
  FROM (SELECT *, {TASK_HITS} AS h FROM q))"""


@query("f7_classify_task", f"WITH {Q}, {TASK_SQL} SELECT question_id, task, round(conf, 4) AS confidence FROM tk")
def f7(spark, sf_dir):
    t = questions(spark, sf_dir).withColumn("k", lexicon.classify_task(F.col("text")))
    return t.select("question_id", F.col("k.task").alias("task"), F.round("k.confidence", 4).alias("confidence"))


EVENT_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(lower({NORMAL}), '{'|'.join('(?:' + p + ')' for p in e[2])}') THEN '{e[0]}'" for e in sorted(V.EVENTS, key=lambda e: -e[-1])) + " END"
ACT = {task: f"regexp_matches(lower({NORMAL}), '{p}')" for task, p, _ in V.ACTIONS}


def _event_case(field: int) -> str:
    def lit(v):
        if isinstance(v, tuple):
            return "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]"
        return f"'{v}'"
    return "CASE ev " + " ".join(f"WHEN '{e[0]}' THEN {lit(e[field])}" for e in V.EVENTS if e[field] is not None) + " END"


READ_SQL = f"""rd AS (SELECT *, CASE WHEN {ACT['change_detection']} THEN 'change_detection' WHEN {ACT['time_series']} THEN 'time_series'
    WHEN {ACT['grounding']} AND NOT coalesce(base IN ('change_detection', 'time_series'), false) THEN 'grounding'
    WHEN {ACT['landcover']} THEN 'landcover' ELSE base END AS implied
  FROM (SELECT *, CASE WHEN len(dates) >= 2 AND {_event_case(4)} IS NOT NULL THEN {_event_case(4)} ELSE {_event_case(3)} END AS base
    FROM (SELECT tk.*, coalesce(dates, []) AS dates, {EVENT_SQL} AS ev FROM tk LEFT JOIN dl USING (question_id))))"""


@query("f8_detect_event", f"WITH {Q}, {TASK_SQL}, {DATE_CTES}, {READ_SQL} SELECT question_id, ev AS event, implied AS task FROM rd")
def f8(spark, sf_dir):
    d = dates.extract_dates(questions(spark, sf_dir), "text", today()).withColumn("low", F.lower(T.normalise_text(F.col("text"))))
    d = d.withColumn("event", lexicon.detect_event(F.col("low")))
    return d.select("question_id", "event", lexicon.interpret(F.col("event"), F.col("low"), F.size("dates")).alias("task"))


PLACE_SQL = f"""pl AS (SELECT question_id, n_name AS aoi, n_nationkey AS nk FROM (SELECT question_id, n_name, n_nationkey, row_number() OVER (
    PARTITION BY question_id ORDER BY len(k) DESC, n_nationkey) AS rn
  FROM (SELECT question_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g')) || ' ' AS f FROM q)
  JOIN (SELECT n_name, n_nationkey, lower(replace(n_name, '_', ' ')) AS k FROM nation) ON contains(f, ' ' || k || ' ')) WHERE rn = 1)"""


@query("j10_resolve_place", f"WITH {Q}, {PLACE_SQL} SELECT question_id, aoi AS name, nk * 5.0::DOUBLE - 60 AS west FROM pl")
def j10(spark, sf_dir):
    return lexicon.resolve_place(questions(spark, sf_dir), places(spark, sf_dir)).select("question_id", "name", "west")


UNION = "list_concat({a}, list_filter({b}, lambda x: NOT list_contains({a}, x)))"
PLAN_SQL = f"""an AS (SELECT question_id, text, ev, dates, aoi, nk,
    CASE WHEN take THEN implied ELSE task END AS task, CASE WHEN take THEN greatest(conf, 0.68) ELSE conf END AS conf,
    {UNION.format(a='cls', b=f'coalesce({_event_case(5)}, [])')} AS classes,
    CASE WHEN len(idx) > 0 THEN idx ELSE coalesce({_event_case(6)}, []) END AS indices,
    {UNION.format(a='mods', b=f'coalesce({_event_case(7)}, [])')} AS mods
  FROM (SELECT rd.*, aoi, nk, {CLS_SQL} AS cls, CASE WHEN len({IDX_SQL}) > 0 THEN {IDX_SQL} ELSE {MAPPED} END AS idx, {MOD_SQL} AS mods,
      implied IS NOT NULL AND ((task IN ('caption', 'vqa') AND conf < 0.62) OR (len(string_split({NORMAL}, ' ')) <= 5 AND NOT contains(text, '?'))) AS take
    FROM rd LEFT JOIN pl USING (question_id)))"""
ALL_PLAN = f"{Q}, {TASK_SQL}, {DATE_CTES}, {READ_SQL}, {PLACE_SQL}, {PLAN_SQL}"


def plans(spark, sf_dir):
    return lexicon.annotate_queries(questions(spark, sf_dir), places(spark, sf_dir), today())


@query("f9_annotate_query", f"""WITH {ALL_PLAN} SELECT question_id, task, aoi AS aoi_name, array_to_string(dates, ',') AS dates, array_to_string(classes, ',') AS classes,
  array_to_string(indices, ',') AS indices,
  array_to_string(CASE WHEN task = 'optical_sar_fusion' THEN {UNION.format(a='mods', b="['sar', 'optical']")} ELSE mods END, ',') AS modalities,
  CASE WHEN task IN ('change_detection', 'change_vqa') THEN 'bitemporal_pair' WHEN task = 'optical_sar_fusion' THEN 'cross_modal_pair'
    WHEN task = 'time_series' THEN 'no_image' ELSE 'single_image' END AS config,
  concat_ws(',', CASE WHEN aoi IS NULL THEN 'no_location' END, CASE WHEN len(dates) = 0 THEN 'no_date' END,
    CASE WHEN task IN ('change_detection', 'change_vqa') AND len(dates) < 2 THEN 'change_needs_two_dates' END) AS ambiguities,
  round_even(least(0.95, conf + CASE WHEN aoi IS NOT NULL THEN 0.05 ELSE 0 END + CASE WHEN len(dates) > 0 THEN 0.03 ELSE 0 END), 3) AS confidence FROM an""")
def f9(spark, sf_dir):
    p = plans(spark, sf_dir)
    j = lambda c: F.array_join(c, ",")
    return p.select("question_id", "task", "aoi_name", j(F.transform("dates", lambda d: d.cast("string"))).alias("dates"), j("target_classes").alias("classes"),
                    j("indices").alias("indices"), j("modalities").alias("modalities"), F.col("input_configuration").alias("config"),
                    j("ambiguities").alias("ambiguities"), "confidence")


VERB = "CASE task " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.TASK_PHRASES.items()) + " END"


@query("f10_restate", f"""WITH {ALL_PLAN} SELECT question_id, concat('Analyse satellite imagery to ', {VERB}, ' ', coalesce(aoi, 'an area that still needs to be named'),
  CASE WHEN ev IS NOT NULL THEN concat(', focusing on ', lower({_event_case(1)})) ELSE '' END,
  CASE len(dates) WHEN 0 THEN '' WHEN 1 THEN concat(', observed around ', dates[1]) ELSE concat(', comparing ', dates[1], ' with ', dates[-1]) END,
  CASE WHEN len(indices) > 0 THEN concat(', using ', array_to_string(indices, ', ')) ELSE '' END, '.') AS interpretation FROM an""")
def f10(spark, sf_dir):
    return plans(spark, sf_dir).select("question_id", "interpretation")


@query("f17_comparison_anchors", f"""WITH {Q}, {DATE_CTES}, x AS (SELECT question_id, coalesce(dates, []) AS dates FROM q LEFT JOIN dl USING (question_id))
SELECT question_id, CASE len(dates) WHEN 0 THEN DATE '{TODAY}' - 370 WHEN 1 THEN CAST(dates[1] AS DATE) - 365 ELSE CAST(dates[1] AS DATE) END AS before,
  CASE len(dates) WHEN 0 THEN DATE '{TODAY}' - 5 ELSE CAST(dates[-1] AS DATE) END AS after,
  CASE len(dates) WHEN 0 THEN 'no date, past year' WHEN 1 THEN 'one date, a year earlier' ELSE 'two dates' END AS rule FROM x""")
def f17(spark, sf_dir):
    d = dates.extract_dates(questions(spark, sf_dir), "text", today())
    return d.select("question_id", *[v.alias(k) for k, v in pairing.comparison_anchors(F.col("dates"), today()).items()])


OVER_SQL = """ov AS (SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 3 = 0 THEN 'custom place' END AS oname,
  CASE WHEN o_orderkey % 5 = 0 THEN 10.0 END AS ow, CASE WHEN o_orderkey % 7 = 0 THEN [DATE '2024-05-01', DATE '2023-05-01'] END AS od FROM orders)"""


@query("f18_apply_overrides", f"""WITH {ALL_PLAN}, {OVER_SQL} SELECT question_id, CASE WHEN ow IS NOT NULL THEN coalesce(oname, aoi, 'custom area') ELSE coalesce(oname, aoi) END AS aoi_name,
  coalesce(ow::DOUBLE, nk * 5.0::DOUBLE - 60) AS west, CASE WHEN od IS NOT NULL THEN '2023-05-01,2024-05-01' ELSE array_to_string(dates, ',') END AS dates
FROM an JOIN ov USING (question_id)""")
def f18(spark, sf_dir):
    k = F.col("o_orderkey")
    box = F.when(k % 5 == 0, F.lit(10.0))
    client = table(spark, sf_dir, "orders").select(
        k.alias("question_id"), F.when(k % 3 == 0, "custom place").alias("aoi_name"), box.alias("west"), box.alias("south"), box.alias("east"), box.alias("north"),
        F.when(k % 7 == 0, F.array(F.lit("2024-05-01").cast("date"), F.lit("2023-05-01").cast("date"))).alias("dates"))
    out = lexicon.apply_overrides(plans(spark, sf_dir), client)
    return out.select("question_id", "aoi_name", "west", F.array_join(F.transform("dates", lambda d: d.cast("string")), ",").alias("dates"))


@query("p26_plan_status", f"""WITH {ALL_PLAN} SELECT question_id, CASE WHEN early THEN 'no_data' WHEN nk IS NULL AND NOT scene THEN 'needs_clarification' WHEN question_id % 50 = 0 THEN 'no_data' ELSE 'ok' END AS status,
  CAST((nk IS NULL AND NOT scene)::INT + early::INT + (task IN ('change_detection', 'change_vqa') AND NOT scene AND len(dates) < 2)::INT AS INT) AS issues
FROM (SELECT *, question_id % 10 = 5 AS scene, question_id % 10 <> 5 AND len(list_filter(dates, lambda d: CAST(d AS DATE) < DATE '2000-02-24')) > 0 AS early FROM an)""")
def p26(spark, sf_dir):
    i = F.col("question_id")
    p = plans(spark, sf_dir).withColumns({"has_scene": i % 10 == 5, "tools_ok": F.when(i % 50 == 0, 0).otherwise(2)})
    return lexicon.plan_status(p).select("question_id", "status", F.size("issues").alias("issues"))


# --------------------------------------------------------------------- parameters
PARAM_SQL = """pq AS (SELECT s_suppkey AS request_id, ['region_grounder', 'spectral_index', 'timeseries_analyzer'][s_suppkey % 3 + 1] AS tool,
  [['max_regions', 'min_size', 'colour'], ['indices', 'histogram_bins', 'bins'], ['steps', 'index', 'interval_days']][s_suppkey % 3 + 1] AS params,
  [[CAST(s_suppkey % 40 AS VARCHAR), 'many', 'red'], ['NDVI,EVI', CAST(s_suppkey * 7 AS VARCHAR), '3'], [CAST(s_suppkey % 5 AS VARCHAR), CASE WHEN s_suppkey % 2 = 0 THEN 'NBR' ELSE 'EVI' END, '9999']][s_suppkey % 3 + 1] AS vals
  FROM supplier), rq AS (SELECT request_id, tool, unnest(params) AS param, unnest(vals) AS value FROM pq)"""
RULES_SQL = "ru(tool, param, kind, preset, low, high, choices) AS (VALUES " + ", ".join(
    f"('{t}', '{p}', '{k}', {repr(d) if d else 'NULL'}, {lo or 'NULL'}::DOUBLE, {hi or 'NULL'}::DOUBLE, {list(ch) if ch else 'NULL'}::VARCHAR[])"
    for t, p, k, d, lo, hi, ch in V.PARAM_RULES) + ")"


@query("f14_validate_parameters", f"""WITH {PARAM_SQL}, {RULES_SQL}, j AS (SELECT rq.*, kind, low, high, choices, try_cast(value AS BIGINT) AS num FROM rq LEFT JOIN ru USING (tool, param)),
c AS (SELECT request_id, tool, param, CASE WHEN kind IS NULL OR (kind = 'int' AND num IS NULL) OR (kind = 'str' AND NOT list_contains(choices, value)) THEN NULL
    WHEN kind = 'int' THEN CAST(CAST(greatest(least(num, coalesce(high, num)), coalesce(low, num)) AS BIGINT) AS VARCHAR)
    WHEN kind = 'list' THEN array_to_string(list_filter(string_split(value, ','), lambda x: list_contains(choices, x)), ',') ELSE value END AS value,
  CASE WHEN kind IS NULL THEN 'rejected: not permitted' WHEN kind = 'int' AND num IS NULL THEN 'rejected: cannot coerce to int'
    WHEN kind = 'str' AND NOT list_contains(choices, value) THEN 'rejected: not a permitted choice'
    WHEN kind = 'list' AND len(list_filter(string_split(value, ','), lambda x: NOT list_contains(choices, x))) > 0 THEN 'clamped: dropped values outside the permitted choices'
    WHEN num < low THEN 'clamped: below minimum' WHEN num > high THEN 'clamped: above maximum' END AS note FROM j)
SELECT * FROM c UNION ALL SELECT request_id, tool, param, preset, 'default' FROM (SELECT DISTINCT request_id, tool FROM rq) d JOIN ru USING (tool)
WHERE preset IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.request_id = d.request_id AND c.param = ru.param AND c.value IS NOT NULL)""")
def f14(spark, sf_dir):
    k = F.col("s_suppkey")
    pick = lambda xs: F.element_at(F.array(*xs), (k % 3 + 1).cast("int"))
    arr = lambda *xs: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    tool = pick([F.lit(t) for t in ("region_grounder", "spectral_index", "timeseries_analyzer")])
    params = pick([arr("max_regions", "min_size", "colour"), arr("indices", "histogram_bins", "bins"), arr("steps", "index", "interval_days")])
    vals = pick([arr((k % 40).cast("string"), "many", "red"), arr("NDVI,EVI", (k * 7).cast("string"), "3"),
                 arr((k % 5).cast("string"), F.when(k % 2 == 0, "NBR").otherwise("EVI"), "9999")])
    rq = table(spark, sf_dir, "supplier").select(k.alias("request_id"), tool.alias("tool"), F.explode(F.arrays_zip(params.alias("param"), vals.alias("value"))).alias("z")).select(
        "request_id", "tool", F.col("z.param").alias("param"), F.col("z.value").alias("value"))
    return facts.validate_parameters(rq, facts.param_rules(spark))


@query("u6_parameter_membership", f"""WITH {PARAM_SQL}, {RULES_SQL} SELECT request_id, array_to_string(list_sort(list_filter(params, lambda p: NOT list_contains(allowed, p))), ',') AS undeclared
FROM pq JOIN (SELECT tool, list(param) AS allowed FROM ru GROUP BY 1) USING (tool)""")
def u6(spark, sf_dir):
    rules = facts.param_rules(spark).groupBy("tool").agg(F.collect_list("param").alias("allowed"))
    k = F.col("s_suppkey")
    pick = lambda xs: F.element_at(F.array(*xs), (k % 3 + 1).cast("int"))
    tools = pick([F.lit(t) for t in ("region_grounder", "spectral_index", "timeseries_analyzer")])
    params = pick([F.array(*map(F.lit, p)) for p in (("max_regions", "min_size", "colour"), ("indices", "histogram_bins", "bins"), ("steps", "index", "interval_days"))])
    rq = table(spark, sf_dir, "supplier").select(k.alias("request_id"), tools.alias("tool"), params.alias("params"))
    return rq.join(rules, "tool").select("request_id", F.array_join(F.array_sort(F.array_except("params", "allowed")), ",").alias("undeclared"))


# ---------------------------------------------------------------- facts, grounding
FACT = f"fx AS ({duck(FACTS_SQL)})"
NARR = f"nr AS ({duck(NARRATIONS_SQL)})"


def fx_facts(spark, sf_dir):
    return view(spark, sf_dir, FACTS_SQL)


def fx_narrations(spark, sf_dir):
    return view(spark, sf_dir, NARRATIONS_SQL)


LI_FACTS = """lf AS (SELECT l_suppkey AS request_id, l_orderkey * 10 + l_linenumber AS ord, concat('k', l_partkey % 7) AS fact_key, l_quantity AS value_num FROM lineitem)"""


def line_facts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("request_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.concat(F.lit("k"), (F.col("l_partkey") % 7).cast("string")).alias("fact_key"), F.col("l_quantity").alias("value_num"))


@query("s12_last_write_wins", f"WITH {LI_FACTS} SELECT request_id, min(ord) AS ord, fact_key, arg_max(value_num, ord) AS value_num FROM lf GROUP BY request_id, fact_key")
def s12(spark, sf_dir):
    return facts.last_write_wins(line_facts(spark, sf_dir))


@query("k5_first_facts", f"WITH {LI_FACTS} SELECT request_id, ord, fact_key, value_num FROM lf QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY ord) <= 60")
def k5(spark, sf_dir):
    return facts.first_facts(line_facts(spark, sf_dir), 60)


@query("a20_dedupe_provenance", """SELECT l_suppkey AS request_id, l_returnflag AS source, CAST(l_shipdate AS DATE) AS acquisition_date, min(l_orderkey * 10 + l_linenumber) AS ord
FROM lineitem GROUP BY ALL""")
def a20(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("request_id"), F.col("l_returnflag").alias("source"), F.col("l_shipdate").cast("date").alias("acquisition_date"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return facts.dedupe_provenance(p)


TRACE_SQL = """tr AS (SELECT user_id AS request_id, event_type AS tool, ts, ['ok', 'ok', 'no_data', 'error', 'skipped'][event_id % 5 + 1] AS status,
  CAST(round(value * 100) AS BIGINT) AS duration_ms, (event_id % 10) / 10.0::DOUBLE AS confidence FROM events)"""


def trace(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("request_id"), i.alias("step"), F.col("event_type").alias("tool"), "ts",
        F.element_at(F.array(*map(F.lit, ("ok", "ok", "no_data", "error", "skipped"))), (i % 5 + 1).cast("int")).alias("status"),
        F.round(F.col("value") * 100).cast("bigint").alias("duration_ms"), ((i % 10) / F.lit(10.0)).alias("confidence"))


@query("a21_workload_summary", f"""WITH {TRACE_SQL} SELECT request_id, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'no_data') AS n_no_data,
  count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (status = 'skipped') AS n_skipped, CAST(sum(duration_ms) AS BIGINT) AS total_ms,
  round_even(avg(confidence) FILTER (status = 'ok'), 3) AS confidence, CASE WHEN count(*) FILTER (status = 'ok') = 0 THEN 'no_data' ELSE 'ok' END AS status FROM tr GROUP BY 1""")
def a21(spark, sf_dir):
    return facts.workload_summary(trace(spark, sf_dir))


FORMS = """forms AS (SELECT request_id, ord, fact_key, unnest(list_filter([
   {'i': 0, 't': value_num, 'k': 'value', 'on': true}, {'i': 1, 't': -value_num, 'k': 'magnitude of signed value', 'on': value_num < 0},
   {'i': 2, 't': value_num * 100, 'k': 'percentage of fraction', 'on': value_num BETWEEN -1 AND 1},
   {'i': 3, 't': -value_num * 100, 'k': 'magnitude as percentage', 'on': value_num BETWEEN -1 AND 0 AND value_num < 0},
   {'i': 4, 't': value_num / 1000, 'k': 'thousands', 'on': abs(value_num) >= 1000}], lambda x: x['on'])) AS f FROM fx)"""


@query("f12_fact_representations", f"WITH {FACT}, {FORMS} SELECT request_id, ord, fact_key, f.i AS form_ord, f.t AS target, f.k AS kind FROM forms")
def f12(spark, sf_dir):
    return grounding.fact_representations(fx_facts(spark, sf_dir))


CLAIMS = f"""mk AS (SELECT request_id, array_to_string(list_transform(regexp_split_to_array(text, '{V.STRUCTURAL_NUMBER}'),
    lambda g, i: concat(g, CASE WHEN i <= len(hits) THEN repeat('#', len(hits[i])) ELSE '' END)), '') AS m
  FROM (SELECT *, regexp_extract_all(text, '{V.STRUCTURAL_NUMBER}') AS hits FROM nr)),
nm AS (SELECT request_id, m, unnest(list_transform(nums, lambda x, i: {{'raw': x, 'i': CAST(i - 1 AS INT), 's': coalesce(list_sum(list_transform(gaps[1:i], lambda g: len(g))), 0) + coalesce(list_sum(list_transform(nums[1:i - 1], lambda g: len(g))), 0)}})) AS c
  FROM (SELECT *, regexp_extract_all(m, '{V.NUMBER}') AS nums, regexp_split_to_array(m, '{V.NUMBER}') AS gaps FROM mk)),
cl AS (SELECT request_id, c.i AS claim_ord, c.raw AS raw, CAST(replace(c.raw, ',', '') AS DOUBLE) AS value,
  lower(substr(m, CAST(greatest(c.s - 24, 0) + 1 AS BIGINT), CAST(c.s + len(c.raw) + 24 - greatest(c.s - 24, 0) AS BIGINT))) AS win FROM nm),
claims AS (SELECT request_id, claim_ord, raw, value FROM cl WHERE NOT (value = floor(value) AND abs(value) <= 12 AND regexp_matches(win, '{V.COUNT_NOUNS}')))"""


@query("f13_extract_claims", f"WITH {FACT}, {NARR}, {CLAIMS} SELECT * FROM claims")
def f13(spark, sf_dir):
    return grounding.extract_claims(fx_narrations(spark, sf_dir))


# the same audit over ordinary prose: numerals in documents against facts of their source
MATCH = """mt AS (SELECT request_id, claim_ord, arg_min({'k': fact_key, 'r': f.k}, ord * 10 + f.i) AS b FROM claims JOIN forms USING (request_id)
  WHERE CASE WHEN f.t = 0 THEN abs(value) < 1e-9 ELSE abs(value - f.t) <= greatest(abs(f.t) * 0.02, 0.05) END GROUP BY ALL),
mc AS (SELECT claims.*, b IS NOT NULL AS verified, b['k'] AS matched_fact, coalesce(b['r'], 'no measured fact supports this number') AS reason FROM claims LEFT JOIN mt USING (request_id, claim_ord))"""


@query("j12_match_claims", f"WITH {FACT}, {NARR}, {CLAIMS}, {FORMS}, {MATCH} SELECT * FROM mc")
def j12(spark, sf_dir):
    return grounding.match_claims(grounding.extract_claims(fx_narrations(spark, sf_dir)), fx_facts(spark, sf_dir))


def provenance(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("request_id"), F.concat(F.lit("archive "), (k % 4).cast("string")).alias("source"),
        F.when(k % 9 == 0, "synthetic_demo").otherwise("cached_satellite").alias("origin"))


REPORT = """SELECT nr.request_id, 'template' AS narrator, count(claim_ord) AS checked, count(*) FILTER (verified) AS verified, count(*) FILTER (NOT verified) AS rejected,
  CAST(2 AS BIGINT) AS fact_count, CAST(1 AS BIGINT) AS sources, nr.request_id % 9 <> 0 AS all_sources_real, count(*) FILTER (NOT verified) = 0 AS passed
FROM nr LEFT JOIN mc USING (request_id) GROUP BY nr.request_id"""


@query("a19_grounding_report", f"WITH {FACT}, {NARR}, {CLAIMS}, {FORMS}, {MATCH} {REPORT}")
def a19(spark, sf_dir):
    n, f = fx_narrations(spark, sf_dir).withColumn("narrator", F.lit("template")), fx_facts(spark, sf_dir)
    return grounding.grounding_report(n, grounding.match_claims(grounding.extract_claims(n), f), f, provenance(spark, sf_dir))


@query("c15_verify_narrations", f"""WITH {FACT}, {NARR}, {CLAIMS}, {FORMS}, {MATCH}, rp AS ({REPORT})
SELECT request_id, CASE WHEN passed THEN 'llm' ELSE 'rejected_fallback_template' END AS narrator, CASE WHEN passed THEN checked ELSE 1 END AS checked,
  CASE WHEN passed THEN verified ELSE 1 END AS verified, true AS passed FROM rp""")
def c15(spark, sf_dir):
    f = fx_facts(spark, sf_dir)
    good = f.where("ord = 1").select("request_id", F.concat(F.lit("Water covers "), F.col("value_num").cast("bigint").cast("string"), F.lit(" km2.")).alias("fallback"))
    n = fx_narrations(spark, sf_dir).withColumn("narrator", F.lit("llm")).join(good, "request_id")
    out = grounding.verify_narrations(n, f, provenance(spark, sf_dir))
    return out.select("request_id", "narrator", "checked", "verified", "passed")


@query("f11_format_fact", f"""WITH {FACT} SELECT request_id, ord, CASE unit WHEN 'fraction' THEN format('{{:.2f}}%', value_num * 100) ELSE concat(format('{{:,.2f}}', value_num), ' km²') END AS long_form,
  CASE unit WHEN 'fraction' THEN format('{{:.1f}}%', value_num * 100) ELSE concat(format('{{:,.2f}}', value_num), ' km²') END AS short_form FROM fx""")
def f11(spark, sf_dir):
    none = F.lit(None).cast("string")
    return fx_facts(spark, sf_dir).select("request_id", "ord", T.format_fact(F.col("value_num"), none, F.col("unit")).alias("long_form"),
                                          T.format_fact(F.col("value_num"), none, F.col("unit"), brief=True).alias("short_form"))


@query("f16_clip_and_round", """SELECT l_orderkey, l_linenumber, least(0.07, greatest(0.02, l_discount)) AS clipped, round_even(l_extendedprice / 1000.0, 2) AS thousands FROM lineitem""".replace(
    "least(0.07, greatest(0.02, l_discount))", "least(0.07::DOUBLE, greatest(0.02::DOUBLE, l_discount))"))
def f16(spark, sf_dir):
    from skyframe.functions.indices import clamp

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", clamp(F.col("l_discount"), 0.02, 0.07).alias("clipped"),
                                                   half_even(F.col("l_extendedprice") / 1000.0, 2).alias("thousands"))
