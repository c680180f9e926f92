"""Queries in which every rule, suggestion and fix has its case."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.functions import parsing, patterns
from lodewright.functions.text import squeeze
from lodewright.operators import classify, pipelines, quality
from lodewright.operators.corrections import suggest_corrections

from .adapters import ITEMS, items, table
from .base import query

# Rows that break each rule, by the remainders of their numbers; the same expressions serve both engines.
_ODD = {
    "normalized_name": "CASE id % 8 WHEN 0 THEN '' WHEN 1 THEN 'ab' WHEN 2 THEN repeat('abcd ', 30) || 'x' WHEN 3 THEN '12345' WHEN 4 THEN 'bolt код: x' WHEN 5 THEN concat('арт.', p_name) ELSE p_name END",
    "code": "CASE WHEN id % 5 = 0 THEN '' ELSE concat('k', id) END",
    "category": "CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN 'Other' WHEN 2 THEN 'другое' ELSE p_type END",
    "kpved_code": "CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN '46,90-1' WHEN 2 THEN 'x' WHEN 3 THEN '123.456' ELSE '46.90.10' END",
    "kpved_confidence": "(id % 97) / 97.0",
    "processing_level": "CASE id % 9 WHEN 0 THEN 'basic' WHEN 1 THEN 'enhanced' WHEN 2 THEN '' WHEN 3 THEN 'benchmark' ELSE 'ai_enhanced' END",
    "ai_confidence": "(id % 89) / 89.0",
    "ai_reasoning": "CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'short' ELSE 'by the keywords of its name' END",
}
_ROWS = f"""p AS (SELECT p_partkey AS id, p_name, p_type FROM part), odd AS (SELECT id, {", ".join(f"{e} AS {c}" for c, e in _ODD.items())} FROM p)"""
_BROKEN = [
    ("require_normalized_name", "critical", "normalized_name", "normalized_name = ''"),
    ("require_category", "critical", "category", "category = ''"),
    ("require_kpved_code", "warning", "kpved_code", "kpved_code = ''"),
    ("require_code", "error", "code", "code = ''"),
    ("valid_kpved_format", "error", "kpved_code", "kpved_code IN ('46,90-1', 'x', '123.456')"),
    ("name_length", "warning", "normalized_name", "length(normalized_name) < 3 OR length(normalized_name) > 100"),
    ("name_format", "error", "normalized_name", "normalized_name = '12345'"),
    ("kpved_confidence_threshold", "warning", "kpved_confidence", "kpved_code <> '' AND kpved_confidence < 0.7"),
    ("ai_confidence_threshold", "info", "ai_confidence", "processing_level = 'ai_enhanced' AND ai_confidence < 0.8"),
    ("category_other", "warning", "category", "category IN ('Other', 'другое')"),
    ("processing_level", "info", "processing_level", "processing_level IN ('enhanced', '')"),
    ("ai_reasoning", "info", "ai_reasoning", "processing_level IN ('ai_enhanced', 'benchmark') AND (ai_reasoning IS NULL OR ai_reasoning = 'short')"),
]
_TEXTS = ("kpved_confidence", "ai_confidence")
_ALL = " UNION ALL ".join(f"SELECT id, '{r}' AS rule, '{s}' AS severity, '{f}' AS field, {'NULL' if f in _TEXTS else f'coalesce({f}, {chr(39) * 2})'} AS value FROM odd WHERE {c}" for r, s, f, c in _BROKEN)


def _odd(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type")
    return rows.select("id", *[F.expr(e).cast("double" if c in _TEXTS else "string").alias(c) for c, e in _ODD.items()])


def _shown(v):
    """Violations without the values of numbers, which the engines write differently."""
    return v.withColumn("value", F.when(~F.col("field").isin(*_TEXTS), F.col("value")))


@query(f"WITH {_ROWS} {_ALL}")
def all_violations(spark, d):
    """Every rule broken by some row."""
    return _shown(_odd(spark, d).select("id", F.explode(quality.violations()).alias("v")).select("id", "v.rule", "v.severity", "v.field", "v.value"))


@query(f"WITH {_ROWS} {_ALL}")
def all_table_violations(spark, d):
    """The same of a table whose columns have other names."""
    named = {c: f"c{i}" for i, c in enumerate(_ODD)}
    rows = _odd(spark, d).withColumnsRenamed(named)
    return _shown(pipelines.table_violations(rows, "id", named).select("id", "rule", "severity", "field", "value"))


_ANSWERS = [
    ("reprocess", "high", "kpved_code", "'classify'", 0.8, True, "kpved_code = ''"),
    ("correct_format", "medium", "kpved_code", "CASE kpved_code WHEN '46,90-1' THEN '46.90.01' WHEN '123.456' THEN '12.45' ELSE kpved_code END", 0.6, False, "kpved_code IN ('46,90-1', 'x', '123.456')"),
    ("reprocess", "medium", "category", "'reclassify'", 0.7, True, "category IN ('Other', 'другое')"),
    ("correct_format", "low", "normalized_name", "trim(repeat('abcd ', 20))", 0.5, False, "length(normalized_name) > 100"),
    ("review", "medium", "kpved_code", "'review'", 0.9, False, "kpved_code <> '' AND kpved_confidence < 0.7"),
    ("reprocess", "low", "category", "'reprocess'", 0.6, True, "processing_level = 'ai_enhanced' AND ai_confidence < 0.8"),
    ("reprocess", "medium", "processing_level", "'ai_enhanced'", 0.8, True, "processing_level = 'basic'"),
    ("reprocess", "high", "kpved_code", "'classify'", 0.9, True, "kpved_code = '' AND processing_level <> 'basic'"),
    ("correct_format", "medium", "normalized_name", "CASE WHEN id % 8 = 4 THEN 'bolt x' ELSE substr(normalized_name, 5) END", 0.7, False, "id % 8 IN (4, 5)"),
]
_SUGGESTED = " UNION ALL ".join(f"SELECT id, '{k}' AS type, '{p}' AS priority, '{f}' AS field, {v} AS suggested_value, {c}::DOUBLE AS confidence, {str(a).lower()} AS auto_applyable FROM odd WHERE {w}" for k, p, f, v, c, a, w in _ANSWERS)


@query(f"WITH {_ROWS} {_SUGGESTED}")
def all_suggestions(spark, d):
    """What is suggested for each violation, and without one, with its value."""
    s = _odd(spark, d).select("id", F.explode(quality.suggestions(quality.violations())).alias("s"))
    return s.select("id", "s.type", "s.priority", "s.field", "s.suggested_value", "s.confidence", "s.auto_applyable")


@query(f"WITH {_ROWS} {_SUGGESTED}")
def all_table_suggestions(spark, d):
    named = {c: f"c{i}" for i, c in enumerate(_ODD)}
    s = pipelines.table_suggestions(_odd(spark, d).withColumnsRenamed(named), "id", named)
    return s.select("id", "type", "priority", "field", "suggested_value", "confidence", "auto_applyable")


# A name for each fix, and what is left of it.
_FIXES = [
    ("technical_code", "'valve ER-00013004'", "'valve'"), ("articul", "'valve art. 12-b'", "'valve'"), ("dimension", "'plate 10x20x30'", "'plate'"),
    ("units_of_measure", "'rod 15 mm'", "'rod 15 mm'"), ("extra_spaces", "'red    bolt'", "'red bolt'"), ("mixed_case", "'BOlt long'", "'Bolt Long'"),
    ("special_chars", "'bolt@nut'", "'bolt nut'"), ("duplicate_words", "'nut nut bolt'", "'nut bolt'"), ("numbers_in_name", "'12 bolts'", "'bolts'"), ("prefix_suffix", "'№ 7 bolt'", "'bolt'"),
]
_GIVEN = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {a}" for i, (_, a, _) in enumerate(_FIXES)) + " END"
_LEFT = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {b}" for i, (*_, b) in enumerate(_FIXES)) + " END"


@query(f"SELECT p_partkey AS id, {_LEFT} AS fixed FROM part")
def each_fix(spark, d):
    """A name for each fix, mended by that rule alone."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_GIVEN).alias("name"))
    fixed = F.coalesce(*[F.when(F.col("id") % 10 == i, patterns.apply_fixes(F.col("name"), [p for p in patterns.PATTERNS if p.kind == kind])) for i, (kind, *_) in enumerate(_FIXES)])
    return p.select("id", squeeze(fixed).alias("fixed"))


_WRONG = """m AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat('Кабель ', p_name) WHEN 1 THEN concat('Датчик ', p_name) WHEN 2 THEN concat('Фасонные элементы ', p_name) ELSE p_name END AS name,
  CASE p_partkey % 4 WHEN 0 THEN '26.12.1' WHEN 1 THEN '71.20.1' WHEN 2 THEN '96.09.1' ELSE '26.12.1' END AS code,
  CASE p_partkey % 8 WHEN 0 THEN '27.32.11' WHEN 4 THEN NULL WHEN 1 THEN '26.51.52' WHEN 5 THEN '71.20.1' WHEN 2 THEN '25.11.11' WHEN 6 THEN NULL ELSE '27.32.11' END AS better FROM part)"""


@query(f"""WITH {_WRONG} SELECT id, CASE WHEN id % 4 IN (1, 2) AND better IS NOT NULL AND better <> '71.20.1' THEN 'service' WHEN id % 4 IN (1, 2) THEN 'doubtful' WHEN id % 8 = 0 THEN 'mistake' ELSE '' END AS mended,
  CASE WHEN id % 8 IN (0, 1, 2) THEN better ELSE code END AS code FROM m""")
def each_mistake(spark, d):
    """Each known mistake of a model, with and without a better answer of the keywords; goods under codes of services are told first."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("Кабель "), "p_name")).when(k % 4 == 1, F.concat(F.lit("Датчик "), "p_name")).when(k % 4 == 2, F.concat(F.lit("Фасонные элементы "), "p_name")).otherwise(F.col("p_name"))
    code = F.when(k % 4 == 1, "71.20.1").when(k % 4 == 2, "96.09.1").otherwise("26.12.1")
    better = F.when(k % 8 == 0, "27.32.11").when(k % 8 == 1, "26.51.52").when(k % 8 == 5, "71.20.1").when(k % 8 == 2, "25.11.11").when((k % 8).isin(3, 7), "27.32.11")
    m = table(spark, d, "part").select(k.alias("id"), classify.mend(name, code, F.lit(""), F.lit(0.8), better, F.lit(""), F.lit(0.9), F.lit(True)).alias("m"))
    return m.select("id", "m.mended", "m.code")


_BARE = "trim(regexp_replace(trim(regexp_replace(regexp_replace(name, '\\b\\d+[xхXХ]\\d+([xхXХ]\\d+)?\\b', '', 'g'), '[!@#$%^&*_=+<>?/\\\\|~`]', ' ', 'g')), '\\s+', ' ', 'g'))"
_MODEL = next(p.regex for p in patterns.PATTERNS if p.kind == "model")


@query(f"""WITH {ITEMS}, n AS (SELECT id, CASE WHEN id % 6 = 0 THEN name || ' 5x7' WHEN id % 6 = 1 THEN name || ' XR-200' ELSE name END AS name FROM items),
  f AS (SELECT id, name, len(regexp_extract_all(name, '\\b\\d+[xхXХ]\\d+([xхXХ]\\d+)?\\b')) AS sizes, len(regexp_extract_all(name, '[!@#$%^&*_=+<>?/\\\\|~`]')) AS signs, len(regexp_extract_all(name, '{_MODEL}')) AS models,
    CASE WHEN sizes + signs > 0 THEN {_BARE} ELSE trim(regexp_replace(name, '\\s+', ' ', 'g')) END AS fixed FROM n),
  a AS (SELECT *, models > 0 OR sizes + signs + models > 3 OR lower(trim(fixed)) = lower(trim(name)) AS asked FROM f),
  c AS (SELECT *, CASE WHEN asked THEN CASE length(name) % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.65 WHEN 2 THEN 0.3 ELSE 0.7 END
    WHEN sizes + signs = 0 THEN 1.0 ELSE (sizes * 0.85 + signs * 0.8) / (sizes + signs) * 0.95 END::DOUBLE AS confidence FROM a)
  SELECT id, fixed, CASE WHEN asked AND length(name) % 4 < 2 THEN fixed || ' m' ELSE fixed END AS suggested, round(confidence, 6) AS confidence, asked, confidence < 0.7 OR models > 0 OR sizes + signs + models > 5 AS review FROM c""")
def corrections(spark, d):
    """Names mended by three rules, and by a stub of a model where these are not enough; a fourth of its answers is missing."""
    i = items(spark, d).select("id", F.when(F.col("id") % 6 == 0, F.concat("name", F.lit(" 5x7"))).when(F.col("id") % 6 == 1, F.concat("name", F.lit(" XR-200"))).otherwise(F.col("name")).alias("name"))
    picked = [p for p in patterns.PATTERNS if p.kind in ("dimension", "special_chars", "model")]

    def model(asked):
        return [(None if len(name) % 4 == 3 else f"{fixed} m", [0.9, 0.65, 0.3, 0.0][len(name) % 4]) for name, fixed, _ in asked]

    told = suggest_corrections(i, "name", model, picked)
    return told.select("id", "fixed", "suggested", F.round("confidence", 6).alias("confidence"), "asked", "review")


# For each schema: whether its first slot is required, the slots that are checked, and five values that fit.
_SLOTS = [
    ("StandardProduct", False, [3], ["brand", "model", "red", "10x20", "steel"]), ("Electronics", True, [2, 3], ["brand", "model", "5W", "220V", "red"]),
    ("Furniture", True, [3], ["table", "wood", "red", "10x20", "maker"]), ("Tools", True, [3, 4], ["drill", "brand", "model", "5W", "2kg"]),
    ("BuildingMaterials", True, [2, 3], ["brick", "clay", "10x20", "5mm", "red"]),
]
_ERRORS = "CASE p_partkey % 15 // 5 WHEN 0 THEN 0 WHEN 1 THEN CASE p_partkey % 5 WHEN 0 THEN 0 ELSE 1 END ELSE CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN {len(c)}" for i, (_, _, c, _) in enumerate(_SLOTS)) + " END END"


@query(f"""SELECT p_partkey AS id, ({_ERRORS})::INT AS errors, (5 - CASE p_partkey % 15 // 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE {_ERRORS} END)::INT AS attributes FROM part""")
def each_schema(spark, d):
    """A text for each schema: right, with an empty first slot, and with wrong values in the slots that are checked."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("id"), (k % 5).alias("v"), F.floor(k % 15 / 5).alias("fault"))
    errors, attributes = F.lit(None), F.lit(None)
    for i, (name, _, checked, values) in enumerate(_SLOTS):
        slots = [F.when((F.col("fault") == 1) & F.lit(j == 0), "").when((F.col("fault") == 2) & F.lit(j in checked), "none").otherwise(v) for j, v in enumerate(values)]
        good, bad = parsing.extract_by_position(F.array(*slots), parsing.SCHEMAS[name])
        errors, attributes = F.when(F.col("v") == i, F.size(bad)).otherwise(errors), F.when(F.col("v") == i, F.size(good)).otherwise(attributes)
    return p.select("id", errors.cast("int").alias("errors"), attributes.cast("int").alias("attributes"))
