"""Quality scores, rule violations, suggestions, and metrics of uploads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.functions import dictionaries as D
from lodewright.functions import names, validators
from lodewright.functions.text import any_contains, clamp, is_filled, squeeze


def category_confidence(category: Column, source: Column, confirming: dict[str, list[str]] = D.CONFIRMING, other: str = D.OTHER) -> Column:
    low = F.lower(F.coalesce(source, F.lit("")))
    out = F.lit(0.7)
    for c, words in reversed(confirming.items()):
        out = F.when(F.lower(category) == c, F.when(any_contains(low, words), 0.95).otherwise(0.6)).otherwise(out)
    return F.when(category == other, 0.3).otherwise(out)


def _floor(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def name_clarity(name: Column) -> Column:
    n = F.length(name)
    size = F.when(n < 3, 0.5).when(n < 10, 0.2).when(n > 100, 0.3).when(n > 50, 0.1).otherwise(0.0)
    digits = F.length(F.regexp_replace(name, r"\P{Nd}", ""))
    letters = F.length(F.regexp_replace(name, r"\P{L}", ""))
    special = F.length(F.regexp_replace(name, r"[\p{L}\p{Nd}\s\x{A0}]", ""))
    less = size + F.when(digits / n > 0.4, 0.2).otherwise(0.0) + F.when(special / n > 0.05, 0.3).otherwise(0.0)
    less = less + F.when(letters == 0, 0.5).otherwise(0.0) + F.when(name != F.lower(name), 0.1).otherwise(0.0)
    return F.when(F.coalesce(name, F.lit("")) == "", 0.0).otherwise(_floor(1.0 - less))


def name_consistency(source: Column, name: Column, before: Column | None = None, after: Column | None = None) -> Column:
    """How many key words of the source the name keeps, as a score; key words may be given."""
    before = names.key_words(source) if before is None else before
    after = names.key_words(name) if after is None else after
    kept = F.size(F.filter(before, lambda s: F.exists(after, lambda w: w.contains(s) | s.contains(w))))
    rate = kept / F.size(before)
    score = F.when(rate < 0.3, 0.5).when(rate < 0.5, 0.7).when(rate < 0.7, 0.9).otherwise(1.0)
    empty = (F.coalesce(source, F.lit("")) == "") | (F.coalesce(name, F.lit("")) == "")
    return F.when(empty, 0.0).when(F.size(before) == 0, 0.5).otherwise(score)


def completeness(name: Column, category: Column, other: str = D.OTHER, after: Column | None = None) -> Column:
    text = F.coalesce(name, F.lit(""))
    less = F.when(text == "", 0.5).otherwise(0.0) + F.when(F.coalesce(category, F.lit("")).isin("", other), 0.3).otherwise(0.0)
    return _floor(1.0 - less - F.when(F.size(names.key_words(text) if after is None else after) == 0, 0.2).otherwise(0.0))


def standardisation(name: Column) -> Column:
    text = F.coalesce(name, F.lit(""))
    low = F.lower(text)
    less = F.when(text != F.trim(text), 0.2).otherwise(0.0) + F.when(text.contains("  "), 0.1).otherwise(0.0)
    less = less + F.when(low.startswith("арт") | low.startswith("код"), 0.3).otherwise(0.0)
    return _floor(1.0 - less - F.when(text.startswith("-") | text.endswith("-"), 0.1).otherwise(0.0))


def quality_score(source: Column, name: Column, category: Column, ai_confidence: Column, level: Column, other: str = D.OTHER, confirming: dict[str, list[str]] = D.CONFIRMING, before: Column | None = None, after: Column | None = None) -> Column:
    """Struct of the five parts, the bonus, ``overall`` and ``is_benchmark``."""
    parts = {
        "category": (category_confidence(category, source, confirming, other), 0.20),
        "clarity": (name_clarity(name), 0.25),
        "consistency": (name_consistency(source, name, before, after), 0.20),
        "completeness": (completeness(name, category, other, after), 0.15),
        "standardisation": (standardisation(name), 0.20),
    }
    bonus = F.when((level == "ai_enhanced") & (ai_confidence > 0), ai_confidence * 0.1).otherwise(0.0)
    overall = F.least(reduce(lambda a, b: a + b, (c * w for c, w in parts.values())) + bonus, F.lit(1.0))
    return F.struct(*[c.alias(k) for k, (c, _) in parts.items()], bonus.alias("bonus"), overall.alias("overall"), (overall >= 0.9).alias("is_benchmark"))


def with_quality(items: DataFrame, source: str, name: str, category: str, ai_confidence: str, level: str, other: str = D.OTHER, confirming: dict[str, list[str]] = D.CONFIRMING, out: str = "q") -> DataFrame:
    """``items`` plus the struct of ``quality_score``; key words and parts are computed once per row and kept in columns."""
    told = items.withColumn("_before", names.key_words(F.col(source))).withColumn("_after", names.key_words(F.col(name)))
    parts = quality_score(F.col(source), F.col(name), F.col(category), F.col(ai_confidence), F.col(level), other, confirming, F.col("_before"), F.col("_after"))
    return told.withColumn(out, parts).drop("_before", "_after")


@dataclass(frozen=True)
class Rule:
    """A rule holds a condition over item columns that is true where it is broken."""

    name: str
    category: str
    severity: str
    field: str
    broken: Callable[[], Column]


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def default_rules() -> list[Rule]:
    name, code, kpved, level = _text("normalized_name"), _text("code"), _text("kpved_code"), _text("processing_level")
    return [
        Rule("require_normalized_name", "completeness", "critical", "normalized_name", lambda: name == ""),
        Rule("require_category", "completeness", "critical", "category", lambda: _text("category") == ""),
        Rule("require_kpved_code", "completeness", "warning", "kpved_code", lambda: kpved == ""),
        Rule("require_code", "completeness", "error", "code", lambda: code == ""),
        Rule("valid_kpved_format", "format", "error", "kpved_code", lambda: (kpved != "") & ~validators.valid_kpved(F.trim(kpved))),
        Rule("name_length", "format", "warning", "normalized_name", lambda: (F.length(name) < 3) | (F.length(name) > 100)),
        Rule("name_format", "format", "error", "normalized_name", lambda: (name != "") & ~name.rlike(r"\p{L}")),
        Rule("kpved_confidence_threshold", "accuracy", "warning", "kpved_confidence", lambda: (kpved != "") & (F.coalesce("kpved_confidence", F.lit(0.0)) < 0.7)),
        Rule("ai_confidence_threshold", "accuracy", "info", "ai_confidence", lambda: (level == "ai_enhanced") & (F.coalesce("ai_confidence", F.lit(0.0)) < 0.8)),
        Rule("category_other", "consistency", "warning", "category", lambda: F.lower(_text("category")).isin(D.OTHER, "other")),
        Rule("processing_level", "completeness", "info", "processing_level", lambda: ~level.isin("basic", "ai_enhanced", "benchmark")),
        Rule("ai_reasoning", "completeness", "info", "ai_reasoning", lambda: level.isin("ai_enhanced", "benchmark") & (F.octet_length(_text("ai_reasoning")) < 10)),
    ]


def violations(rules: list[Rule] | None = None, severity: str | None = None) -> Column:
    """Array of (rule, category, severity, field, value) of the rules that a row breaks."""
    picked = [r for r in rules or default_rules() if severity in (None, r.severity)]
    return F.array_compact(
        F.array(*[F.when(r.broken(), F.struct(F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.field).alias("field"), F.coalesce(F.col(r.field).cast("string"), F.lit("")).alias("value"))) for r in picked])
    )


def suspicious(name: Column) -> Column:
    return any_contains(F.lower(name), D.SUSPICIOUS)


def clean_suspicious(name: Column) -> Column:
    return squeeze(reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), D.SUSPICIOUS_REMOVED, F.lower(name)))


#: Rank of a priority, its weight on the impact, and the impact of each kind.
PRIORITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}
PRIORITY_WEIGHT = {"critical": 1.5, "high": 1.3, "medium": 1.0, "low": 0.7}
IMPACT = {"set_value": 0.05, "correct_format": 0.03, "reprocess": 0.15, "merge": 0.10, "review": 0.08}


def suggestions(broken: Column) -> Column:
    """Array of (type, priority, field, suggested_value, confidence, auto_applyable):
    one for each violation that can be acted on, then the proactive ones."""
    name, kpved, level = _text("normalized_name"), _text("kpved_code"), _text("processing_level")

    def made(kind: str, priority: str, field: str, value: Column | str, confidence: float, auto: bool) -> Column:
        v = F.lit(value) if isinstance(value, str) else value
        return F.struct(F.lit(kind).alias("type"), F.lit(priority).alias("priority"), F.lit(field).alias("field"), v.alias("suggested_value"), F.lit(confidence).alias("confidence"), F.lit(auto).alias("auto_applyable"))

    answers = {
        "require_kpved_code": made("reprocess", "high", "kpved_code", "classify", 0.8, True),
        "valid_kpved_format": made("correct_format", "medium", "kpved_code", validators.repair_kpved(kpved), 0.6, False),
        "category_other": made("reprocess", "medium", "category", "reclassify", 0.7, True),
        "name_length": made("correct_format", "low", "normalized_name", names.trim_words(name, 100), 0.5, False),
        "kpved_confidence_threshold": made("review", "medium", "kpved_code", "review", 0.9, False),
        "ai_confidence_threshold": made("reprocess", "low", "category", "reprocess", 0.6, True),
    }

    def answer(v: Column) -> Column:
        out = F.lit(None)
        for rule, s in reversed(answers.items()):
            fits = (v["rule"] == rule) & (F.length(name) > 100) if rule == "name_length" else v["rule"] == rule
            out = F.when(fits, s).otherwise(out)
        return out

    proactive = F.array(
        F.when(level == "basic", made("reprocess", "medium", "processing_level", "ai_enhanced", 0.8, True)),
        F.when((kpved == "") & (level != "basic"), made("reprocess", "high", "kpved_code", "classify", 0.9, True)),
        F.when(suspicious(name), made("correct_format", "medium", "normalized_name", clean_suspicious(name), 0.7, False)),
    )
    return F.array_compact(F.concat(F.transform(broken, answer), proactive))


def suggestion_rank(priority: Column, confidence: Column) -> Column:
    """Higher first."""
    return reduce(lambda c, kv: F.when(priority == kv[0], kv[1]).otherwise(c), PRIORITY.items(), F.lit(0)) + confidence


def suggestion_impact(kind: Column, priority: Column, confidence: Column, quality: Column) -> Column:
    """How much quality a suggestion would add; quality ends at 1."""
    base = reduce(lambda c, kv: F.when(kind == kv[0], kv[1]).otherwise(c), IMPACT.items(), F.lit(0.0))
    weight = reduce(lambda c, kv: F.when(priority == kv[0], kv[1]).otherwise(c), PRIORITY_WEIGHT.items(), F.lit(0.0))
    return F.least(base * weight * confidence, 1.0 - quality)


def _share(c: Column) -> Column:
    """Percent of rows for which a condition holds; 0 of none."""
    return clamp(F.count(F.when(c, 1)) / F.nullif(F.count("*"), F.lit(0)) * 100)


def _status(value: Column, good: float, fair: float) -> Column:
    return F.when(value >= good, "PASS").when(value >= fair, "WARNING").otherwise("FAIL")


def completeness_metric(items: DataFrame, by: str, code: str, name: str, characteristic: str) -> DataFrame:
    """Per upload: shares of filled codes, names, characteristics; their value and status."""
    shares = items.groupBy(by).agg(F.count("*").alias("total"), *[_share(is_filled(F.col(c))).alias(a) for c, a in ((code, "code_share"), (name, "name_share"), (characteristic, "characteristic_share"))])
    value = clamp((F.col("code_share") + F.col("name_share")) / 2)
    return shares.withColumn("value", value).withColumn("status", _status(value, 95, 80))


def uniqueness_metric(items: DataFrame, by: str, code: str) -> DataFrame:
    """Per upload: rows whose code occurs once, in percent of all rows. Two
    aggregations with a partial one each; a hot code is no problem."""
    counts = items.groupBy(by, code).agg(F.count("*").alias("n"))
    again = F.sum(F.when(is_filled(F.col(code).cast("string")) & (F.col("n") > 1), F.col("n")).otherwise(0))
    sums = counts.groupBy(by).agg(F.sum("n").alias("total"), again.alias("duplicates"))
    value = clamp((F.col("total") - F.col("duplicates")) / F.col("total") * 100)
    return sums.withColumn("value", value).withColumn("status", _status(value, 99, 95))


def validity_metric(items: DataFrame, by: str, code: str, name: str) -> DataFrame:
    """Per upload: 100 less the percent of missing codes and of missing names."""
    missing = [F.count(F.when(~is_filled(F.col(c)), 1)).alias(a) for c, a in ((code, "invalid_codes"), (name, "invalid_names"))]
    sums = items.groupBy(by).agg(F.count("*").alias("total"), *missing)
    value = clamp((F.col("total") - F.col("invalid_codes") - F.col("invalid_names")) / F.col("total") * 100)
    return sums.withColumn("value", value).withColumn("status", _status(value, 95, 80))


def consistency_metric(items: DataFrame, by: str, name: str, characteristic: str) -> DataFrame:
    """Per upload: rows whose name and characteristic are both filled or both missing, in percent."""
    same = is_filled(F.col(name)) == is_filled(F.col(characteristic))
    sums = items.groupBy(by).agg(F.count("*").alias("total"), F.count(F.when(same, 1)).alias("consistent"))
    value = clamp(F.col("consistent") / F.col("total") * 100)
    return sums.withColumn("value", value).withColumn("status", _status(value, 95, 80))


def counterparty_metric(parties: DataFrame, name: str, inn: str, kpp: str, attributes: str) -> DataFrame:
    """One row. Completeness: the mean share of filled tax numbers, their codes,
    addresses and contacts (words in the attributes). Uniqueness: the lower of
    the shares of rows whose tax number, and whose name, occurs once."""
    address, contact = (validators.has_any(F.col(attributes), w) for w in (validators.ADDRESS_WORDS, validators.CONTACT_WORDS))
    full = parties.agg(F.count("*").alias("total"), _share(is_filled(F.col(name))).alias("names"), _share(is_filled(F.col(inn))).alias("inns"), _share(is_filled(F.col(kpp))).alias("kpps"), _share(address).alias("addresses"), _share(contact).alias("contacts"))
    value = (F.col("inns") + F.col("kpps") + F.col("addresses") + F.col("contacts")) / 4
    told = full.withColumn("completeness", value).withColumn("completeness_status", _status(value, 80, 60))
    for c, out in ((inn, "again_inn"), (name, "again_name")):
        again = parties.filter(is_filled(F.col(c))).groupBy(c).agg(F.count("*").alias("n")).filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias(out))
        told = told.crossJoin(again)  # one row each
    unique = F.when(F.col("total") == 0, 100.0).otherwise((F.col("total") - F.greatest("again_inn", "again_name")) / F.col("total") * 100)
    return told.withColumn("uniqueness", unique).withColumn("uniqueness_status", _status(unique, 99, 95))


def number_issues(parties: DataFrame, ident: str, attributes: str) -> DataFrame:
    """(ident, issue, severity, value): tax numbers and their codes that stand in the attributes and are wrong."""
    kinds = [("invalid_inn", "HIGH", validators.extract_inn, validators.valid_inn), ("invalid_kpp", "MEDIUM", validators.extract_kpp, validators.valid_kpp)]
    found = [(kind, severity, take(F.col(attributes)), good) for kind, severity, take, good in kinds]
    issues = F.array_compact(F.array(*[F.when(v.isNotNull() & ~good(v), F.struct(F.lit(kind).alias("issue"), F.lit(severity).alias("severity"), v.alias("value"))) for kind, severity, v, good in found]))
    return parties.select(ident, F.explode(issues).alias("i")).select(ident, "i.*")


def upload_metrics(items: DataFrame, by: str, code: str, name: str, characteristic: str) -> DataFrame:
    """(by, category, value, status): the four metrics of every upload, in rows, and ``overall``, their mean."""
    kinds = {
        "completeness": completeness_metric(items, by, code, name, characteristic), "uniqueness": uniqueness_metric(items, by, code),
        "validity": validity_metric(items, by, code, name), "consistency": consistency_metric(items, by, name, characteristic),
    }
    rows = [df.select(by, F.lit(k).alias("category"), "value", "status") for k, df in kinds.items()]
    each = reduce(lambda a, b: a.unionByName(b), rows)
    overall = each.groupBy(by).agg(F.avg("value").alias("value"))
    return each.unionByName(overall.select(by, F.lit("overall").alias("category"), "value", _status(F.col("value"), 90, 70).alias("status")))


def validate_before_ingest(name: str = "name", code: str = "code") -> tuple[Column, Column]:
    """Errors and warnings (arrays of names) of a row; only ``empty_name`` blocks it."""
    n, c = _text(name), _text(code)
    errors = F.array_compact(F.array(
        F.when(F.trim(n) == "", "empty_name"),
        F.when(F.octet_length(n) > 500, "name_too_long"),
        F.when((F.trim(n) != "") & (F.length(F.trim(n)) < 2), "name_too_short"),
        F.when(n.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), "control_characters"),
        F.when(c.rlike(r"\s"), "space_in_code"),
        F.when(F.octet_length(c) > 100, "code_too_long"),
    ))
    warnings = F.array_compact(F.array(
        F.when(c == "", "no_code"),
        F.when(n != F.trim(n), "space_around_name"),
        F.when((n != "") & (n == F.upper(n)) & (n != F.lower(n)), "upper_case_name"),
        F.when((n != "") & ~n.rlike(r"\p{L}"), "no_letters"),
    ))
    return errors, warnings


def kpved_accuracy(code: Column, confidence: Column) -> Column:
    text = F.coalesce(code, F.lit(""))
    score = 0.4 + F.when(validators.valid_kpved(F.trim(text)), 0.3).otherwise(0.0) + F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)) * 0.3
    return F.when(text == "", 0.0).otherwise(F.least(score, F.lit(1.0)))


def data_enrichment(reasoning: Column, code: Column, level: Column) -> Column:
    bonus = F.when(level == "benchmark", 0.3).when(level == "ai_enhanced", 0.2).otherwise(0.0)
    told = F.when(F.octet_length(F.coalesce(reasoning, F.lit(""))) > 10, 0.4).otherwise(0.0)
    return F.least(told + F.when(F.coalesce(code, F.lit("")) != "", 0.3).otherwise(0.0) + bonus, F.lit(1.0))


def extended_score(base: Column, accuracy: Column, duplicate: Column, enrichment: Column) -> Column:
    """The score over eight parts; ``base`` is the struct of ``quality_score``."""
    weights = {"category": 0.15, "clarity": 0.20, "consistency": 0.15, "completeness": 0.10, "standardisation": 0.15}
    parts = reduce(lambda a, b: a + b, (base[k] * w for k, w in weights.items()))
    return F.least(parts + accuracy * 0.15 + F.when(duplicate, 0.0).otherwise(1.0) * 0.05 + enrichment * 0.05 + base["bonus"], F.lit(1.0))
