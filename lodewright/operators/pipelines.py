"""Operators that put several of the others together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import Rule, default_rules, suggestions, violations


def benchmark_first(items: DataFrame, benchmarks: DataFrame, categorize: Callable[[Column], Column], normalize: Callable[[Column], Column]) -> DataFrame:
    """``items`` (id, name) plus category, normalized_name and ``by_benchmark``.

    A name that is a benchmark's original or normalised one (trimmed, in any
    case) takes the best benchmark's category and name: by quality, then usage;
    the rules name the others. ``benchmarks`` has original_name,
    normalized_name, category, quality and usage. One row per row of ``items``.
    """
    key = lambda c: F.lower(F.trim(F.col(c)))
    both = [benchmarks.withColumn("_key", key(c)) for c in ("original_name", "normalized_name")]
    order = F.struct("quality", "usage", "normalized_name")
    best = both[0].unionByName(both[1]).filter("_key <> ''").groupBy("_key").agg(F.max_by(F.struct("category", "normalized_name"), order).alias("_best"))
    told = items.withColumn("_key", key("name")).join(best, "_key", "left")
    hit = F.col("_best").isNotNull()
    category = F.when(hit, F.col("_best.category")).otherwise(categorize(F.col("name")))
    name = F.when(hit, F.col("_best.normalized_name")).otherwise(normalize(F.col("name")))
    return told.withColumns({"category": category, "normalized_name": name, "by_benchmark": hit}).drop("_key", "_best")


def compare_projects(scores: DataFrame, project: str, score: str) -> DataFrame:
    """``scores`` (a row per project) plus ``place``: 1 for the best. Projects are few, so one task orders them."""
    return scores.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), project)).cast("long"))


#: Columns that the rules read, and what stands for one that a table lacks.
RULE_COLUMNS = {"normalized_name": "", "code": "", "category": "", "kpved_code": "", "kpved_confidence": 0.0, "processing_level": "basic", "ai_confidence": 0.0, "ai_reasoning": ""}


def _named(df: DataFrame, ident: str, columns: dict[str, str]) -> DataFrame:
    return df.select(ident, *[F.col(columns[c]).alias(c) if c in columns else F.lit(v).alias(c) for c, v in RULE_COLUMNS.items()])


def table_violations(df: DataFrame, ident: str, columns: dict[str, str], rules: list[Rule] | None = None) -> DataFrame:
    """(ident, rule, category, severity, field, value) of a table whose columns go
    by other names: ``columns`` maps those of the rules to the table's."""
    return _named(df, ident, columns).select(ident, F.explode(violations(rules or default_rules())).alias("v")).select(ident, "v.*")


def table_suggestions(df: DataFrame, ident: str, columns: dict[str, str]) -> DataFrame:
    """(ident, type, priority, field, …) as ``quality.suggestions`` makes them of such a table."""
    return _named(df, ident, columns).select(ident, F.explode(suggestions(violations())).alias("s")).select(ident, "s.*")
