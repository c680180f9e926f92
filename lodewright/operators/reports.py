"""Report queries over catalog tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewright.functions.text import is_filled


def equals(df: DataFrame, given: dict[str, object]) -> DataFrame:
    """Rows whose columns have the given values."""
    return df.filter(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in given.items()), F.lit(True)))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def group_rollup(items: DataFrame, keys: list[str], confidence: str) -> DataFrame:
    """Per group: rows, mean and best confidence."""
    return items.groupBy(*keys).agg(F.count("*").alias("merged_count"), F.avg(confidence).alias("avg_confidence"), F.max(confidence).alias("max_confidence"))


def confidence_bands(items: DataFrame, code: str, confidence: str) -> DataFrame:
    """One row: all, classified, high (from 0.9), medium (from 0.7), low; in a single pass."""
    have, c = is_filled(F.col(code), trim=True), F.col(confidence)
    n = lambda cond: F.count(F.when(cond, 1))
    return items.agg(F.count("*").alias("total"), n(have).alias("classified"), n(have & (c >= 0.9)).alias("high"), n(have & (c >= 0.7) & (c < 0.9)).alias("medium"), n(have & (c < 0.7)).alias("low"))


def trend_pivot(metrics: DataFrame, by: list[str], category: str, value: str, categories: list[str]) -> DataFrame:
    """Mean value per category as columns, and the mean of those that exist."""
    means = metrics.groupBy(*by).agg(*[F.avg(F.when(F.col(category) == c, F.col(value))).alias(c) for c in categories])
    parts = F.array_compact(F.array(*categories))
    overall = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / F.size(parts)).otherwise(0.0)
    return means.withColumn("overall", overall)


def latest_batch(metrics: DataFrame, by: str, at: str) -> DataFrame:
    """Rows of the last measurement of each key."""
    last = metrics.groupBy(by).agg(F.max(at).alias(at))
    return metrics.join(last, [by, at], "left_semi")


#: The score that stands for a processing level without any confidence.
LEVEL_SCORES = {"basic": 50.0, "enhanced": 70.0, "ai_enhanced": 85.0, "benchmark": 95.0}


def level_stats(items: DataFrame, level: str, confidence: str) -> DataFrame:
    """Per level: rows, mean of positive confidences or the level's own score, percent of all."""
    name = F.coalesce(F.col(level), F.lit("basic"))
    base = reduce(lambda c, kv: F.when(F.col("level") == kv[0], kv[1]).otherwise(c), LEVEL_SCORES.items(), F.lit(0.0))
    grouped = items.groupBy(name.alias("level")).agg(F.count("*").alias("n"), F.avg(F.when(F.col(confidence) > 0, F.col(confidence))).alias("mean"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy()) * 100
    return grouped.select("level", "n", F.coalesce("mean", base).alias("avg_quality"), share.alias("percentage"))


def histogram(df: DataFrame, key: str, values: list[str] | None = None) -> DataFrame:
    """Rows per value; listed values that don't occur count 0."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    if values is None:
        return counts
    listed = df.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return F.broadcast(listed).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def severity_order(c: Column) -> Column:
    return F.when(c == "CRITICAL", 1).when(c == "HIGH", 2).when(c == "MEDIUM", 3).when(c == "LOW", 4).otherwise(5)


def stats_with_children(parents: DataFrame, key: str, children: DataFrame, child_key: str, grandchildren: DataFrame, link: str, grand_key: str) -> DataFrame:
    """Per parent: children and grandchildren, each side counted before it is joined."""
    grand = grandchildren.groupBy(F.col(grand_key).alias(link)).agg(F.count("*").alias("_g"))
    mid = children.join(grand, link, "left").groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias("_c"), F.sum(F.coalesce("_g", F.lit(0))).alias("_gs"))
    return parents.join(mid, key, "left").withColumn("child_count", F.coalesce("_c", F.lit(0))).withColumn("grandchild_count", F.coalesce("_gs", F.lit(0))).drop("_c", "_gs")


def best_match(queries: DataFrame, stored: DataFrame, steps: list[list[str]], ident: str, order: list[Column]) -> DataFrame:
    """For each query (query_id and columns) the stored row, other than the one
    of its own id, that agrees on all columns of the earliest step possible, the
    first by ``order``. Of each key only the first two stored rows are joined."""
    found = None
    for k, cols in enumerate(steps):
        keys = queries.select(F.col("query_id"), *[F.col(c) for c in cols])
        rank = F.row_number().over(Window.partitionBy(*cols).orderBy(*order))
        first = stored.withColumn("_rank", rank).filter(F.col("_rank") <= 2).drop("_rank")
        hit = first.join(keys, cols).filter(F.col(ident) != F.col("query_id")).withColumn("step", F.lit(k + 1))
        found = hit if found is None else found.unionByName(hit, allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("step", *order))
    return found.withColumn("_rank", rank).filter("_rank = 1").select("query_id", "step", F.col(ident).alias("match_id"))


def searched(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows of which one of the columns contains the text, in any case."""
    return df.filter(reduce(lambda a, b: a | b, (F.lower(F.col(c)).contains(text.lower()) for c in columns)))


def paged(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows, each with ``total``, the number of all."""
    total = df.agg(F.count("*").alias("total"))
    return page(df, order, offset, limit).join(F.broadcast(total))  # one row


def upload_items(items: DataFrame, upload: int, names: list[str] | None = None, catalog: str = "catalog") -> DataFrame:
    """Items of an upload, of given catalogs only if ``names`` are."""
    mine = items.filter(F.col("upload_id") == upload)
    return mine.filter(F.col(catalog).isin(names)) if names else mine


def unclassified(items: DataFrame, keys: list[str], code: str, count: str) -> DataFrame:
    """Groups without a code, those of the most rows first."""
    open_ = items.filter(~is_filled(F.col(code), trim=True))
    return open_.groupBy(*keys).agg(F.max(count).alias("merged_count")).orderBy(F.desc("merged_count"), *keys)


def overall_scores(metrics: DataFrame, by: str, value: str) -> DataFrame:
    """Mean of all metrics per upload."""
    return metrics.groupBy(by).agg(F.avg(value).alias("overall"), F.count("*").alias("metrics"))


def entity_scores(metrics: DataFrame, entity: str, category: str, value: str, at: str, categories: list[str]) -> DataFrame:
    """Per entity the last value of each category (0 if none) and the mean of those above 0."""
    last = [F.coalesce(F.max_by(F.when(F.col(category) == c, F.col(value)), F.when(F.col(category) == c, F.col(at))), F.lit(0.0)).alias(c) for c in categories]
    told = metrics.groupBy(entity).agg(*last)
    good = F.filter(F.array(*categories), lambda x: x > 0)
    return told.withColumn("overall", F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, x: a + x) / F.size(good)).otherwise(0.0))


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: the number of rows of each table."""
    counts = [df.agg(F.count("*").alias(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.crossJoin(b), counts)  # rows of one number each


def counters(events: DataFrame, kind: str, value: str) -> DataFrame:
    """Per kind of event: number, mean, least and most, and its share of all in percent."""
    told = events.groupBy(kind).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return told.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def enriched(members: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``members`` (group_id, id) with the name and code of the first of
    ``tables`` (id, name, code) that has the id; null where none has."""
    each = members.select("group_id", "id")
    for k, t in enumerate(tables):
        each = each.join(t.select("id", F.struct("name", "code", F.lit(k).alias("table")).alias(f"_{k}")), "id", "left")
    first = F.coalesce(*[F.col(f"_{k}") for k in range(len(tables))])
    return each.select("group_id", "id", first["name"].alias("name"), first["code"].alias("code"), first["table"].alias("table"))


def classification_counts(items: DataFrame, levels: list[str], confidence: str, strategy: str) -> DataFrame:
    """Per strategy and in all (strategy null): items, distinct filled values of each level, mean confidence."""
    per = [F.countDistinct(F.when(F.col(c) != "", F.col(c))).alias(f"distinct_{c}") for c in levels]
    told = [F.count("*").alias("items"), *per, F.avg(confidence).alias("avg_confidence")]
    return items.groupBy(strategy).agg(*told).unionByName(items.agg(*told).withColumn(strategy, F.lit(None).cast("string")))


def set_status(rows: DataFrame, ident: str, done: DataFrame, status: str, at: Column, by: str) -> DataFrame:
    """``rows`` (status, resolved_at, resolved_by, …) of which those that ``done``
    (ident) names are set to ``status``; rows that have it already stay as they are."""
    told = rows.join(done.select(ident).distinct().withColumn("_hit", F.lit(True)), ident, "left")
    hit = F.coalesce("_hit", F.lit(False)) & ~F.col("status").eqNullSafe(F.lit(status))
    new = {"status": F.lit(status), "resolved_at": at, "resolved_by": F.lit(by)}
    return told.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}).drop("_hit")


def html_report(df: DataFrame, columns: list[str], title: str) -> DataFrame:
    """(line): a table in HTML, a line per row, values escaped; for reports of a bounded size."""
    from lodewright.functions.answers import xml_escaped

    cell = lambda c: F.concat(F.lit("<td>"), xml_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    spark = df.sparkSession
    heads = "".join(f"<th>{c}</th>" for c in columns)
    head = spark.createDataFrame([(f"<html><head><meta charset=\"utf-8\"><title>{title}</title></head><body><table><tr>{heads}</tr>",)], "line string")
    tail = spark.createDataFrame([("</table></body></html>",)], "line string")
    return head.union(df.select(F.concat(F.lit("<tr>"), *[cell(c) for c in columns], F.lit("</tr>")).alias("line"))).union(tail)


def benchmark_lookup(names: DataFrame, name: str, benchmarks: DataFrame) -> DataFrame:
    """Best approved benchmark (id, original_name, normalized_name, quality, usage)
    whose original or normalised name equals ``name``; an OR-join as two equi-joins."""
    approved = benchmarks.filter("is_approved")
    by = [names.select(F.col(name).alias("_n")).distinct().join(approved.withColumn("_n", F.col(c)), "_n") for c in ("original_name", "normalized_name")]
    rank = F.row_number().over(Window.partitionBy("_n").orderBy(F.desc("quality"), F.desc("usage"), "id"))
    return by[0].unionByName(by[1]).withColumn("_rank", rank).filter("_rank = 1").select(F.col("_n").alias(name), F.col("id").alias("benchmark_id"))


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def waiting(df: DataFrame, status: str, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of the rows whose state is missing or pending; a missing one is shown as pending."""
    told = df.withColumn(status, F.coalesce(F.col(status), F.lit("pending")))
    return page(told.filter(F.col(status) == "pending"), order, offset, limit)


def incorrect(df: DataFrame, keys: list[str], more: list[str], limit: int = 100, status: str = "validation_status") -> DataFrame:
    """(keys, more, total): the first distinct rows marked incorrect, in order, and how many distinct keys without nulls there are."""
    wrong = df.filter(F.col(status) == "incorrect").select(*keys, *more).distinct()
    whole = F.forall(F.array(*keys), lambda k: k.isNotNull())
    total = wrong.filter(whole).select(*keys).distinct().agg(F.count("*").alias("total"))  # one row
    return wrong.orderBy(*keys, *more).limit(limit).crossJoin(F.broadcast(total))


def members(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """``df`` plus merged_count and first_id of its row's group; a null key is a key. Groups meet their rows by a join, so that a large one may be split."""
    groups = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("merged_count"), F.min(ident).alias("first_id"))
    same = reduce(lambda a, b: a & b, (df[k].eqNullSafe(groups[f"_{k}"]) for k in keys))
    return df.join(groups, same).drop(*[f"_{k}" for k in keys])


def extent(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, items, matches, least, most, mean, without): of a whole number by key, nulls as 0."""
    n = F.coalesce(F.col(value), F.lit(0)).cast("long")
    return df.groupBy(key).agg(F.count("*").alias("items"), F.sum(n).alias("matches"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.count(F.when(n == 0, 1)).alias("without"))
