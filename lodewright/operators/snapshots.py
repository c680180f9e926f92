"""Versions of a catalog: latest uploads, comparisons, evolution, staged edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Of stored and new rows of one key the one with the highest ``seq``, in
    whatever order batches arrive. Both tables carry it; of equal ``seq`` the new
    row wins, of new rows the one whose other columns come last in order."""
    rest = sorted(c for c in stored.columns if c not in (*keys, seq))
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.select(*stored.columns).withColumn("_new", F.lit(1)))
    return latest_per(both, keys, [F.desc(seq), F.desc("_new"), *[F.desc(c) for c in rest]]).drop("_new")


def insert_missing(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return stored.unionByName(new.join(stored.select(*keys), keys, "left_anti"))


def keep_newest(df: DataFrame, ident: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(ident)).limit(n)


def compare_uploads(items: DataFrame, upload: str, catalog: str) -> DataFrame:
    """Items and catalogs of each upload."""
    return items.groupBy(upload).agg(F.count("*").alias("items"), F.countDistinct(catalog).alias("catalogs"))


def upload_scores(items: DataFrame, upload: str, name: str) -> DataFrame:
    """Distinct filled names over items, per upload."""
    return items.groupBy(upload).agg((F.countDistinct(F.when(F.col(name) != "", F.col(name))) / F.count("*")).alias("score"))


def trend(scores: DataFrame, order: str, by: float = 0.1) -> DataFrame:
    """One row: first and last score in order and whether they show a trend."""
    ends = scores.agg(F.min_by("score", order).alias("first_score"), F.max_by("score", order).alias("last_score"))
    change = F.col("last_score") - F.col("first_score")
    return ends.withColumn("trend", F.when(change > by, "improving").when(change < -by, "degrading").otherwise("stable"))


def evolution(items: DataFrame, key: str, name: str, iteration: list[str]) -> DataFrame:
    """Per key: rows, the first name and the status (new, modified, stable)."""
    told = items.groupBy(key).agg(F.count("*").alias("rows"), F.min_by(name, F.struct(*iteration)).alias("first_name"), F.min(name).alias("lo"), F.max(name).alias("hi"))
    status = F.when(F.col("rows") == 1, "new").when(F.col("lo") != F.col("hi"), "modified").otherwise("stable")
    return told.select(key, "rows", "first_name", status.alias("status"))


def master_references(items: DataFrame, key: str, name: str, reference: str) -> DataFrame:
    """Per key the reference of the first item by lower-case name."""
    return items.groupBy(key).agg(F.min_by(reference, F.struct(F.lower(name), F.col(reference))).alias("master_reference"))


def master_names(items: DataFrame, name: str, reference: str, normalize: Callable[[Column], Column]) -> DataFrame:
    """(normalized_name, reference): of each normalised name the reference of the
    first item by lower-case name; names that leave nothing are left out."""
    told = items.withColumn("_bare", normalize(F.col(name))).filter("_bare <> ''")
    return master_references(told, "_bare", name, reference).select(F.col("_bare").alias("normalized_name"), F.col("master_reference").alias("reference"))


def normalize_upload(items: DataFrame, master: DataFrame, name: str, reference: str, normalize: Callable[[Column], Column]) -> DataFrame:
    """``items`` plus normalized_name and normalized_reference: that of
    ``master`` (normalized_name, reference), or the item's own where it has none.
    A name of which nothing is left stays as it is; a null one stays null."""
    bare = normalize(F.col(name))
    told = items.withColumn("normalized_name", F.when(bare == "", F.col(name)).otherwise(bare))
    known = master.select(F.col("normalized_name").alias("_name"), F.col("reference").alias("_reference"))
    out = told.join(known, told["normalized_name"] == known["_name"], "left")
    return out.withColumn("normalized_reference", F.coalesce("_reference", F.col(reference))).drop("_name", "_reference")


def stage_state(stages: DataFrame, item: str, stage: str, output: str, upto: int | None = None) -> DataFrame:
    """The current name of each item: the output of its last stage, or of the last up to ``upto`` after a revert."""
    kept = stages if upto is None else stages.filter(F.col(stage) <= upto)
    return kept.groupBy(item).agg(F.max_by(output, stage).alias("current_name"), F.max(stage).alias("last_stage"), F.count("*").alias("stages"))


def keep_recent(df: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    """Rows that are at most ``days`` days older than ``as_of``."""
    return df.filter(F.col(at) >= as_of - F.make_dt_interval(F.lit(days)))


def members_of(snapshot: DataFrame, uploads: DataFrame, upload: str = "upload_id", order: str = "upload_order") -> DataFrame:
    """The uploads of a snapshot (its id, upload, order) with their own columns."""
    return snapshot.join(uploads, upload).orderBy(order)


def change_counts(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(added, updated, removed, unchanged): one row over two versions of a table with unique keys."""
    a, b = before.select(key, F.col(value).alias("_a"), F.lit(1).alias("_old")), after.select(key, F.col(value).alias("_b"), F.lit(1).alias("_new"))
    n = lambda c: F.count(F.when(c, 1))
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    same = F.col("_a").eqNullSafe(F.col("_b"))
    return a.join(b, key, "full").agg(n(F.col("_old").isNull()).alias("added"), n(both & ~same).alias("updated"), n(F.col("_new").isNull()).alias("removed"), n(both & same).alias("unchanged"))


def start_session(items: DataFrame, item: str, name: str) -> DataFrame:
    """The stage table (item, stage, kind, input, output) of a session: each item's name as stage 0."""
    return items.select(F.col(item).alias("item"), F.lit(0).alias("stage"), F.lit("start").alias("kind"), F.col(name).alias("input"), F.col(name).alias("output"))


def apply_stage(stages: DataFrame, kind: str, change: Callable[[Column], Column]) -> DataFrame:
    """``stages`` plus one more per item: ``change`` of its last output."""
    last = stages.groupBy("item").agg(F.max("stage").alias("stage"), F.max_by("output", "stage").alias("input"))
    return stages.unionByName(last.select("item", (F.col("stage") + 1).alias("stage"), F.lit(kind).alias("kind"), "input", change(F.col("input")).alias("output")))


def revert(stages: DataFrame, upto: int) -> DataFrame:
    """``stages`` without those after ``upto``."""
    return stages.filter(F.col("stage") <= upto)


def complete_session(stages: DataFrame) -> DataFrame:
    """(item, original, final, stages, changed): what a session made of each item."""
    told = stages.groupBy("item").agg(F.min_by("output", "stage").alias("original"), F.max_by("output", "stage").alias("final"), F.count("*").alias("stages"))
    return told.withColumn("changed", ~F.col("original").eqNullSafe(F.col("final")))
