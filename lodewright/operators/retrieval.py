"""Candidates before a model: the entries that share a name's rarest words, at most k a name.

Entries are titles of codes or names that have been classified. An entry's place
in a name's list is that of the rarest word they share, then the shorter title,
then the key. So the index needs no more than k entries a word: whoever
is beyond them comes behind k others for every name that has the word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_index(entries: DataFrame, tokens: Column, key: str = "code", k: int = 5) -> DataFrame:
    """(word, df, size, key) of ``entries``: for each word how many have it, and
    the ``k`` of the fewest words (of equals those of the smaller key). Keys
    should be unique; entries without words, or with a null key, are left out."""
    each = entries.select(F.col(key).alias("key"), F.array_distinct(tokens).alias("set")).filter("key is not null")
    each = each.select("key", F.size("set").alias("size"), F.explode("set").alias("word"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    # Spark keeps k rows a word in each task before it shuffles
    place = F.row_number().over(Window.partitionBy("word").orderBy("size", "key"))
    few = each.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")
    return few.join(df, "word").select("word", "df", "size", "key")


def candidates(names: DataFrame, tokens: Column, index: DataFrame, k: int = 5) -> DataFrame:
    """(id, place, key, word): for each name (id, …) at most ``k`` entries of
    ``word_index`` (of the same ``k`` or more), the best at place 1, with the
    rarest word they share; of equally rare words the first in order counts."""
    each = names.select("id", F.explode(F.array_distinct(tokens)).alias("word"))
    met = each.join(index, "word").groupBy("id", "key").agg(F.min(F.struct("df", "word", "size")).alias("best"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("best.df", "best.word", "best.size", "key"))
    return met.withColumn("place", place).filter(F.col("place") <= k).select("id", "place", "key", F.col("best.word").alias("word"))


def classify_among(items: DataFrame, name: str, tokens: Callable[[Column], Column], index: DataFrame, model: Callable[[list[tuple[str, list[str]]]], list[tuple[str | None, float]]], k: int = 5, batch: int = 64) -> DataFrame:
    """``items`` plus code and confidence by a model that sees each distinct name
    with its candidates, and may choose among these alone: another answer counts
    as none. Names without a candidate aren't asked. Columns code and confidence of ``items`` are replaced."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            asked = [(n, list(c)) for n, c in zip(f["id"], f["keys"], strict=True)]
            got = [x for i in range(0, len(asked), batch) for x in model(asked[i : i + batch])]
            good = [(n, code, float(sure)) for (n, keys), (code, sure) in zip(asked, got, strict=True) if code in keys]
            yield pd.DataFrame(good, columns=["_name", "code", "confidence"])

    once = items.select(F.col(name).alias("id")).filter("id is not null").distinct()
    few = candidates(once, tokens(F.col("id")), index, k).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "key")))["key"].alias("keys"))
    told = few.mapInPandas(ask, "_name string, code string, confidence double")
    return items.drop("code", "confidence").join(told, F.col(name) == F.col("_name"), "left").drop("_name")


def similar_context(names: DataFrame, tokens: Column, classified: DataFrame, classified_tokens: Column, k: int = 5) -> DataFrame:
    """``names`` (id, …) plus ``similar``: an array of (name, category) of the
    ``k`` best of ``classified`` (name, category), and ``source``: ``similar`` or
    ``none``. Classified names come once each, with the first category in order."""
    once = classified.filter("name is not null and category is not null").groupBy("name").agg(F.min("category").alias("category"))
    found = candidates(names, tokens, word_index(once, classified_tokens, "name", k), k).join(once.withColumnRenamed("name", "key"), "key")
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("key").alias("name"), "category"))).alias("s"))
    pairs = F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["category"].alias("category")))
    told = names.join(lists.select("id", pairs.alias("similar")), "id", "left")
    none = F.array().cast("array<struct<name:string,category:string>>")
    return told.withColumn("source", F.when(F.col("similar").isNull(), "none").otherwise("similar")).withColumn("similar", F.coalesce("similar", none))
