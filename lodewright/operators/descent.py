"""A model led down a tree of codes, one question a name and level, with its answers kept.

Every level's questions and answers are written before the next level is read,
so nothing is asked twice, whatever reads the result. With a store, answers
stay for later runs: only what it doesn't know yet is asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .classify import classify_by_keyword, clean_name, mend, root_word
from .staging import Rounds, new_path

ANSWERS = "name string, code string, child string, sure double"
Model = Callable[[list[tuple[str, str]]], list[tuple[str, float]]]


class Answers:
    """Answers of a model, (name, code so far, child, sure), as a folder of files that only grows.

    Of several answers to one question the surest counts, then the child of the higher code."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "answers")
        spark.createDataFrame([], ANSWERS).write.mode("append").parquet(self.path)

    def known(self) -> DataFrame:
        best = F.max(F.struct("sure", "child")).alias("best")
        return self.spark.read.schema(ANSWERS).parquet(self.path).groupBy("name", "code").agg(best).select("name", "code", F.col("best.child").alias("child"), F.col("best.sure").alias("sure"))

    def ask(self, questions: DataFrame, model: Model, batch: int = 64) -> None:
        """Ask ``model`` about the questions (name, code) without an answer, each once, ``batch`` at a time."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                asked = list(zip(f["name"], f["code"], strict=True))
                got = [x for i in range(0, len(asked), batch) for x in model(asked[i : i + batch])]
                yield f.assign(child=[c for c, _ in got], sure=[float(s) for _, s in got])

        new = questions.select("name", "code").distinct().join(self.known(), ["name", "code"], "left_anti")
        new.mapInPandas(run, ANSWERS).write.mode("append").parquet(self.path)


def descend(names: DataFrame, tree: DataFrame, model: Model, depth: int = 6, least: float = 0.7, answers: Answers | None = None) -> DataFrame:
    """(name, code, confidence, steps): from the top of ``tree`` (code, parent_code)
    down, a level at a time: the model sees (name, code so far) and names a child
    and its confidence; where it is less sure than ``least``, names no child, or
    there are none, the name stays where it is. Each distinct name is asked once
    a level, and not at all where ``answers`` has the answer; null names are left out."""
    answers = answers or Answers(names.sparkSession)
    children = tree.select(F.col("code").alias("child"), F.col("parent_code").alias("code"), F.lit(True).alias("ok")).distinct()
    rounds = Rounds("descent")
    at = names.select("name").filter("name is not null").distinct()
    at = rounds.step(at.select("name", F.lit("").alias("code"), F.lit(1.0).alias("confidence"), F.lit(0).alias("steps"), F.lit(True).alias("open")))
    parents = children.select("code").distinct()
    for _ in range(depth):
        # a code without children leaves nothing to ask
        asked = at.filter("open").join(parents, "code", "left_semi")
        if not asked.limit(1).count():
            break
        answers.ask(asked, model)
        told = at.join(answers.known(), ["name", "code"], "left").join(children, ["child", "code"], "left")
        go = F.col("open") & F.coalesce("ok", F.lit(False)) & (F.coalesce("sure", F.lit(0.0)) >= least)
        at = rounds.step(told.select("name", F.when(go, F.col("child")).otherwise(F.col("code")).alias("code"), F.when(go, F.least("confidence", "sure")).otherwise(F.col("confidence")).alias("confidence"), (F.col("steps") + F.when(go, 1).otherwise(0)).alias("steps"), go.alias("open")))
    return at.drop("open")


def classify_fully(items: DataFrame, tree: DataFrame, model: Model, product: Callable[[Column, Column], Column], name: str = "normalized_name", entries: list[tuple[str, str, float]] | None = None, phrases: list[tuple[str, str]] | None = None, depth: int = 6, least: float = 0.7, sure: float = 0.9, roots: DataFrame | None = None, answers: Answers | None = None) -> DataFrame:
    """``items`` plus code, title, confidence, by and mended: the whole classifier.

    In this order: ``roots`` (root, code, confidence), what earlier runs are
    surer of than ``sure`` for the name's root word; the keywords; the model,
    down ``tree`` (code, name, parent_code), held against the keywords' answer
    by ``mend``. ``by`` tells which (root, keyword, model); ``product`` takes
    name and root word and tells goods. Columns of ``items`` with the names of
    the new ones are replaced. Distinct names are classified once; a null name
    has no answer.
    """
    told = {"entries": entries, **({} if phrases is None else {"phrases": phrases})}
    once = items.select(F.col(name).alias("name")).filter("name is not null").distinct()
    words = classify_by_keyword(once, "name", **told).select("name", "root", F.col("code").alias("w_code"), F.col("confidence").alias("w_sure"))
    spark = items.sparkSession
    known = spark.createDataFrame([], "root string, code string, confidence double") if roots is None else roots
    best = known.filter(F.col("confidence") > sure).groupBy("root").agg(F.max(F.struct("confidence", "code")).alias("b")).select("root", F.col("b.code").alias("r_code"), F.col("b.confidence").alias("r_sure"))
    rounds = Rounds("classified")
    words = rounds.step(words.join(best, "root", "left"))
    asked = words.filter("r_code is null and w_code is null")
    down = descend(asked.select("name"), tree, model, depth, least, answers).filter("steps > 0").select("name", F.col("code").alias("m_code"), F.col("confidence").alias("m_sure"))
    joined = words.join(down, "name", "left")
    code, confidence = F.coalesce("r_code", "w_code", "m_code"), F.coalesce("r_sure", "w_sure", "m_sure")
    by = F.when(F.col("r_code").isNotNull(), "root").when(F.col("w_code").isNotNull(), "keyword").when(F.col("m_code").isNotNull(), "model")
    titles = tree.select(F.col("code").alias("t_code"), F.col("name").alias("title"))
    joined = joined.select("name", "root", "w_code", "w_sure", code.alias("code"), confidence.alias("confidence"), by.alias("by"))
    titled = joined.join(titles, joined["code"] == titles["t_code"], "left").drop("t_code")
    word_titles = tree.select(F.col("code").alias("t_code"), F.col("name").alias("w_title"))
    titled = titled.join(word_titles, titled["w_code"] == word_titles["t_code"], "left")
    fixed = mend(F.col("name"), F.col("code"), F.col("title"), F.col("confidence"), F.col("w_code"), F.col("w_title"), F.col("w_sure"), product(F.col("name"), F.col("root")))
    out = titled.withColumn("f", F.when(F.col("code").isNotNull(), fixed)).select(F.col("name").alias("_name"), "f.code", "f.title", "f.confidence", "by", "f.mended")
    own = [c for c in items.columns if c not in ("code", "title", "confidence", "by", "mended")]
    kept = items.select(*own) if name in own else items.select(*own, name)
    return kept.join(out, F.col(name) == F.col("_name"), "left").drop("_name")


def sure_roots(results: DataFrame, name: str = "normalized_name", words: list[str] | None = None, sure: float = 0.9) -> DataFrame:
    """(root, code, confidence) of results (name, code, confidence) surer than
    ``sure``: what ``classify_fully`` takes as ``roots`` in later runs. Of several codes of a root the surest counts."""
    rooted = results.filter(F.col("confidence") > sure).withColumn("root", root_word(clean_name(F.col(name)), words or [], []))
    return rooted.filter("root <> ''").groupBy("root").agg(F.max(F.struct("confidence", "code")).alias("b")).select("root", F.col("b.code").alias("code"), F.col("b.confidence").alias("confidence"))
