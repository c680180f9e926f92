"""Names mended by rules, and by a model where the rules are not enough."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.functions import patterns as P

from .staging import written

Model = Callable[[list[tuple[str, str, list[str]]]], list[tuple[str | None, float]]]
#: Confidence where the model has no answer.
FALLBACK = 0.7


def needs_model(name: Column, matches: Column, fixed: Column) -> Column:
    """Whether a pattern has no fix or is unsure, more than three are found, or the rules change nothing but case."""
    open_ = F.exists(matches, lambda m: ~m["auto_fixable"] | (m["confidence"] < 0.7))
    return open_ | (F.size(matches) > 3) | (F.lower(F.trim(fixed)) == F.lower(F.trim(name)))


def rule_confidence(matches: Column) -> Column:
    """Confidence of those that are mended over all matches, times 0.95 if all are, else 0.8; 1 without matches."""
    total = F.aggregate(matches, F.lit(0.0), lambda a, m: a + F.when(m["auto_fixable"], m["confidence"]).otherwise(0.0))
    return F.when(F.size(matches) == 0, 1.0).otherwise(total / F.size(matches) * F.when(F.forall(matches, lambda m: m["auto_fixable"]), 0.95).otherwise(0.8))


def needs_review(matches: Column, confidence: Column) -> Column:
    """Whether a person should look: an unsure result, a severe pattern or one without a fix, or more than five."""
    severe = F.exists(matches, lambda m: m["severity"].isin("critical", "high") | ~m["auto_fixable"])
    return (confidence < 0.7) | severe | (F.size(matches) > 5)


def suggest_corrections(items: DataFrame, name: str, model: Model | None = None, patterns: list[P.Pattern] = P.PATTERNS, batch: int = 64) -> DataFrame:
    """``items`` plus fixed (by the rules), suggested, confidence, asked and review.

    Each distinct name that needs it goes to ``model`` once, with what the rules
    make of it and the texts they found; it gives a name, or null, and a
    confidence. A suggestion of 0.8 or more counts, and one of 0.6 or more that differs in
    more than case, else the rules' name does;
    without an answer the confidence is ``FALLBACK``. A null name has no
    suggestion; columns of ``items`` with the new names are replaced.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            asked = [(n, x, list(t)) for n, x, t in zip(f["_name"], f["fixed"], f["texts"], strict=True)]
            got = [x for i in range(0, len(asked), batch) for x in model(asked[i : i + batch])]
            yield pd.DataFrame({"_name": f["_name"], "said": [n for n, _ in got], "sure": [float(s) for _, s in got]})

    once = items.select(F.col(name).alias("_name")).filter("_name is not null").distinct()
    told = once.withColumn("m", P.detect(F.col("_name"), patterns)).withColumn("fixed", P.apply_fixes(F.col("_name"), patterns))
    told = written(told.withColumn("asked", needs_model(F.col("_name"), F.col("m"), F.col("fixed")) & F.lit(model is not None)), "corrections")
    if model is None:
        told = told.withColumns({"said": F.lit(None).cast("string"), "sure": F.lit(None).cast("double")})
    else:
        texts = F.transform("m", lambda m: m["matched_text"])
        answers = told.filter("asked").select("_name", "fixed", texts.alias("texts")).mapInPandas(ask, "_name string, said string, sure double")
        told = told.join(answers, "_name", "left")
    answered = F.col("asked") & (F.coalesce("said", F.lit("")) != "")
    sure = F.when(answered, F.col("sure")).when(F.col("asked"), FALLBACK).otherwise(rule_confidence(F.col("m")))
    out = told.withColumn("confidence", sure)
    differs = F.lower(F.trim("said")) != F.lower(F.trim("fixed"))
    suggested = F.when(answered & ((F.col("confidence") >= 0.8) | ((F.col("confidence") >= 0.6) & differs)), F.col("said")).otherwise(F.col("fixed"))
    out = out.select("_name", "fixed", suggested.alias("suggested"), "confidence", "asked", needs_review(F.col("m"), F.col("confidence")).alias("review"))
    return items.drop("fixed", "suggested", "confidence", "asked", "review").join(out, F.col(name) == F.col("_name"), "left").drop("_name")
