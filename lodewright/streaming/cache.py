"""Answers of a model, kept between batches of a stream for a time, as many as a bound allows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ANSWER = "name string, value string, hit boolean"


class AnswerCache(StatefulProcessor):
    """State of a bucket of names: name, answer and when it was given.

    An answer older than ``ttl`` seconds counts as none: Spark drops it from the
    state. Beyond ``most`` answers a bucket the oldest goes. ``model`` takes the
    names of a batch that the cache lacks, each once.
    """

    def __init__(self, model: Callable[[list[str]], list[str]], ttl: float, most: int):
        self.model, self.ttl, self.most = model, ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("answers", "name string", "value string, at double", ttlDurationMs=int(self.ttl * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        names = [n for f in frames for n in f["name"].tolist()]
        new = [n for n in dict.fromkeys(names) if not self.held.containsKey((n,))]
        had = {n: self.held.getValue((n,))[0] for n in dict.fromkeys(names) if n not in set(new)}
        answers = dict(zip(new, self.model(new), strict=True)) if new else {}
        self._keep(answers)
        yield pd.DataFrame({"name": names, "value": [had.get(n, answers.get(n)) for n in names], "hit": [n in had for n in names]})

    def _keep(self, answers: dict[str, str]) -> None:
        now = time.time()
        held = sorted((v[1], k[0]) for k, v in self.held.iterator())
        for _, name in held[: max(0, len(held) + len(answers) - self.most)]:
            self.held.removeKey((name,))
        for i, (name, value) in enumerate(list(answers.items())[-self.most :]):
            self.held.updateValue((name,), (value, now + i * 1e-6))

    def close(self) -> None:
        pass


def answered(requests: DataFrame, model: Callable[[list[str]], list[str]], ttl: float = 3600.0, most: int = 10_000, buckets: int = 64) -> DataFrame:
    """(name, value, hit) of a stream of requests (name): what the model says of
    each, asked only for names without a live answer in the state.

    ``most`` bounds the answers kept in all; they are dealt over ``buckets`` by a
    hash. Null names are left out. The stream needs the state store of RocksDB;
    one that ends by itself (``availableNow``) also needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` to be false, as times to
    live ask for empty batches without end."""
    keyed = requests.select("name").filter("name is not null").withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int"))
    cache = AnswerCache(model, ttl, max(1, most // buckets))
    return keyed.groupBy("bucket").transformWithStateInPandas(statefulProcessor=cache, outputStructType=ANSWER, outputMode="Append", timeMode="ProcessingTime")


def hit_rate(answers: DataFrame) -> DataFrame:
    """(hits, misses, hit_rate, names): one row."""
    hits = F.count(F.when(F.col("hit"), 1))
    n = F.count("*")
    return answers.agg(hits.alias("hits"), (n - hits).alias("misses"), F.when(n > 0, hits / n).otherwise(0.0).alias("hit_rate"), F.countDistinct("name").alias("names"))
