"""Streaming ingestion: files of items, normalised, upserted batch by batch into versioned tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodewright.functions.names import categorize, normalize_name
from lodewright.operators.snapshots import upsert
from lodewright.operators.staging import hadoop_path


def normalised_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json", files: int = 100) -> DataFrame:
    """Items (code, name, …) of files as they arrive, with normalised name and category."""
    rows = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).load(path)
    return rows.withColumn("normalized_name", normalize_name(F.col("name"))).withColumn("category", categorize(F.col("name")))


def upsert_stream(rows: DataFrame, target: str, checkpoint: str, keys: tuple[str, ...] = ("code",), seq: str = "seq", buckets: int = 64, keep: int | None = None) -> StreamingQuery:
    """Each batch adds a version to the buckets of ``target`` that its keys fall
    into (folders version=…/bucket=…); the others stay. A batch that is run
    again writes the same version. A manifest tells each bucket's last version,
    so a batch reads no older file, however many there are. With ``keep`` all but
    so many versions of the table go after each batch. ``current`` reads the table."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # the batch is read twice below; what is lost of the copy is read from the files again
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # at most ``buckets`` rows
        before = manifest(spark, target, number)
        stored = _rows(spark, target, {b: v for b, v in before.items() if b in touched}, new.schema).select(new.columns)
        upsert(stored, new, [*keys, "bucket"], seq).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={number}")
        new.unpersist()
        put_manifest(spark, target, number, before | dict.fromkeys(touched, number))
        if keep is not None:
            compact(spark, target, keep)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str) -> list[int]:
    """The numbers of the manifests, in order."""
    where, files = hadoop_path(spark, f"{target}/_manifests")
    if not files.exists(where):
        return []
    names = [f.getPath().getName() for f in files.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "_")


def put_manifest(spark: SparkSession, target: str, number: int, last: dict[int, int]) -> None:
    """Write the last version of each bucket as of version ``number``; it appears as a whole or not at all."""
    made, files = hadoop_path(spark, f"{target}/_manifests/_{number}-{uuid.uuid4().hex}")
    out = files.create(made)
    out.write(bytearray(json.dumps(last).encode()))
    out.close()
    where, _ = hadoop_path(spark, f"{target}/_manifests/{number}.json")
    files.delete(where, False)
    files.rename(made, where)


def manifest(spark: SparkSession, target: str, before: int = 1 << 30) -> dict[int, int]:
    """The last version of each bucket, of those before ``before``."""
    numbers = [n for n in _versions(spark, target) if n < before]
    if not numbers:
        return {}
    text = spark.read.text(f"{target}/_manifests/{numbers[-1]}.json", wholetext=True).first()[0]
    return {int(b): v for b, v in json.loads(text).items()}


def _rows(spark: SparkSession, target: str, last: dict[int, int], schema: T.StructType) -> DataFrame:
    full = T.StructType([*[f for f in schema.fields if f.name != "bucket"], T.StructField("version", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    paths = [f"{target}/version={v}/bucket={b}" for b, v in sorted(last.items())]
    rows = spark.read.schema(full).option("basePath", target).parquet(*paths) if paths else spark.createDataFrame([], full)
    return rows.drop("version")


def current(spark: SparkSession, target: str, schema: T.StructType, before: int = 1 << 30) -> DataFrame:
    """The rows of each bucket's last version before ``before``; only their files are listed and read."""
    return _rows(spark, target, manifest(spark, target, before), schema)


def compact(spark: SparkSession, target: str, keep: int = 1) -> int:
    """Delete what none of the last ``keep`` manifests needs; the number of folders deleted.

    Versions that readers may still hold should be kept; a batch that is run again needs the one before it."""
    numbers = _versions(spark, target)
    live = {(v, b) for n in numbers[-max(1, keep) :] for b, v in manifest(spark, target, n + 1).items()}
    root, files = hadoop_path(spark, target)
    gone = 0
    for version in [f.getPath() for f in files.listStatus(root) if f.getPath().getName().startswith("version=")]:
        number = int(version.getName().split("=")[1])
        if numbers and number > numbers[-1]:
            continue  # a batch that isn't done
        buckets = [f.getPath() for f in files.listStatus(version) if f.getPath().getName().startswith("bucket=")]
        dead = [b for b in buckets if (number, int(b.getName().split("=")[1])) not in live]
        for path in [version] if len(dead) == len(buckets) else dead:
            files.delete(path, True)
            gone += 1
    for n in numbers[: -max(1, keep)]:
        files.delete(hadoop_path(spark, f"{target}/_manifests/{n}.json")[0], False)
    return gone


def window_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and key; later ones than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))


def cached(requests: DataFrame, cache: DataFrame, key: str, as_of) -> tuple[DataFrame, DataFrame]:
    """Answers that the cache (key, value, expires_at) still has, and requests that it lacks."""
    fresh = cache.filter(F.col("expires_at") > F.lit(as_of))
    return requests.join(fresh.select(key, "value"), key), requests.join(fresh.select(key), key, "left_anti")
