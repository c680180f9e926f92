"""What several operators share: the shared folder, staging, gapless positions."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Internal column names start with this, so that columns of the input never clash with them.
P = "__lw_"

#: Rows that go to a Python worker at once. Spark's 10,000 are tens of MB of whole texts, which JVM and worker hold several times over and seldom give back.
ARROW_ROWS = 2_000

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session takes a temporary folder; a cluster
    without it is an error, as executors would write to their own disks.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local-") or not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/lodewright-shared"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _written:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of ``new_path`` through Hadoop's file system."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already; the folder's owner cleans up
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage is cut, a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on ``ARROW_ROWS`` rows go to Python at once, unless the session says how many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(ARROW_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positions(df: DataFrame, cls: str, order: list[Column], out: str, least: int = 64) -> tuple[DataFrame, dict[int, int]]:
    """Add ``out``, the gapless position (from 0) of each row in the order of
    the int column ``cls``, without any global sort; also return the count of
    each class.

    The caller vouches that ``cls`` has a bounded number of values (a few
    thousand), so counts by class go to the driver. Rows are written with a
    number of their own first, so that null or repeated ones are told apart and
    every later reading sees the same. A class larger than about a quarter of a
    task's share is split by a hash of that number; the position is then an
    offset of (class, split) plus the row number in it. Positions in a class
    follow (split, ``order``).
    """
    spark = df.sparkSession
    row, nsub, sub = f"{P}row", f"{P}nsub", f"{P}sub"
    df = staged(df.withColumn(row, F.monotonically_increasing_id()), "positions")
    counts = dict(df.groupBy(cls).count().collect())
    target = max(least, sum(counts.values()) // (4 * partitions(spark)))
    splits = spark.createDataFrame([(c, math.ceil(n / target)) for c, n in counts.items()] or [(0, 1)], f"{cls} int, {nsub} int")
    cut = df.join(F.broadcast(splits), cls).withColumn(sub, F.pmod(F.xxhash64(row), F.col(nsub)).cast("int")).drop(nsub)
    rows = sorted(cut.groupBy(cls, sub).count().collect())
    offsets, at = [], 0
    for c, s, n in rows:
        offsets.append((c, s, at))
        at += n
    starts = spark.createDataFrame(offsets or [(0, 0, 0)], f"{cls} int, {sub} int, {P}start long")
    number = F.row_number().over(Window.partitionBy(cls, sub).orderBy(*order, row))
    placed = cut.join(F.broadcast(starts), [cls, sub]).withColumn(out, F.col(f"{P}start") + number - 1)
    return placed.drop(sub, row, f"{P}start"), counts
