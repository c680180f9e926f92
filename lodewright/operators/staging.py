"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it takes a temporary folder, a cluster without it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/lodewright-shared"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once and read again; the table goes when the driver ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan of files, over at least half as many partitions as there are
    cores: a small table of one file is dealt over all of them before work that is
    long for each row, a large one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def spread_runs(df: DataFrame) -> DataFrame:
    """As ``spread``, but rows keep the order of their files: a partition holds whole
    runs of up to 131,072 neighbouring rows, and partitions follow each other as the
    files do. Sums of doubles, which depend on the order, come out alike in each run."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 2 * df.rdd.getNumPartitions() >= cores:
        return df
    rows = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_run", F.shiftright("_at", 17))
    return rows.repartitionByRange(cores, "_run").sortWithinPartitions("_at").drop("_run", "_at")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` plus ``out``, the place of each row (from 1) in the order of its
    columns ``order``. Rows are dealt by ranges, ties by a number of their own;
    a place is the rows of the ranges before plus the place in its range."""
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    dealt = rows.repartitionByRange(*order, "_row").sortWithinPartitions(*order, "_row").drop("_row")
    # the number holds the range in its upper bits and the place there in the lower 33
    told = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_range", F.shiftright("_at", 33))
    before = F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = told.groupBy("_range").count().select("_range", F.coalesce(before, F.lit(0)).alias("_start"))  # a row per range
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return told.join(F.broadcast(starts), "_range").withColumn(out, place).drop("_range", "_start", "_at")


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as Hadoop's objects."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(df_path: tuple[SparkSession, str]) -> None:
    spark, path = df_path
    with contextlib.suppress(Exception):  # the session has ended already; the folder's owner cleans up
        where, files = hadoop_path(spark, path)
        files.delete(where, True)


def _clean() -> None:
    for told in _written:
        remove(told)


class Rounds:
    """Tables of an iteration of which only the newest is read: each step removes the one before the last."""

    def __init__(self, name: str):
        self.name, self.paths = name, []

    def step(self, df: DataFrame) -> DataFrame:
        out = written(df, self.name)
        self.paths.append(_written[-1])
        if len(self.paths) > 2:
            remove(self.paths.pop(0))
        return out
