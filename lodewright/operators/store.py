"""Stored snapshots of a table: each row kept once under a hash of its content, a snapshot being the hashes of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMBER = "hash string, n long, snapshot string"
HEAD = "seq long, snapshot string, kind string, rows long, digest string"


class SnapshotStore:
    """Snapshots of tables of one schema in a folder: rows, members and heads.

    A row's hash is the sha256 of its columns in order of names, nulls told from
    empty texts. Rows that a snapshot shares with an earlier one aren't written
    again. Repeated rows keep their number.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema
        self._row = T.StructType([T.StructField("hash", T.StringType()), *schema.fields])
        for name, kind in (("rows", self._row), ("members", MEMBER), ("heads", HEAD)):
            empty = spark.createDataFrame([], kind)
            (empty.write.partitionBy("snapshot") if name == "members" else empty.write).mode("append").parquet(f"{path}/{name}")

    def _read(self, name: str, schema: T.StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _hash(self) -> Column:
        return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(self.schema.names)]), {"ignoreNullFields": "false"}), 256)

    def heads(self) -> DataFrame:
        """(seq, snapshot, kind, rows, digest): a row per snapshot, numbered in the order in which they were made."""
        return self._read("heads", HEAD)

    def create(self, df: DataFrame, snapshot: str, kind: str = "manual") -> bool:
        """Keep ``df`` as ``snapshot``; False, and nothing kept, where it is
        automatic (``kind`` "auto") and has just the rows of the last snapshot."""
        if self.heads().filter(F.col("snapshot") == snapshot).limit(1).count():
            raise ValueError(f"there is a snapshot {snapshot} already")
        hashed = df.select(*self.schema.names).withColumn("hash", self._hash())
        members = hashed.groupBy("hash").agg(F.count("*").alias("n"))
        # sums of 60-bit parts of the hashes tell sets of rows apart
        part = lambda at: F.sum(F.conv(F.substring("hash", at, 15), 16, 10).cast("decimal(38,0)") * F.col("n"))
        told = members.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.concat_ws("-", part(1), part(16)).alias("digest")).first()
        last = self.heads().agg(F.max("seq").alias("seq"), F.max_by("digest", "seq").alias("digest")).first()
        if kind == "auto" and last.seq is not None and last.digest == told.digest:
            return False
        new = hashed.dropDuplicates(["hash"]).join(self._read("rows", self._row).select("hash"), "hash", "left_anti")
        new.select(*self._row.names).write.mode("append").parquet(f"{self.path}/rows")
        members.withColumn("snapshot", F.lit(snapshot)).write.partitionBy("snapshot").mode("append").parquet(f"{self.path}/members")
        # the head comes last: a snapshot without one was not finished
        head = [((last.seq or 0) + 1, snapshot, kind, told.rows, told.digest)]
        self.spark.createDataFrame(head, HEAD).coalesce(1).write.mode("append").parquet(f"{self.path}/heads")
        return True

    def members(self, snapshot: str) -> DataFrame:
        """(hash, n) of a snapshot; only its own files are read."""
        return self._read("members", MEMBER).filter(F.col("snapshot") == snapshot).select("hash", "n")

    def read(self, snapshot: str) -> DataFrame:
        """The table as it was."""
        rows = self._read("rows", self._row).dropDuplicates(["hash"]).join(self.members(snapshot), "hash")
        return rows.select(*self.schema.names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_i")).drop("_i")

    def difference(self, before: str, after: str, key: str) -> DataFrame:
        """(key, change): rows of ``after`` against ``before`` by their unique key: added, removed or updated. Equal rows aren't read."""
        a, b = self.members(before), self.members(after)
        gone, come = a.join(b, "hash", "left_anti"), b.join(a, "hash", "left_anti")
        rows = self._read("rows", self._row).select("hash", key).dropDuplicates(["hash"])
        told = rows.join(gone.select("hash"), "hash").select(key, F.lit(1).alias("was")).unionByName(rows.join(come.select("hash"), "hash").select(key, F.lit(2).alias("was")))
        change = F.when(F.sum("was") == 1, "removed").when(F.sum("was") == 2, "added").otherwise("updated")
        return told.distinct().groupBy(key).agg(change.alias("change"))
