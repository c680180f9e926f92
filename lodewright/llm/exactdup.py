"""Exact deduplication behind static binary-fuse filters.

An immutable snapshot holds one exact bucket (digest, size, smallest id, rows)
per distinct text and one binary-fuse filter per shard of digests; it is
written once and serves any number of batches. Digests of an incoming batch are
grouped among themselves first, then screened by the filters; only positives
join the exact buckets. The texts of groups of two rows or more are then
compared byte by byte: each task passes on one copy of each of its texts, and a
digest that turns out to stand for several texts is taken apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P, new_path, staged, table

#: Broadcast filters up to this many bytes in all; beyond it digests travel to the filters.
BROADCAST_BYTES = 48 << 20
#: Digests in a shard of the snapshot, about.
SHARD_KEYS = 500_000
#: Keys (8 bytes) of groups and batch rows are broadcast up to so many; beyond it they are joined by a shuffle.
BROADCAST_KEYS = 2_000_000

_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _layout(n: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and number of segments."""
    seg = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    size = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 8
    return seg, max(3, -(-size // seg) + 2)


def _slots(keys: np.ndarray, seed: int, seg: int, segs: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots of each key, in consecutive segments, and its 8-bit fingerprint."""
    with np.errstate(over="ignore"):
        h = _mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        g = _mix(h ^ np.uint64(0xD6E8FEB86659FD93))
    start = ((h >> np.uint64(32)) * np.uint64(segs - 2) >> np.uint64(32)).astype(np.int64)
    low = np.uint64(seg - 1)
    at = [(start + i) * seg + ((g >> np.uint64(20 * i)) & low).astype(np.int64) for i in range(3)]
    return np.stack(at, 1), (h & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> bytes:
    """A binary-fuse filter over distinct uint64 keys: header, then 8-bit cells.

    Peeling runs in rounds: every cell that holds one key gives that key up.
    Cells are filled in the reverse order of the rounds.
    """
    keys = np.unique(keys.astype(np.uint64))
    seg, segs = _layout(len(keys))
    for seed in range(1, 200):
        at, fp = _slots(keys, seed, seg, segs)
        cells, n = np.zeros(seg * segs, np.uint8), len(keys)
        flat, who = at.ravel(), np.repeat(np.arange(n), 3)
        count = np.bincount(flat, minlength=seg * segs)
        held = np.zeros(seg * segs, np.int64)
        np.add.at(held, flat, who)
        rounds, left = [], n
        front = np.flatnonzero(count == 1)
        while len(front):
            got, first = np.unique(held[front], return_index=True)
            own = front[first]
            rounds.append((got, own))
            left -= len(got)
            hit = at[got].ravel()
            np.subtract.at(count, hit, 1)
            np.subtract.at(held, hit, np.repeat(got, 3))
            hit = np.unique(hit)
            front = hit[count[hit] == 1]
        if left == 0:
            for got, own in reversed(rounds):
                cells[own] = 0
                cells[own] = fp[got] ^ cells[at[got, 0]] ^ cells[at[got, 1]] ^ cells[at[got, 2]]
            return np.array([seed, seg, segs], "<u8").tobytes() + cells.tobytes()
        segs += 1 + segs // 16
    raise RuntimeError("no seed peels these keys")


def probe_filter(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; never false for one that is."""
    seed, seg, segs = map(int, np.frombuffer(blob, "<u8", 3))
    cells = np.frombuffer(blob, np.uint8, offset=24)
    at, fp = _slots(keys.astype(np.uint64), seed, seg, segs)
    return (cells[at[:, 0]] ^ cells[at[:, 1]] ^ cells[at[:, 2]]) == fp


def _keys(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def snapshot_filters(buckets: DataFrame, shards: int) -> DataFrame:
    """One row (shard, n, blob) per shard of ``buckets``, which has the long column ``key``."""

    def build(group: pa.Table) -> pa.Table:
        keys = _keys(group, "key")
        return pa.table({"shard": group.column("shard")[:1], "n": pa.array([len(keys)], pa.int64()), "blob": pa.array([build_filter(keys)], pa.binary())})

    cut = buckets.select("key", F.pmod(F.col("key"), F.lit(shards)).cast("int").alias("shard"))
    return cut.groupBy("shard").applyInArrow(build, "shard int, n long, blob binary")


def screen(incoming: DataFrame, filters: DataFrame, shards: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``incoming`` (long column ``key``) with the boolean ``maybe``: false only
    for keys that the snapshot surely lacks.

    Filters whose bytes stay within ``limit`` are broadcast; else each row
    travels to its shard's filter.
    """
    spark = incoming.sparkSession
    names, schema = incoming.columns, incoming.withColumn("maybe", F.lit(True)).schema
    if (filters.agg(F.sum(F.length("blob"))).first()[0] or 0) <= limit:
        blobs = spark.sparkContext.broadcast({r.shard: bytes(r.blob) for r in filters.select("shard", "blob").collect()})

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = _keys(b, "key")
                where = (keys.view(np.int64) % shards).astype(np.int64)
                keep = np.zeros(len(keys), bool)
                for s in np.unique(where):
                    if int(s) in blobs.value:
                        mine = np.flatnonzero(where == s)
                        keep[mine] = probe_filter(blobs.value[int(s)], keys[mine])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keep)], [*b.schema.names, "maybe"])

        return incoming.mapInArrow(local, schema)

    def routed(rows: pa.Table, blob: pa.Table) -> pa.Table:
        maybe = probe_filter(blob.column("blob")[0].as_py(), _keys(rows, "key")) if len(blob) and len(rows) else np.zeros(len(rows), bool)
        return rows.select(names).append_column("maybe", pa.array(maybe, pa.bool_()))

    sent = incoming.withColumn(f"{P}shard", F.pmod(F.col("key"), F.lit(shards)).cast("int"))
    there = filters.select(F.col("shard").alias(f"{P}shard"), "blob")
    return sent.groupBy(f"{P}shard").cogroup(there.groupBy(f"{P}shard")).applyInArrow(routed, schema)


def normalised(text: str | Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


@dataclass
class Snapshot:
    """Exact buckets (digest, size, key, keep_id, group_size) and the filters over their keys."""

    buckets: DataFrame
    filters: DataFrame
    shards: int


def write_snapshot(grouped: DataFrame, path: str, shard_keys: int = SHARD_KEYS) -> None:
    """Writes ``grouped`` (digest, size, keep_id, group_size) and its filters under ``path``, once for all batches."""
    spark = grouped.sparkSession
    grouped.withColumn("key", F.xxhash64("digest")).write.parquet(f"{path}/buckets")
    buckets = spark.read.parquet(f"{path}/buckets")
    shards = max(1, buckets.count() // shard_keys)
    snapshot_filters(buckets, shards).withColumn("shards", F.lit(shards)).write.parquet(f"{path}/filters")


def read_snapshot(spark: SparkSession, path: str) -> Snapshot:
    filters = spark.read.parquet(f"{path}/filters")
    first = filters.select("shards").first()
    return Snapshot(spark.read.parquet(f"{path}/buckets"), filters.drop("shards"), first[0] if first else 1)


def _small(df: DataFrame, most: int | None = None) -> DataFrame:
    """Broadcast if it has no more rows than ``BROADCAST_KEYS``."""
    most = BROADCAST_KEYS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dedup_batch(batch: DataFrame, snapshot: Snapshot, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """``batch`` has a row (digest, size, keep_id, group_size) per distinct text.
    The buckets that it touches, with their new smallest id and rows, and the
    rows of texts that the snapshot lacks."""
    exact, columns = ["digest", "size"], ["digest", "size", "keep_id", "group_size"]
    screened = staged(screen(batch.withColumn("key", F.xxhash64("digest")), snapshot.filters, snapshot.shards, limit), "exact-screened").drop("key")
    maybe = screened.filter("maybe").select(*exact, F.col("keep_id").alias("new_id"), F.col("group_size").alias("new_size"))
    hit = staged(snapshot.buckets.join(_small(maybe), exact), "exact-hits")
    seen = hit.select(*exact, F.least("keep_id", "new_id").alias("keep_id"), (F.col("group_size") + F.col("new_size")).alias("group_size"))
    fresh = screened.join(_small(hit.select(*exact)), exact, "left_anti").select(columns)
    return seen, fresh


def clashes(texts: DataFrame, multi: DataFrame) -> DataFrame:
    """(digest, size) of ``multi`` whose rows of ``texts`` (digest, size, norm)
    differ in a byte. A task passes on each of its texts once."""
    keys = _small(multi.select(F.xxhash64("digest").alias("key")).distinct())
    by = ["digest", "size", "norm"]
    mine = texts.withColumn("key", F.xxhash64("digest")).join(keys, "key", "left_semi")
    return mine.groupBy(*by).agg(F.count("*").alias("n")).groupBy("digest", "size").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest", "size")


def sha256(norm: Column) -> Column:
    return F.sha2(F.encode(norm, "UTF-8"), 256)


def exact_dedup(docs: DataFrame, old: Column, ident: str = "doc_id", text: str = "text", limit: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``old`` tells the rows that the snapshot holds. A null text counts as
    empty. Of repeated rows with the smallest id of their group one is kept;
    null ids come last, and a group of null ids alone keeps one row with a null
    ``keep_id``. An empty table gives no rows. Texts of one ``digest`` that
    differ are groups of their own.
    """
    spark, exact = docs.sparkSession, ["digest", "size"]
    norm = docs.select(F.col(f"`{ident}`").cast("long").alias("id"), normalised(F.col(f"`{text}`")).alias("norm"), F.coalesce(old, F.lit(False)).alias("old"))
    told = norm.select("id", "old", "norm", digest(F.col("norm")).alias("digest"), F.octet_length("norm").cast("long").alias("size"))
    rows = staged(told.groupBy("id", "old", *exact).agg(F.count("*").alias("n")), "exact-rows")
    grouped = staged(rows.groupBy("old", *exact).agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size")), "exact-groups")
    path = new_path(spark, "snapshot")
    write_snapshot(grouped.filter("old").drop("old"), path, shard_keys)
    snapshot = read_snapshot(spark, path)
    seen, fresh = dedup_batch(grouped.filter("not old").drop("old"), snapshot, limit)
    multi = seen.unionByName(fresh).unionByName(snapshot.buckets.select(seen.columns).join(_small(seen.select(*exact)), exact, "left_anti")).filter("group_size > 1")
    multi = staged(multi, "exact-multi")
    apart = staged(clashes(told.select("digest", "size", "norm"), multi), "exact-clashes")
    by_id = rows.groupBy("id", *exact).agg(F.sum("n").alias("n"))
    out = by_id.join(multi, exact, "left").select("id", "digest", "n", "keep_id", "group_size")
    if apart.limit(1).count():
        mine = told.join(_small(apart), exact, "left_semi").groupBy("id", *exact, "norm").agg(F.count("*").alias("n"))
        texts = mine.groupBy(*exact, "norm").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))
        split = mine.join(texts, [*exact, "norm"]).select("id", "digest", "n", "keep_id", "group_size")
        out = by_id.join(apart, exact, "left_anti").join(multi, exact, "left").select("id", "digest", "n", "keep_id", "group_size").unionByName(split)
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(
        F.col("id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(keep) & (F.col("copy") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: rows with an even id stand for the snapshot, the rest for the incoming batch."""
    return exact_dedup(table(spark, sf_dir, "documents"), F.pmod(F.col("doc_id"), F.lit(2)) == 0)


OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""
