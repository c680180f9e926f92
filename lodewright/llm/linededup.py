"""Removal of lines that occur in many documents, through a minimal perfect hash.

Lines are counted by a 128-bit hash of their key. All distinct hashes are cut
into shards; each shard gets a minimal perfect hash, which numbers its lines
from 0 without holding them, and two compact arrays over those numbers: a
32-bit fingerprint and the count of documents. Documents probe the arrays, and
the count found there decides; a fingerprint that differs tells of a line that
isn't indexed. Lines themselves are never joined.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table

#: A line is dropped everywhere if at least so many documents have it.
MIN_DOCS = 10
#: Broadcast arrays up to this many bytes in all; beyond it line hashes travel to the shards.
BROADCAST_BYTES = 48 << 20
#: Line hashes in a shard, about.
SHARD_KEYS = 1_000_000
#: Documents of one bucket when hashes travel, and probes of a shard in one task, about.
BUCKET_DOCS, PROBES = 2_000, 1_000_000
#: Line counts that a task holds before it passes them on.
HELD = 200_000

SPACE = b" \t\n\x0b\x0c\r"
_GOLD = 0x9E3779B97F4A7C15


def _place(keys: np.ndarray, prints: np.ndarray, level: int, size: int) -> np.ndarray:
    """Cell of each 128-bit hash in a level of ``size`` cells."""
    with np.errstate(over="ignore"):
        h = (keys ^ np.uint64((level + 1) * _GOLD & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD) + prints
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash by levels: a key that is alone in its cell of a
    level is numbered by the rank of that cell; the others go one level down.
    A level is a bit per cell, in words of 64, and the rank of each word.
    """

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels = levels  # (cells, words)
        self.ranks, before = [], 0
        for _, words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append((np.cumsum(ones) - ones + before).astype(np.uint32))
            before += int(ones.sum())
        self.n = before

    @classmethod
    def of(cls, keys: np.ndarray, prints: np.ndarray) -> PerfectHash:
        """Over distinct pairs of uint64."""
        levels: list[tuple[int, np.ndarray]] = []
        while len(keys):
            size = max(64, 2 * len(keys))
            at = _place(keys, prints, len(levels), size)
            alone = np.bincount(at, minlength=-(-size // 64) * 64) == 1
            levels.append((size, np.packbits(alone, bitorder="little").view("<u8")))
            left = ~alone[at]
            keys, prints = keys[left], prints[left]
            if len(levels) > 64:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def index(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """A number below ``n`` for each key, its own for those of the set; -1 for some of the others."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (size, words) in enumerate(self.levels):
            at = _place(keys[left], prints[left], k, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            got = (word >> bit & np.uint64(1)) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[got]] = (self.ranks[k][at >> 6] + below)[got]
            left = left[~got]
        return out

    def dump(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<QQ", size, len(w)) + w.tobytes() for size, w in self.levels)

    @classmethod
    def load(cls, blob: bytes) -> tuple[PerfectHash, int]:
        """The hash, and where its bytes end."""
        (k,), at, levels = struct.unpack_from("<I", blob), 4, []
        for _ in range(k):
            size, words = struct.unpack_from("<QQ", blob, at)
            levels.append((size, np.frombuffer(blob, "<u8", words, at + 16)))
            at += 16 + 8 * words
        return cls(levels), at


class Shard:
    """A perfect hash with its fingerprint and count arrays; counts end at what their type holds."""

    def __init__(self, mph: PerfectHash, prints: np.ndarray, counts: np.ndarray):
        self.mph, self.prints, self.counts = mph, prints, counts

    @classmethod
    def of(cls, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, least: int = MIN_DOCS) -> Shard:
        """Counts are told apart up to ``least``."""
        mph = PerfectHash.of(keys, prints)
        at = mph.index(keys, prints)
        kind = np.dtype("u1" if least < 256 else "<u2" if least < 65536 else "<u4")
        p, c = np.zeros(mph.n, "<u4"), np.zeros(mph.n, kind)
        p[at], c[at] = prints & np.uint64(0xFFFFFFFF), np.minimum(counts, np.iinfo(kind).max)
        return cls(mph, p, c)

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Documents with each line; 0 if the line is not indexed."""
        at = self.mph.index(keys, prints)
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == (prints[ok] & np.uint64(0xFFFFFFFF))
        out = np.zeros(len(keys), np.int64)
        out[ok] = self.counts[at[ok]]
        return out

    def dump(self) -> bytes:
        return self.mph.dump() + struct.pack("<I", self.counts.itemsize) + self.prints.tobytes() + self.counts.tobytes()

    @classmethod
    def load(cls, blob: bytes) -> Shard:
        mph, at = PerfectHash.load(blob)
        (width,) = struct.unpack_from("<I", blob, at)
        return cls(mph, np.frombuffer(blob, "<u4", mph.n, at + 4), np.frombuffer(blob, f"<u{width}", mph.n, at + 4 + 4 * mph.n))


def line_keys(text: bytes | None) -> list[bytes]:
    """Keys of the lines: stripped of ASCII white space, A-Z in lower case."""
    return [x.strip(SPACE) for x in (text or b"").lower().split(b"\n")]


def _hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist() if pa.types.is_large_string(column.type) else column.cast(pa.binary()).to_pylist()


def _longs(values: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def line_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, print, docs): each distinct line hash and the documents that have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            both = np.frombuffer(b"".join(k.to_bytes(16, "little") for k in held), "<u8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays([_longs(both[:, 1].copy()), _longs(both[:, 0].copy()), pa.array(np.fromiter(held.values(), np.int64, len(held)))], ["key", "print", "docs"])

        for b in batches:
            for t in _texts(b.column(0)):
                held.update(map(xxhash.xxh3_128_intdigest, filter(None, set(line_keys(t)))))
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    hashed = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "key long, print long, docs long")
    return hashed.groupBy("key", "print").agg(F.sum("docs").alias("docs"))


def line_index(counts: DataFrame, shards: int, least: int = MIN_DOCS) -> DataFrame:
    """(shard, n, blob): the arrays of each shard."""

    def build(group: pa.Table) -> pa.Table:
        u = [group.column(c).to_numpy().view(np.uint64) for c in ("key", "print")]
        blob = Shard.of(*u, group.column("docs").to_numpy(), least).dump()
        return pa.table({"shard": group.column("shard")[:1], "n": pa.array([len(group)], pa.int64()), "blob": pa.array([blob], pa.binary())})

    cut = counts.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    return cut.groupBy("shard").applyInArrow(build, "shard int, n long, blob binary")


def _rewrite(texts: list[bytes | None], frequent) -> tuple[list[bytes], list[int], list[int]]:
    """Kept text, lines and dropped lines of each; ``frequent`` tells of arrays of hashes which to drop."""
    keys = [line_keys(t) for t in texts]
    sizes = [len(k) for k in keys]
    flat = b"".join(xxhash.xxh3_128_digest(x) for k in keys for x in k)
    both = np.frombuffer(flat, ">u8").astype(np.uint64).reshape(-1, 2)
    full = np.fromiter((bool(x) for k in keys for x in k), bool, len(both))
    drop = frequent(both[:, 0], both[:, 1]) & full
    kept, gone, at = [], [], 0
    for t, n in zip(texts, sizes, strict=True):
        d = drop[at : at + n]
        at += n
        k = int(d.sum())
        gone.append(k)
        kept.append((t or b"") if not k else b"\n".join(x for x, out in zip((t or b"").split(b"\n"), d, strict=True) if not out))
    return kept, sizes, gone


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, text: str = "text", limit: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS, probes_a_task: int = PROBES) -> DataFrame:
    """``docs`` with ``text`` rewritten, plus ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line stripped of ASCII white space, A-Z lowered; empty
    keys never count. A line in ``min_docs`` documents or more goes everywhere.
    A null or empty text is one empty line and comes out empty. Repeated rows
    count as documents of their own; ids, null ones too, play no part. Of input columns named like a new column
    the new one wins. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")])
    counts = staged(line_counts(docs, text), "line-counts")
    shards = max(1, counts.count() // shard_keys)
    index = staged(line_index(counts, shards, min_docs), "line-index")
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema.fields] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at = docs.columns.index(text)

    def out(b: pa.RecordBatch | pa.Table, frequent) -> pa.RecordBatch:
        kept, lines, gone = _rewrite(_texts(b.column(at)), frequent)
        columns = [b.column(k) if k != at else pa.array(kept, pa.binary()).cast(pa.string()) for k in range(len(schema) - 2)]
        return [*columns, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())]

    if (index.agg(F.sum(F.length("blob"))).first()[0] or 0) <= limit:
        blobs = spark.sparkContext.broadcast({r.shard: bytes(r.blob) for r in index.select("shard", "blob").collect()})

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded = {s: Shard.load(x) for s, x in blobs.value.items()}

            def frequent(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
                hit, where = np.zeros(len(keys), bool), keys.view(np.int64) % shards
                for s, shard in loaded.items():
                    mine = np.flatnonzero(where == s) if shards > 1 else slice(None)
                    hit[mine] = shard.count(keys[mine], prints[mine]) >= min_docs
                return hit

            for b in batches:
                for k in range(0, len(b), 2000):
                    yield pa.RecordBatch.from_arrays(out(b.slice(k, 2000), frequent), schema.names)

        return docs.mapInArrow(local, schema)

    # rows get a number of their own, so that buckets are even whatever ids and texts repeat
    rows = staged(docs.withColumn("__lw_row", F.monotonically_increasing_id()), "line-rows")
    buckets = max(1, rows.count() // BUCKET_DOCS)
    dealt = rows.withColumn("__lw_bucket", F.pmod(F.xxhash64("__lw_row"), F.lit(buckets))).drop("__lw_row")

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {(k, *_hash(x)) for k, t in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True) for x in set(line_keys(t)) if x}
            cols = list(zip(*seen, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), _longs(cols[1]), _longs(cols[2])], ["bucket", "key", "print"])

    def answer(rows: pa.Table, shard: pa.Table) -> pa.Table:
        rows = rows.select(["bucket", "key", "print"])
        if not len(rows) or not len(shard):
            return rows.slice(0, 0)
        u = [rows.column(c).to_numpy().view(np.uint64) for c in ("key", "print")]
        return rows.filter(pa.array(Shard.load(shard.column("blob")[0].as_py()).count(*u) >= min_docs))

    def apply(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table([pa.array([], f.type) for f in empty], schema.names)
        hits = {*zip(found.column("key").to_pylist(), found.column("print").to_pylist(), strict=True)}

        def frequent(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
            return np.fromiter((x in hits for x in zip(keys.view(np.int64).tolist(), prints.view(np.int64).tolist(), strict=True)), bool, len(keys))

        return pa.table(out(rows.drop_columns(["__lw_bucket"]).combine_chunks(), frequent), schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema)
    asked = dealt.select("__lw_bucket", F.col(f"`{text}`")).mapInArrow(probes, "bucket long, key long, print long").distinct()
    asked = staged(asked.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")), "line-probes")
    # a shard that is asked often is copied to several tasks
    splits = asked.groupBy("shard").agg(F.ceil(F.count("*") / probes_a_task).cast("int").alias("of"))
    sent = asked.join(F.broadcast(splits), "shard").withColumn("split", F.pmod("bucket", "of").cast("int"))
    there = index.select("shard", "blob").join(F.broadcast(splits), "shard").withColumn("split", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    found = sent.groupBy("shard", "split").cogroup(there.select("shard", "split", "blob").groupBy("shard", "split")).applyInArrow(answer, "bucket long, key long, print long")
    found = found.withColumnRenamed("bucket", "__lw_bucket")
    return dealt.groupBy("__lw_bucket").cogroup(found.groupBy("__lw_bucket")).applyInArrow(apply, schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all ``documents``."""
    kept = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""
