"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``2**bits`` levels at its own quantiles, the
grid cell is numbered along the Hilbert curve, and rows in curve order are cut
into runs. Neighbours on the curve are neighbours in every dimension, so the
min/max statistics of a shard's files prune on each of them.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import P, partitions, positions, table


def curve_index(point: tuple[int, ...], bits: int) -> int:
    """Index of a grid point on the Hilbert curve (Skilling, 2004)."""
    x = list(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            flip ^= q - 1
        q >>= 1
    index = 0
    for bit in reversed(range(bits)):
        for v in x:
            index = index << 1 | ((v ^ flip) >> bit & 1)
    return index


def curve_table(dims: int, bits: int) -> list[int]:
    """Curve index of every cell, cells in row-major order."""
    return [curve_index(p, bits) for p in product(range(1 << bits), repeat=dims)]


def _codes(df: DataFrame, dims: list[str]) -> dict[str, Column]:
    """A number for each dimension that keeps its order; strings give the seven
    bytes behind the prefix that all values share, so strings that are equal
    there share a level. That loses pruning between them, and no row."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    text = [d for d in dims if isinstance(kinds[d], T.StringType)]
    ends = df.agg(F.lit(0), *[f(F.col(f"`{d}`")) for d in text for f in (F.min, F.max)]).first()
    out = {}
    for d in dims:
        c = F.col(f"`{d}`")
        if d not in text:
            out[d] = c.cast("double")
            continue
        lo, hi = ((ends[1 + 2 * text.index(d) + k] or "").encode() for k in (0, 1))
        same = next((i for i, (a, b) in enumerate(zip(lo, hi, strict=False)) if a != b), min(len(lo), len(hi)))
        seven = F.hex(F.substring(F.encode(c, "UTF-8"), same + 1, 7))
        out[d] = F.conv(F.rpad(seven, 14, "0"), 16, 10).cast("double")
    return out


def hilbert_shards(docs: DataFrame, n_shards: int = 16, dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = 4, ident: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` plus ``hilbert`` (int), ``shard`` (int, from 0)
    and ``slot`` (long, gapless from 0 in each shard).

    Shards hold runs of the curve with row counts at most one apart. A hot cell
    is split freely among its rows. Null or missing dimensions take the lowest
    level; null identifiers and repeated rows are rows like any other, told
    apart by their place in the input; an empty table gives no rows. Of input
    columns named like an output column, the output column wins. All columns
    travel, so leave texts out where only the assignment is wanted. At most
    4096 cells: ``len(dims) * bits`` is 12 or less.
    """
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("hilbert", "shard", "slot")])
    dims = [d for d in dims if d in docs.columns]
    if not dims or len(dims) * bits > 12:
        raise ValueError("1 to 12 bits in all")
    codes = _codes(docs, dims)
    share = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = docs.agg(*[F.percentile_approx(c, share, 10_000) for c in codes.values()]).first()
    cell = F.lit(0)
    for d, at in zip(dims, cuts, strict=True):
        level = F.lit(0)
        for v in sorted(set(at or [])):
            level = level + F.coalesce((codes[d] > F.lit(v)).cast("int"), F.lit(0))
        cell = cell * (1 << bits) + level
    curve = F.split(F.lit(",".join(map(str, curve_table(len(dims), bits)))), ",")
    onto = docs.withColumn("hilbert", F.element_at(curve, cell + 1).cast("int"))
    order = [F.col(f"`{ident}`"), *[F.col(f"`{d}`") for d in dims]]
    placed, counts = positions(onto, "hilbert", order, f"{P}pos")
    total = max(1, sum(counts.values()))
    # integer arithmetic: positions may exceed what doubles hold exactly
    shard = F.expr(f"({P}pos * {n_shards}) div {total}")
    first = F.expr(f"(cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col(f"{P}pos") - first).drop(f"{P}pos")


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, file_rows: int = 1_000_000, **options) -> None:
    """``hilbert_shards`` written as Parquet under ``path``: a folder per shard,
    files of about ``file_rows`` rows in curve order.

    Whole rows are dealt once, by shard and run of slots, so a file covers a
    short stretch of the curve and its footer's minima and maxima are narrow in
    every dimension. Options are those of ``hilbert_shards``.
    """
    placed = hilbert_shards(docs, n_shards, **options)
    run = F.expr(f"slot div {file_rows}")
    dealt = placed.repartition(partitions(docs.sparkSession), "shard", run).sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").option("maxRecordsPerFile", file_rows).parquet(path)


def op1_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    """``documents`` in 16 shards by the law ``rows``. Texts are measured where they are read and don't travel."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), "lang", "source", "n_chars")
    placed = hilbert_shards(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert", "lang", "source", "n_chars")
