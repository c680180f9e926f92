"""Vector codes by parts: a codebook for each part position, found by Lloyd's rounds over kd-trees.

Every task builds, once, kd-trees over blocks of its vectors, one for each part
position; a node holds its bounding box, count and sums. A round walks the
trees from above with the entries that may be nearest to some point of a box:
an entry that another one beats everywhere in the box is dropped, and where one
entry is left the whole subtree is its own, without a look at the points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P, new_path, staged, table
from .vectors import lists, matrix, whole_vectors

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors of a block, over which trees are built: what a task holds at once.
BLOCK = 16_384
#: Points of a leaf, at most.
LEAF = 16
#: Blocks of a file: a reader holds those of one file at a time, however many a task wrote.
FILE_BLOCKS = 16


@dataclass(frozen=True)
class Tree:
    """A tree in which each level halves the nodes of the one above, so that all
    leaves are on one level. ``points`` and ``order`` (their places in the
    block) are in the order of the leaves; ``lo``, ``hi`` and ``sums`` have a row
    per node, level by level from the root."""

    points: np.ndarray
    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    sums: np.ndarray

    @property
    def levels(self) -> int:
        return (len(self.lo) + 1).bit_length() - 1

    def level(self, k: int) -> tuple[slice, np.ndarray]:
        """Rows of the nodes of level ``k``, and the first point of each (and the end)."""
        return slice((1 << k) - 1, (2 << k) - 1), edges(len(self.points), k)


def edges(n: int, k: int) -> np.ndarray:
    """Where the nodes of level ``k`` begin among ``n`` points: each half is cut in two."""
    at = np.array([0, n])
    for _ in range(k):
        at = np.append(np.stack([at[:-1], (at[:-1] + at[1:]) // 2], 1).ravel(), n)
    return at


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over ``points`` (one or more): each node is cut at the median of its widest side."""
    n, order = len(points), np.arange(len(points))
    lo, hi, sums, k = [], [], [], 0
    while True:
        starts = edges(n, k)
        lo.append(np.minimum.reduceat(points, starts[:-1]))
        hi.append(np.maximum.reduceat(points, starts[:-1]))
        sums.append(np.add.reduceat(points.astype(np.int64), starts[:-1]))
        if np.diff(starts).max() <= leaf:
            return Tree(points, order, np.concatenate(lo), np.concatenate(hi), np.concatenate(sums))
        node = np.repeat(np.arange(1 << k), np.diff(starts))
        side = (hi[-1] - lo[-1]).argmax(1)[node]
        sort = np.lexsort((points[np.arange(n), side], node))
        points, order, k = points[sort], order[sort], k + 1


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a.astype(np.int64) - b
    return (d * d).sum(1)


def filtered(tree: Tree, entries: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Each point's nearest entry, the smaller number of equals.

    As ([(level, nodes, their entries)], points, their entries): whole subtrees
    with one entry, and the points of leaves that kept several."""
    whole = []
    node, cand = np.zeros(len(entries), np.int64), np.arange(len(entries))  # pairs, by node, then by entry
    for k in range(tree.levels):
        rows, starts = tree.level(k)
        lo, hi = tree.lo[rows].astype(np.int64), tree.hi[rows].astype(np.int64)
        first = np.flatnonzero(np.diff(node, prepend=-1))
        run = np.repeat(np.arange(len(first)), np.diff(first, append=len(node)))
        # nearest to the middle of the box: any choice is right, this one drops most
        middle = _apart(lo[node] + hi[node], 2 * entries[cand])
        best = np.where(middle == np.minimum.reduceat(middle, first)[run], cand, len(entries)) if len(first) else cand
        star = np.minimum.reduceat(best, first)[run] if len(first) else cand
        # the corner of the box that favours an entry most against that one
        corner = np.where(entries[cand] > entries[star], hi[node], lo[node])
        gap = _apart(corner, entries[cand]) - _apart(corner, entries[star])
        keep = (cand == star) | (gap < 0) | ((gap == 0) & (cand < star))
        node, cand = node[keep], cand[keep]
        alone = np.bincount(node, minlength=1 << k)[node] == 1
        whole.append((k, node[alone], cand[alone]))
        node, cand = node[~alone], cand[~alone]
        if k < tree.levels - 1:
            node = np.concatenate([2 * node, 2 * node + 1])
            by = np.argsort(node, kind="stable")
            node, cand = node[by], np.concatenate([cand, cand])[by]
    least = np.full(len(tree.points), np.iinfo(np.int64).max)
    nearest = np.full(len(tree.points), -1)
    first = np.flatnonzero(np.diff(node, prepend=-1))
    rank = np.arange(len(node)) - np.repeat(first, np.diff(first, append=len(node)))
    for r in range(int(rank.max(initial=-1)) + 1):  # the r-th entry of all leaves at once, in the order of their numbers
        at = np.flatnonzero(rank == r)
        sizes = starts[node[at] + 1] - starts[node[at]]
        pts = np.repeat(starts[node[at]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        own = np.repeat(cand[at], sizes)
        d = _apart(tree.points[pts], entries[own])
        better = d < least[pts]
        least[pts[better]], nearest[pts[better]] = d[better], own[better]
    points = np.flatnonzero(nearest >= 0)
    return whole, points, nearest[points]


def entry_sums(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the points that go to each entry."""
    sums, counts = np.zeros_like(entries, np.int64), np.zeros(len(entries), np.int64)
    whole, points, own = filtered(tree, entries)
    for k, nodes, of in whole:
        rows, starts = tree.level(k)
        np.add.at(sums, of, tree.sums[rows][nodes])
        np.add.at(counts, of, np.diff(starts)[nodes])
    np.add.at(sums, own, tree.points[points].astype(np.int64))
    np.add.at(counts, own, 1)
    return sums, counts


def nearest_entries(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each point, in the order of the block."""
    of = np.empty(len(tree.points), np.int64)
    whole, points, own = filtered(tree, entries)
    for k, nodes, entry in whole:
        starts = tree.level(k)[1]
        sizes = np.diff(starts)[nodes]
        of[np.repeat(starts[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = np.repeat(entry, sizes)
    of[points] = own
    entry, apart = np.empty_like(of), np.empty_like(of)
    entry[tree.order], apart[tree.order] = of, _apart(tree.points, entries[of])
    return entry, apart


#: A block's trees: arrays of them as bytes, in the order of the fields of ``Tree``.
TREES = pa.list_(pa.list_(pa.binary()))


def _packed(tree: Tree) -> list[bytes]:
    return [x.astype(kind).tobytes() for x, kind in zip((tree.points, tree.order, tree.lo, tree.hi, tree.sums), ("<i4", "<i4", "<i4", "<i4", "<i8"), strict=True)]


def _unpacked(raw: list[bytes], width: int) -> Tree:
    points, order, lo, hi, sums = (np.frombuffer(x, kind) for x, kind in zip(raw, ("<i4", "<i4", "<i4", "<i4", "<i8"), strict=True))
    return Tree(points.reshape(-1, width), order, *(x.reshape(-1, width) for x in (lo, hi, sums)))


def tree_blocks(vectors: DataFrame, parts: int, keep: list[str], block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """A row per block of at most ``block`` vectors (columns ``keep`` and ``v``):
    the block's ``keep`` columns as arrays, and the trees of all part positions."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while len(b):
                part = b.slice(0, block - n)
                held.append(part)
                n, b = n + len(part), b.slice(len(part))
                if n == block:
                    yield made(held)
                    held, n = [], 0
        if held:
            yield made(held)

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        v = rows.column("v").chunk(0)
        points = matrix(v, len(v[0]))
        trees = [_packed(build(np.ascontiguousarray(p), leaf)) for p in np.split(points, parts, axis=1)]
        own = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(c).combine_chunks()) for c in keep]
        return pa.RecordBatch.from_arrays([*own, pa.array([trees], TREES)], [*keep, f"{P}trees"])

    schema = ", ".join(f"`{c}` array<{vectors.schema[c].dataType.simpleString()}>" for c in keep)
    return vectors.select(*keep, "v").mapInArrow(blocks, f"{schema}, {P}trees array<array<binary>>")


def refine(blocks: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """One of Lloyd's rounds: entries become the componentwise floor of their
    parts' mean, unused ones stay. Tasks send sums by part, entry and component,
    so the driver gets as many numbers as the codebooks have."""
    width = codebooks[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [(np.zeros_like(c, np.int64), np.zeros(len(c), np.int64)) for c in codebooks]
        for b in batches:
            for trees in b.column(0):
                for (s, n), entries, raw in zip(totals, codebooks, trees.as_py(), strict=True):
                    more = entry_sums(_unpacked(raw, width), entries)
                    s += more[0]
                    n += more[1]
        part, entry, at = np.indices((len(codebooks), len(codebooks[0]), width)).reshape(3, -1)
        total, n = np.stack([s for s, _ in totals]).ravel(), np.repeat(np.stack([n for _, n in totals]).ravel(), width)
        used = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[used], k) for x, k in ((part, pa.int32()), (entry, pa.int32()), (at, pa.int32()), (total, pa.int64()), (n, pa.int64()))], ["part", "entry", "at", "total", "n"])

    found = blocks.select(f"{P}trees").mapInArrow(sums, "part int, entry int, at int, total long, n long")
    out = [c.copy() for c in codebooks]
    for r in found.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r.part][r.entry, r.at] = r.total // r.n
    return out


def codes(blocks: DataFrame, codebooks: list[np.ndarray], keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``entries`` (an array of the nearest entry of each part) and ``error``, the squared distances summed."""
    width = codebooks[0].shape[1]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                found = [nearest_entries(_unpacked(raw, width), entries) for entries, raw in zip(codebooks, b.column(len(keep))[i].as_py(), strict=True)]
                own = [b.column(k)[i].values for k in range(len(keep))]
                entries = lists(np.stack([e for e, _ in found], 1), pa.int32())
                yield pa.RecordBatch.from_arrays([*own, entries, pa.array(sum(d for _, d in found), pa.int64())], [*keep, "entries", "error"])

    kinds = ", ".join(f"`{c}` {blocks.schema[c].dataType.elementType.simpleString()}" for c in keep)
    return blocks.mapInArrow(coded, f"{kinds}, entries array<int>, error long")


def vector_codes(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, entries, error), codebooks) of the vectors of ``df``.

    The codebook of a part starts as that part of the ``entries`` vectors with
    the smallest ids. The dimension is that of the vector of the smallest id
    whose dimension the number of parts divides. Rows go whose vector is null,
    has another dimension, or holds null or non-finite components; components
    beyond ``vectors.bound`` count as that bound. Repeated rows count each, and
    start a codebook in the order of id, then vector; null ids start none, but
    are coded. Fewer rows make smaller codebooks; without any, nothing is
    returned. Other columns, whatever their names, are not read.
    """
    df = df.select(F.col(ident).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    size = F.size("v")
    dim = df.filter((size > 0) & (size % parts == 0)).agg(F.min_by(size, "vec_id")).first()[0] or parts
    kept = whole_vectors(df, "v", dim, ["vec_id", "label"])
    first = kept.select("vec_id", "v").filter("vec_id is not null").orderBy("vec_id", "v").limit(entries).collect()
    if not first:
        return kept.limit(0).select("vec_id", "label", F.col("v").alias("entries"), F.lit(0).cast("long").alias("error")), []
    codebooks = list(np.stack(np.split(np.array([r.v for r in sorted(first)], np.int64), parts, axis=1)))
    trees, path = tree_blocks(kept, parts, ["vec_id", "label"]), new_path(df.sparkSession, "trees")
    trees.write.option("maxRecordsPerFile", FILE_BLOCKS).parquet(path)
    blocks = df.sparkSession.read.schema(trees.schema).parquet(path)
    for _ in range(rounds):
        codebooks = refine(blocks, codebooks)
    return codes(blocks, codebooks, ["vec_id", "label"]), codebooks


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` plus ``label_error``: the error summed over equal labels, nulls
    together; null where it is beyond a long. Labels meet their sums by a join
    that may split a hot label."""
    coded = staged(coded, "codes")
    sums = coded.groupBy(F.col("label").alias(f"{P}label")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums[f"{P}label"])).drop(f"{P}label")


def op12_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` as codes of 16 parts of two hex digits."""
    coded, codebooks = vector_codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()
    code = F.lower(F.concat_ws("", F.transform("entries", lambda e: F.lpad(F.hex(e), 2, "0"))))
    return with_label_error(coded.select("vec_id", "label", code.alias("code"), "error")).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Codebook k + 1 from codebook k: assignment, then floors of the means; unused entries stay."""
    return f"""
near{k} as (select vec_id, part, min(d * 64 + entry) % 64 as entry, min(d * 64 + entry) // 64 as d
  from (select c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::bigint as d
        from comp c join book{k} b on c.part = b.part and c.pos = b.pos group by all) group by all),
book{k + 1} as (select b.part, b.entry, b.pos, coalesce(m.x, b.x) as x from book{k} b left join
  (select c.part, n.entry, c.pos, ((sum(c.x) - ((sum(c.x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as x
   from comp c join near{k} n using (vec_id, part) group by all) m using (part, entry, pos))"""


#: Vectors of a multiple of 16 components, ids without repeats.
OP12_SQL = f"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
comp as materialized (select vec_id, (i // (len(v) // 16))::int as part, (i % (len(v) // 16))::int as pos, v[i + 1] as x
  from (select *, unnest(range(len(v))) as i from kept)),
first as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit 64),
book0 as (select part, entry, pos, x from comp join first using (vec_id)),{_round_sql(0)},{_round_sql(1)},
near2 as (select vec_id, part, min(d * 64 + entry) % 64 as entry, min(d * 64 + entry) // 64 as d
  from (select c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::bigint as d
        from comp c join book2 b on c.part = b.part and c.pos = b.pos group by all) group by all),
coded as (select vec_id, string_agg(printf('%02x', entry::bigint), '' order by part) as code, sum(d)::bigint as error from near2 group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(x::bigint::varchar, ',' order by part, entry, pos)) from book2) as codebooks_sha256
from coded join kept using (vec_id)
"""
