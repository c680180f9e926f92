"""Exact Jaccard join over word shingles with signature trees, and its components.

1. Rows with equal sets become one node, named by a 64-bit hash of the set.
2. Frequent shingles are found; each node's prefix (so many shingles that two
   sets of the wanted similarity must share one of them) takes rare ones first.
3. Nodes that share a prefix shingle form a block. Most blocks of a family of
   copies have the same members and collapse into one. The block of a shingle
   that very many nodes have is dealt in pieces.
4. Some centres of each block, one for a small block, are compared with its
   other members; what is linked by then needs no comparison among itself.
5. What remains of a block is joined with itself by signature trees, each two
   pieces in a task of their own: each tree node holds the OR of its members'
   bitmaps and their range of set sizes, and a dual traversal leaves out pairs
   of tree nodes whose members cannot overlap enough or are linked already.
6. Surviving pairs are verified on the whole sets; links give components.
7. Links lie within components, so they are counted there: a component in which
   not all pairs were found above is cut into tiles, and each tile compares all
   its pairs of whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, staged, table
from .shingles import Powers, mix, set_key, shingle_sets

#: Sets are linked when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A shingle is frequent from so many sets on, or from this share of the documents if that is more.
FREQUENT, FREQUENT_SHARE = 64, 4096
#: Frequent shingles are broadcast: at most so many; beyond it the threshold rises.
MOST_FREQUENT = 4_000_000
#: Ids of documents to read again are broadcast up to so many; beyond it they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Bits of a bitmap for each shingle, rounded up to a power of two within these bounds.
BITS, LEAST_BITS, MOST_BITS = 4, 256, 1 << 17
#: Members of a piece of a block, about; blocks of up to twice as many are whole.
PIECE = 512
FAN_OUT = 4
#: Blocks by which two members tell whether a pair is another block's: enough for near copies, which share most.
FIRST_BLOCKS = 8
#: Centres of a block: the first of its members by name, one more with each doubling beyond 64.
CENTRES = "greatest(1, length(bin(size(members))) - 6)"

#: A tile of a component holds two chunks of its sets: so many shingles each, a set counting as LEAST_SET at least.
CHUNK_SHINGLES, LEAST_SET = 1 << 19, 512
#: Pairs that a shingle of a tile may have to be counted one by one; those of more go through a matrix product.
FEW_PAIRS = 8192


def _needed(x: int, y: int) -> int:
    """Least intersection of sets of these sizes that are linked."""
    return -(-PERCENT * (x + y) // (100 + PERCENT))


def _fits(x: int, y: int) -> bool:
    """Whether sets of these sizes can be linked at all."""
    return 100 * min(x, y) >= PERCENT * max(x, y)


def prefix_length(n: int) -> int:
    """Two linked sets, one of ``n`` shingles, share one among so many first ones of any common order."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def width_of(n: int) -> int:
    return max(LEAST_BITS, min(MOST_BITS, 1 << max(0, BITS * n - 1).bit_length()))


def bitmap(tokens: np.ndarray, width: int) -> bytes:
    bits = np.zeros(width, np.uint8)
    bits[(tokens >> np.uint64(8)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _longs(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


# ---------------------------------------------------------------- the tree


@dataclass
class Member:
    key: int
    size: int
    label: int
    order: int
    bits: int  # as a whole number, of ``width`` bits
    width: int


@dataclass
class Node:
    """OR-combined bitmaps at the members' width and at half of it, sizes, and
    the most shingles that any member has beyond its set bits, at each width.
    ``label`` is set if all members bear it."""

    low: int
    high: int
    bits: tuple[int, int]
    beyond: tuple[int, int]
    label: int | None
    kids: list[Node]
    member: Member | None = None


def _leaf(m: Member) -> Node:
    half = m.width // 2
    folded = m.bits & ((1 << half) - 1) | m.bits >> half
    return Node(m.size, m.size, (m.bits, folded), (m.size - m.bits.bit_count(), m.size - folded.bit_count()), m.label, [], m)


def _parent(kids: list[Node]) -> Node:
    if len(kids) == 1:
        return kids[0]
    labels = {k.label for k in kids}
    return Node(
        min(k.low for k in kids),
        max(k.high for k in kids),
        tuple(reduce(lambda a, b: a | b, (k.bits[i] for k in kids)) for i in (0, 1)),
        tuple(max(k.beyond[i] for k in kids) for i in (0, 1)),
        labels.pop() if len(labels) == 1 else None,
        kids,
    )


def build_tree(members: list[Member]) -> Node:
    """Over members of one width, similar ones side by side: equal rounded sizes, then the order given by their smallest shingle."""
    level = [_leaf(m) for m in sorted(members, key=lambda m: (m.size.bit_length(), m.order, m.size, m.key))]
    while len(level) > 1:
        level = [_parent(level[i : i + FAN_OUT]) for i in range(0, len(level), FAN_OUT)]
    return level[0]


def _possible(a: Node, b: Node, i: int, j: int) -> bool:
    """Whether a member of ``a`` and one of ``b`` may be linked; ``i`` and ``j`` pick bitmaps of one width."""
    if a.label is not None and a.label == b.label or not (_fits(a.low, b.low) or a.low <= b.high and b.low <= a.high or _fits(a.high, b.low) or _fits(a.low, b.high)):
        return False
    most = (a.bits[i] & b.bits[j]).bit_count() + min(a.beyond[i], b.beyond[j])
    return min(most, a.high, b.high) >= _needed(a.low, b.low)


def dual_join(a: Node, b: Node, i: int = 0, j: int = 0) -> Iterator[tuple[Member, Member]]:
    """Pairs of members of the two trees that may be linked; of one tree with itself each pair once."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if a is b:
            if a.label is None:
                stack += [(x, y) for k, x in enumerate(a.kids) for y in a.kids[k:]]
        elif _possible(a, b, i, j):
            if not a.kids and not b.kids:
                yield a.member, b.member
            elif b.kids and (not a.kids or b.high - b.low > a.high - a.low):
                stack += [(a, k) for k in b.kids]
            else:
                stack += [(k, b) for k in a.kids]


def block_pairs(members: list[Member]) -> Iterator[tuple[Member, Member]]:
    """Pairs in a block that may be linked: a tree per bitmap width, each joined with itself and with the next width's at the common one."""
    by: dict[int, list[Member]] = {}
    for m in members:
        by.setdefault(m.width, []).append(m)
    trees = {w: build_tree(ms) for w, ms in by.items()}
    for w, tree in trees.items():
        yield from dual_join(tree, tree)
        if 2 * w in trees:
            yield from dual_join(tree, trees[2 * w], 0, 1)


def cross_pairs(left: list[Member], right: list[Member]) -> Iterator[tuple[Member, Member]]:
    """As ``block_pairs``, of a member of each list."""
    trees: tuple[dict[int, Node], dict[int, Node]] = ({}, {})
    for side, members in enumerate((left, right)):
        by: dict[int, list[Member]] = {}
        for m in members:
            by.setdefault(m.width, []).append(m)
        trees[side].update({w: build_tree(ms) for w, ms in by.items()})
    for w, tree in trees[0].items():
        for other, i, j in ((w, 0, 0), (2 * w, 0, 1), (w // 2, 1, 0)):
            if other in trees[1]:
                yield from dual_join(tree, trees[1][other], i, j)


# ---------------------------------------------------------------- the passes over texts


def _sets(docs: DataFrame, emit, schema: str) -> DataFrame:
    """``emit`` gets (ids, sets) of each batch of ``docs`` (doc_id, text) and yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            yield from emit(b.column(0), list(shingle_sets(b.column(1), powers)))

    return docs.mapInArrow(run, schema)


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k, token, sets): a row per document, and rows with null n that count shingles that recur in a batch."""

    def emit(ids: pa.Array, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = [set_key(s) for s in sets]
        nothing = pa.nulls(len(sets), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), nothing, nothing], names)
        one = {k: s for k, s in zip(keys, sets, strict=True)}
        if len(one) > 2:
            tokens, counts = np.unique(np.concatenate(list(one.values())), return_counts=True)
            often = counts >= 2
            nothing = pa.nulls(int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, _longs(tokens[often]), pa.array(counts[often])], names)

    names = ["doc_id", "n", "k", "token", "sets"]
    return _sets(docs, emit, "doc_id long, n long, k long, token long, sets long")


def frequent_shingles(counts: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the frequent shingles, and the pieces that the block of
    each is dealt in. They set the order of prefixes and the split of blocks, so
    one that is missed costs time, not links."""
    summed = staged(counts.groupBy("token").agg(F.sum("sets").alias("sets")).filter(F.col("sets") >= FREQUENT), "frequent")
    least = max(FREQUENT, n_docs // FREQUENT_SHARE)
    while summed.filter(F.col("sets") >= least).count() > MOST_FREQUENT:
        least *= 2
    found = summed.filter(F.col("sets") >= least).select("token", F.ceil(F.col("sets") / PIECE).cast("int").alias("pieces")).toArrow()
    tokens, pieces = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(tokens)
    return tokens[order], pieces[order]


def prefixes(docs: DataFrame, frequent) -> DataFrame:
    """(token, piece, k): each set's prefix, once for each batch that has the
    set; piece is -1 but for shingles whose blocks are dealt in pieces."""

    def emit(ids: pa.Array, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hot, pieces = frequent.value
        seen: set[int] = set()
        tokens, parts, keys = [], [], []
        for s in sets:
            k = set_key(s)
            if k in seen or not len(s):
                continue
            seen.add(k)
            p = prefix_length(len(s))
            part = np.full(p, -1, np.int32)
            if len(hot):
                at = np.searchsorted(hot, s)
                at[at == len(hot)] = 0
                often = hot[at] == s
                rare = int((~often).sum())
                s = np.concatenate((s[~often], s[often]))
                if rare < p:
                    of = pieces[at[often]][: p - rare]
                    part[rare:] = np.where(of > 1, (k & 0x7FFFFFFF) % of, -1)
            tokens.append(s[:p])
            parts.append(part)
            keys.append(np.full(p, k, np.int64))
        if tokens:
            yield pa.RecordBatch.from_arrays([_longs(np.concatenate(tokens)), pa.array(np.concatenate(parts)), pa.array(np.concatenate(keys))], ["token", "piece", "k"])

    return _sets(docs, emit, "token long, piece int, k long")


def blocks(prefix: DataFrame) -> DataFrame:
    """(block, piece, members): the lists of two or more nodes that share a
    prefix shingle, equal ones once. Blocks of many members come in pieces of
    one block, numbered from 0; the piece of a whole block is -1."""
    piece_members = PIECE

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(names: np.ndarray, pieces: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
            values = np.concatenate([keys[a : a + n] for a, n in zip(starts, sizes, strict=True)] or [keys[:0]])
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            return pa.RecordBatch.from_arrays([_longs(names), pa.array(pieces, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["block", "piece", "members"])

        def closed(tokens: np.ndarray, parts: np.ndarray, keys: np.ndarray, more: int) -> pa.RecordBatch:
            """``more``: the pieces that the first run has given already."""
            starts = np.flatnonzero(np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (parts[1:] != parts[:-1]))))
            sizes = np.diff(np.append(starts, len(tokens)))
            pieces = np.where(parts[starts] >= 0, parts[starts].astype(np.int64) << 32, -1)
            if more:
                pieces[0] = (max(int(parts[0]), 0) << 32) + more
            whole = pieces < 0
            names = np.where(whole, mix(np.add.reduceat(mix(keys.view(np.uint64)), starts) ^ sizes.astype(np.uint64)), tokens[starts].view(np.uint64))
            many = np.flatnonzero(~whole | (sizes > 1))
            _, first = np.unique(np.stack([names[many].view(np.int64), pieces[many]]), axis=1, return_index=True)
            at = many[first]
            return lists(names[at], pieces[at], starts[at], sizes[at], keys)

        tail, more = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)], 0
        with np.errstate(over="ignore"):
            for b in batches:
                if not len(b):
                    continue
                t, p, k = (np.concatenate((x, b.column(i).to_numpy())) for i, x in enumerate(tail))
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1]) | (k[1:] != k[:-1])
                t, p, k = t[new], p[new], k[new]
                last = np.flatnonzero((t != t[-1]) | (p != p[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield closed(t[:cut], p[:cut], k[:cut], more)
                    more = 0
                tail = [t[cut:], p[cut:], k[cut:]]
                while len(tail[0]) > 2 * piece_members:
                    part = (max(int(tail[1][0]), 0) << 32) + more
                    yield lists(tail[0][:1].view(np.uint64), np.array([part]), np.array([0]), np.array([piece_members]), tail[2])
                    more += 1
                    tail = [x[piece_members:] for x in tail]
            if len(tail[0]):
                yield closed(*tail, more)

    dealt = prefix.repartition(partitions(prefix.sparkSession), "token", "piece").sortWithinPartitions("token", "piece", "k")
    found = dealt.mapInArrow(gather, "block long, piece long, members array<long>").dropDuplicates(["block", "piece"])
    near = found.withColumn("home", F.array_min("members")).repartition(partitions(prefix.sparkSession), "home").sortWithinPartitions("home", F.desc(F.size("members")), "block")
    return near.mapInArrow(widest, "block long, piece long, members array<long>")


def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (block, piece, members, home; by home, larger ones first) without
    those whose members are all in one of the first whole blocks of the same
    home: its pairs are there too."""
    home, kept = None, []
    for b in batches:
        keep = []
        for h, piece, members in zip(b.column(3).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if h != home:
                home, kept = h, []
            if piece >= 0:
                keep.append(True)
                continue
            m = frozenset(members)
            keep.append(not any(m <= k for k in kept))
            if keep[-1] and len(kept) < 64:
                kept.append(m)
        yield b.select(["block", "piece", "members"]).filter(pa.array(keep, pa.bool_()))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it has no more rows than ``BROADCAST_IDS``."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def _again(docs: DataFrame, nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for the nodes ``keys`` (column k), and rows that share their ids."""
    ids = staged(nodes.join(keys, "k", "left_semi").select(F.col("rid").alias("doc_id")), "again")
    return docs.join(_small(ids), "doc_id", "left_semi")


def _once(make, schema: pa.Schema):
    """An ``emit`` for ``_sets``: a row of ``make(key, tokens)`` for each set, once in a task.

    Where ids repeat, several tasks may give a node; the rows are equal, and
    what is made of them is made distinct.
    """
    seen: set[int] = set()

    def emit(ids: pa.Array, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = []
        for s in sets:
            if len(s) and (k := set_key(s)) not in seen:
                seen.add(k)
                rows.append(make(k, s))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema.names)

    return emit


def signatures(docs: DataFrame, nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, n, least, bits) of the nodes ``keys``."""
    schema = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("bits", pa.binary())])
    emit = _once(lambda k, s: (k, len(s), int(s[0].view(np.int64)), bitmap(s, width_of(len(s)))), schema)
    return staged(_sets(_again(docs, nodes, keys), emit, "k long, n long, least long, bits binary"), "signatures")


def _member(k: int, n: int, label: int, least: int, bits: bytes) -> Member:
    return Member(k, n, label, least, int.from_bytes(bits, "little"), 8 * len(bits))


def may_link(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps allow a link."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for k, n, bits, l, m, other in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                keep.append(_fits(n, m) and any(True for _ in block_pairs([_member(k, n, k, 0, bits), _member(l, m, l, 0, other)])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    an, bn = (marks.select(F.col("k").alias(x), F.col("n").alias(f"{x}n")) for x in "ab")
    abits, bbits = (marks.select(F.col("k").alias(x), F.col("bits").alias(f"{x}bits")) for x in "ab")
    # sizes alone first: bitmaps go with few pairs
    fits = pairs.join(an, "a").join(bn, "b").filter(100 * F.least("an", "bn") >= PERCENT * F.greatest("an", "bn"))
    both = staged(fits, "fitting").join(abits, "a").join(bbits, "b")
    return both.select("a", "an", "abits", "b", "bn", "bbits").mapInArrow(test, "a long, b long")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) that are linked, by their whole sets. ``pairs`` is a written table."""
    emit = _once(lambda k, s: (k, s.tobytes()), pa.schema([("k", pa.int64()), ("tokens", pa.binary())]))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                keep.append(int((y[at] == x).sum()) >= _needed(len(x), len(y)))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    if not pairs.limit(1).count():
        return pairs
    keys = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct()
    sets = staged(_sets(_again(docs, nodes, keys), emit, "k long, tokens binary"), "sets")
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("k").alias("b"), F.col("tokens").alias("y")), "b")
    return staged(both.select("a", "b", "x", "y").mapInArrow(test, "a long, b long").distinct(), "links")


def stars(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of a block's centres with its members; a block in pieces has one more centre for all of them."""
    own = lists.select("members", F.explode(F.slice("members", 1, F.expr(CENTRES))).alias("c"))
    pieces = lists.filter("piece >= 0").select("block", "members")
    first = pieces.groupBy("block").agg(F.min(F.array_min("members")).alias("c"))
    centres = own.unionByName(pieces.join(_small(first), "block").select("members", "c"))
    pairs = centres.select("c", F.explode("members").alias("m")).filter("c <> m")
    return pairs.select(F.least("c", "m").alias("a"), F.greatest("c", "m").alias("b")).distinct()


def labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(block, piece, k, centre, label) of the blocks whose members bear two labels or more."""
    each = lists.filter("size(members) > 2 or piece >= 0").select("block", "piece", F.expr(CENTRES).alias("c"), F.posexplode("members").alias("at", "k"))
    told = each.join(labels, "k", "left").select("block", "piece", "k", (F.col("at") < F.col("c")).alias("centre"), F.coalesce("label", "k").alias("label"))
    told = staged(told, "labelled")
    mixed = told.groupBy("block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("block")
    return staged(told.join(_small(mixed), "block", "left_semi"), "mixed")


def in_tiles(rows: DataFrame) -> DataFrame:
    """``rows`` (block, piece, ...) plus u and v, the two pieces that a tile
    compares: a row goes to a tile for each piece of its block."""
    whole = rows.filter("piece < 0").withColumns({"u": F.col("piece"), "v": F.col("piece")})
    pieces = staged(rows.filter("piece >= 0").select("block", "piece").distinct(), "pieces")
    met = pieces.withColumnRenamed("piece", "u").join(pieces.withColumnRenamed("piece", "v"), "block").filter("u <= v")
    sides = met.withColumn("piece", F.explode(F.array_distinct(F.array("u", "v"))))
    return whole.unionByName(rows.filter("piece >= 0").join(_small(sides), ["block", "piece"]).select(whole.columns))


def tree_pairs(lists: DataFrame, marks: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs that the signature trees of the blocks let through, each by the
    first of the blocks that both members are in, as far as the first few of
    each member tell; the pairs with a block's centres have been looked at
    before. A member is in as many blocks as its prefix has shingles at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        tile, rows = None, []

        def close() -> None:
            block, u, v = tile
            where = {r[4]: frozenset(r[9]) for r in rows}
            if u == v:
                pairs = block_pairs(list({r[4]: _member(*r[4:9]) for r in rows if not r[10]}.values()))
            else:
                left, right = ({r[4]: _member(*r[4:9]) for r in rows if r[3] == side} for side in (u, v))
                pairs = cross_pairs(list(left.values()), list(right.values()))
            for x, y in pairs:
                common = where[x.key] & where[y.key]
                if x.label != y.label and (not common or min(common) == block):
                    found.append((min(x.key, y.key), max(x.key, y.key)))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])
            found.clear()
            return batch

        for b in batches:
            for r in zip(*[b.column(i).to_pylist() for i in range(11)], strict=True):
                if tile != r[:3]:
                    if tile:
                        close()
                    tile, rows = r[:3], []
                    if len(found) > 50_000:
                        yield flush()
                rows.append(r)
        if tile:
            close()
        if found:
            yield flush()

    told = labelled(lists, labels)
    homes = told.groupBy("k").agg(F.min("label").alias("label"), F.collect_set(F.struct("block", "piece", "centre")).alias("in"))
    rows = homes.join(marks, "k").withColumn("blocks", F.slice(F.array_sort("in.block"), 1, FIRST_BLOCKS)).withColumn("here", F.explode("in"))
    rows = in_tiles(rows.select("here.block", "here.piece", "k", "n", "label", "least", "bits", "blocks", "here.centre"))
    dealt = rows.repartition(partitions(rows.sparkSession), "block", "u", "v").sortWithinPartitions("block", "u", "v")
    return dealt.select("block", "u", "v", "piece", "k", "n", "label", "least", "bits", "blocks", "centre").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(k, label): the smallest name in each node's component, by label passing
    and pointer jumping; a table is written in each round, so lineage stays short."""
    edges = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("k")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("k", "b"), "b").groupBy(F.col("a").alias("k")).agg(F.min("label").alias("near"))
        told = labels.join(near, "k").withColumn("new", F.least("label", "near"))
        up = labels.select(F.col("k").alias("new"), F.col("label").alias("far"))
        done = staged(told.join(up, "new", "left").select("k", F.least("new", F.coalesce("far", "new")).alias("label"), (F.least("new", F.coalesce("far", "new")) != F.col("label")).alias("changed")), "labels")
        labels = done.select("k", "label")
        if not done.filter("changed").limit(1).count():
            return labels


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Components (k, label) after ``more`` links (a, b), which join components of ``labels`` or single nodes."""
    a, b = (labels.select(F.col("k").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    ends = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y"))
    above = components(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    top = above.select(F.col("k").alias("label"), F.col("label").alias("top"))
    lifted = labels.join(top, "label", "left").select("k", F.coalesce("top", "label").alias("label"))
    return lifted.unionByName(above.join(labels.select("k"), "k", "left_anti"))


# ---------------------------------------------------------------- the count of links


def shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The number of common shingles of each set of ``x`` with each of ``y``."""
    nx, ny = (np.array([len(s) for s in sets]) for sets in (x, y))
    tokens, at = np.unique(np.concatenate(x + y), return_inverse=True)
    ax, ay = at[: nx.sum()], at[nx.sum() :]
    rows, cols = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
    dx, dy = np.bincount(ax, minlength=len(tokens)), np.bincount(ay, minlength=len(tokens))
    out = np.zeros((len(x), len(y)), np.int32)
    # shingles of many pairs: dense slabs
    many = np.flatnonzero(dx * dy > FEW_PAIRS)
    for i in range(0, len(many), 4096):
        slab = many[i : i + 4096]
        place = np.full(len(tokens), -1)
        place[slab] = np.arange(len(slab))
        a, b = np.zeros((len(x), len(slab)), np.float32), np.zeros((len(y), len(slab)), np.float32)
        inx, iny = place[ax] >= 0, place[ay] >= 0
        a[rows[inx], place[ax[inx]]] = 1
        b[cols[iny], place[ay[iny]]] = 1
        out += (a @ b.T).astype(np.int32)
    # the others: each pair that shares one, in runs of bounded length
    order = np.argsort(ay, kind="stable")
    starts = np.concatenate(([0], np.cumsum(dy)))
    few = np.flatnonzero((dy[ax] > 0) & (dx * dy <= FEW_PAIRS)[ax])
    ends = np.cumsum(dy[ax[few]])
    flat = out.reshape(-1)
    at = 0
    while at < len(few):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 22), "right")))
        run = few[at:stop]
        n = dy[ax[run]]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other = cols[order[np.repeat(starts[ax[run]], n) + within]]
        flat += np.bincount(np.repeat(rows[run], n) * len(y) + other, minlength=len(flat)).astype(np.int32)
        at = stop
    return out


def linked(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Whether each set of ``x`` is linked with each of ``y``."""
    nx, ny = (np.array([len(s) for s in sets]) for sets in (x, y))
    return shared(x, y) >= _needed(nx[:, None], ny[None, :])


def tiles(members: DataFrame) -> DataFrame:
    """(k, label, u, v, second) of ``members`` (k, label, n): the tiles (label, u, v)
    that a set takes part in, ``second`` if as one of chunk v. Chunks follow
    sizes; each pair of sets whose sizes can be linked is in one tile."""
    # a row per size: where its sets start and end, in shingles; a size of many sets is spread over its chunks
    sizes = members.groupBy("label", "n").agg(F.sum(F.greatest("n", F.lit(LEAST_SET))).alias("w"))
    upto = F.sum("w").over(Window.partitionBy("label").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = sizes.withColumn("end", upto).select("label", "n", F.floor((F.col("end") - F.col("w")) / CHUNK_SHINGLES).alias("from"), F.floor((F.col("end") - 1) / CHUNK_SHINGLES).alias("to"))
    cut = members.join(_small(staged(spans, "spans")), ["label", "n"]).withColumn("chunk", F.col("from") + F.pmod(F.xxhash64("k"), F.col("to") - F.col("from") + 1))
    cut = staged(cut.select("k", "label", "n", "chunk"), "chunks")
    ranges = cut.groupBy("label", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    u = ranges.select("label", F.col("chunk").alias("u"), F.col("high").alias("most"))
    v = ranges.select("label", F.col("chunk").alias("v"), F.col("low").alias("least"))
    met = staged(u.join(v, "label").filter(f"u = v or u < v and 100 * most >= {PERCENT} * least").select("label", "u", "v"), "tiles")
    first = cut.join(met.withColumn("chunk", F.col("u")), ["label", "chunk"]).select("k", "label", "u", "v", F.lit(False).alias("second"))
    other = cut.join(met.filter("u < v").withColumn("chunk", F.col("v")), ["label", "chunk"]).select("k", "label", "u", "v", F.lit(True).alias("second"))
    return first.unionByName(other)


def degrees(docs: DataFrame, nodes: DataFrame, marks: DataFrame, known: DataFrame, links: DataFrame) -> DataFrame:
    """(k, links): the number of linked nodes of each node of ``known`` (k, label).
    ``links`` are the pairs found; they suffice where they are all of a component's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, halves = None, ({}, {})

        def close() -> pa.RecordBatch:
            (xk, x), (yk, y) = ((list(h), [np.frombuffer(s, np.uint64) for s in h.values()]) for h in halves)
            if tile[1] == tile[2]:
                found = linked(x, x)
                keys, n = xk, found.sum(1) - 1
            else:
                found = linked(x, y)
                keys, n = xk + yk, np.concatenate((found.sum(1), found.sum(0)))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["k", "links"])

        for b in batches:
            for label, u, v, second, k, tokens in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                if tile != (label, u, v):
                    if tile:
                        yield close()
                    tile, halves = (label, u, v), ({}, {})
                halves[second][k] = tokens
        if tile:
            yield close()

    ends = links.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").count().withColumnRenamed("count", "links")
    found = staged(known.join(ends, "k").select("k", "label", "links"), "degrees")
    sizes = found.groupBy("label").agg(F.count("*").alias("m"), F.sum("links").alias("ends"))
    part = found.join(sizes.filter("ends < m * (m - 1)").select("label"), "label", "left_semi")
    part = staged(part.join(marks.select("k", "n").dropDuplicates(["k"]), "k").select("k", "label", "n"), "unfinished")
    if not part.limit(1).count():
        return found.select("k", "links")
    emit = _once(lambda k, s: (k, s.tobytes()), pa.schema([("k", pa.int64()), ("tokens", pa.binary())]))
    sets = _sets(_again(docs, nodes, part.select("k")), emit, "k long, tokens binary")
    placed = sets.join(tiles(part), "k").select("label", "u", "v", "second", "k", "tokens")
    dealt = placed.repartition(partitions(docs.sparkSession), "label", "u", "v").sortWithinPartitions("label", "u", "v")
    counted = staged(dealt.mapInArrow(count, "k long, links long").groupBy("k").agg(F.sum("links").alias("links")), "counted")
    return counted.unionByName(found.select("k", "links").join(part.select("k"), "k", "left_anti"))


def jaccard_components(docs: DataFrame, ident: str = "doc_id", text: str = "text", count_links: bool = True, with_key: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, links): one row per row of ``docs``;
    ``with_key`` adds ``set_key``, which names the row's set (null if empty), and
    ``component``, which names its component also where two have one smallest id.

    ``component_id`` is the smallest id reachable by links, itself included;
    ``links`` counts the linked nodes (distinct other sets) of the row's set, all
    of them; without ``count_links`` the column is left out.
    Rows with equal sets are linked; empty sets are linked with nothing. Null
    ids and repeated rows are rows like the others, except that a set that only
    rows of null id have is linked to equal sets alone. An empty table gives no
    rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    told = staged(describe(docs), "described")
    rows = told.filter("n is not null").select("doc_id", "n", "k")
    nodes = staged(rows.filter("n > 0").groupBy("k").agg(F.min("doc_id").alias("rid")), "nodes")
    # at most MOST_FREQUENT hashes of 8 bytes, and 4 for their pieces
    hot = spark.sparkContext.broadcast(frequent_shingles(told.filter("n is null"), rows.count()))
    lists = staged(blocks(prefixes(docs, hot)), "blocks")
    marks = signatures(docs, nodes, lists.select(F.explode("members").alias("k")).distinct())
    first = verified(docs, nodes, staged(may_link(stars(lists), marks), "stars"))
    labels = components(first)
    rest = verified(docs, nodes, staged(tree_pairs(lists, marks, labels), "tree-pairs"))
    links = staged(first.union(rest).distinct(), "all-links")
    known = staged(merged(labels, rest), "known")
    grouped = nodes.join(known, "k", "left").select("k", "rid", F.coalesce("label", "k").alias("label"))
    smallest = grouped.groupBy("label").agg(F.min("rid").alias("component_id"))
    named = grouped.join(smallest, "label").select("k", "component_id", F.col("label").alias("component"))
    full = rows.filter("n > 0").join(named, "k", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("k").alias("set_key"), "component")
    none = F.lit(None).cast("long")
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), none.alias("set_key"), none.alias("component"))
    if count_links:
        counted = degrees(docs, nodes, marks, known, links).withColumnRenamed("k", "set_key")
        full = full.join(counted, "set_key", "left").withColumn("links", F.coalesce("links", F.lit(0)))
        empty = empty.withColumn("links", F.lit(0).cast("long"))
    out = full.unionByName(empty)
    return out if with_key else out.drop("set_key", "component")


def with_set_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``set_key``, as ``jaccard_components`` names sets."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            keys = [set_key(s) if len(s) else None for s in shingle_sets(b.column(at), powers)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], [*b.schema.names, "set_key"])

    return docs.mapInArrow(run, docs.withColumn("set_key", F.lit(None).cast("long")).schema)


def op9_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
