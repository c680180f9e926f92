"""Pairs of texts within an edit similarity, met in pieces that edits can't all have touched.

Of two texts the larger one decides how many edits d are allowed: a share of its
own size. It is cut into d + 1 pieces. Let i (from 0) be the first piece up to
whose end there are no more than i edits: it has none itself, i at most stand
before it and d - i behind, so the other text has it whole, shifted by no more
than i seen from the start and d - i seen from the end. Pieces are cut where few
texts have them, by counts of all texts' runs of characters, so that common
words end up in few, long pieces. Texts probe with their runs of the piece
lengths. The counts only choose the cuts; every pair is found whatever they say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import written

#: Lengths of pieces, in characters.
LENGTHS = (1, 2, 3, 5, 8, 13)
#: Counters of runs, by hash: a bound on what the driver sends to tasks, whatever the number of texts.
COUNTERS = 1 << 20
#: Longer texts are cut evenly, as the best cut costs their length times their edits.
EVENLY = 512
#: The rows of a frequent piece are joined in splits of about so many.
TILE = 2000
#: The key of texts that are too short for their pieces, which meet all.
ALL = 0


def runs(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, key) of all runs of ``length`` characters; equal runs have equal keys."""
    sizes = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begins = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(texts)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = begins[text] + place
    key = np.full(len(at), length, np.uint64)
    for k in range(length):
        key = (key ^ points[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return text, place, key


def signatures(texts: list[str]) -> np.ndarray:
    """Two words of 64 bits a text: for each of 32 kinds of characters as many bits (four at most) as it has of them.

    An edit changes two counts by one at most, so the words of texts within d edits differ in 2 * d bits at most."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    kind = ((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(59)).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    counts = np.minimum(np.bincount(text * 32 + kind, minlength=32 * len(texts)), 4).reshape(len(texts), 2, 16)
    bits = ((1 << counts) - 1).astype(np.uint64) << (4 * np.arange(16, dtype=np.uint64))
    return np.bitwise_or.reduce(bits, axis=2)


def _signed(texts: list[str], text: np.ndarray) -> list[pa.Array]:
    words = signatures(texts)[text].view(np.int64)
    return [pa.array(words[:, 0]), pa.array(words[:, 1])]


def _counter(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def run_counts(low: DataFrame) -> np.ndarray:
    """How many runs of all texts (id, n, …) fall on each counter."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for length in LENGTHS:
                total += np.bincount(_counter(runs(b.column(0).to_pylist(), length)[2]), minlength=COUNTERS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["counter", "c"])

    found = low.select("n").mapInArrow(counted, "counter int, c long").groupBy("counter").agg(F.sum("c").alias("c")).toArrow()  # a row per counter at most
    out = np.zeros(COUNTERS)
    out[found["counter"].to_numpy()] = found["c"].to_numpy()
    return out


def best_cuts(costs: np.ndarray, sizes: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number from 0, place, which of ``LENGTHS``) of the pieces of each text that cost least together.

    ``costs`` has, for each text, length and place, what a piece there costs
    (infinite where it doesn't fit); text i gets ``pieces[i]`` pieces that don't
    overlap, all of which fit."""
    n, _, width = costs.shape
    rows = np.arange(n)
    least = np.zeros((n, width + 1))
    steps = []
    for _ in range(int(pieces.max(initial=0))):
        ends = np.full((len(LENGTHS), n, width + 1), np.inf)
        for k, length in enumerate(LENGTHS):
            if length <= width:
                ends[k, :, length:] = least[:, : width + 1 - length] + costs[:, k, : width + 1 - length]
        which, best = ends.argmin(0), ends.min(0)
        least = np.minimum.accumulate(best, axis=1)
        # the last place at or before each at which the least is reached
        reached = np.maximum.accumulate(np.where(best <= least, np.arange(width + 1), 0), axis=1)
        steps.append((which, reached))
    text, nth, place, kind = [], [], [], []
    until = sizes.copy()
    for j in reversed(range(len(steps))):
        which, reached = steps[j]
        own = rows[pieces > j]
        end = reached[own, until[own]]
        k = which[own, end]
        until[own] = end - np.array(LENGTHS)[k]
        text.append(own)
        nth.append(np.full(len(own), j))
        place.append(until[own])
        kind.append(k)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (text, nth, place, kind))


def _even_cuts(size: int, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lengths (of ``LENGTHS``) of pieces at even distances."""
    room = size // pieces
    length = max(x for x in LENGTHS if x <= room)
    return np.arange(pieces) * room, np.full(pieces, LENGTHS.index(length))


def cut_texts(low: DataFrame, counts: np.ndarray) -> DataFrame:
    """(key, length, nth, at, s0, s1, id, n, chars, size, most): the pieces of each
    text (id, n, chars, size, most: the edits it allows) with its signature; one
    row with the key ``ALL`` and the length 0 where there are too few characters."""
    counted = low.sparkSession.sparkContext.broadcast(counts.astype(np.float32))
    columns = ["id", "n", "chars", "size", "most"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, most = b.column(1).to_pylist(), b.column(4).to_numpy().astype(np.int64)
            sizes = np.array([len(t) for t in texts])
            short = np.flatnonzero(sizes <= most)
            none = np.zeros(len(short), np.int64)
            found = [(short, none, none, none - 1, np.full(len(short), ALL, np.uint64))]
            usual = np.flatnonzero((sizes > most) & (sizes <= EVENLY))
            usual = usual[np.argsort(sizes[usual], kind="stable")]
            while len(usual):  # texts of like sizes together, as many as a few million numbers allow
                width, pieces = 2 * sizes[usual[0]] + 8, 2 * most[usual[0]] + 8
                few = max(1, int(4e6 / (width * pieces)))
                own = usual[:few]
                fit = (sizes[own] <= width) & (most[own] <= pieces)
                own, usual = own[fit], np.concatenate([own[~fit], usual[few:]])
                found.append(priced([texts[i] for i in own], own, sizes[own], most[own] + 1, counted.value))
            for i in np.flatnonzero((sizes > most) & (sizes > EVENLY)):
                place, kind = _even_cuts(int(sizes[i]), int(most[i]) + 1)
                found.append(keyed([texts[i]], np.array([i]), np.zeros(len(place), np.int64), np.arange(len(place)), place, kind))
            text, length, nth, at, key = (np.concatenate(x) for x in zip(*found, strict=True))
            told = [pa.array(key.view(np.int64)), *[pa.array(x, pa.int32()) for x in (length, nth, at)]]
            yield pa.RecordBatch.from_arrays([*told, *_signed(texts, text), *[c.take(pa.array(text)) for c in b.columns]], ["key", "length", "nth", "at", "s0", "s1", *columns])

    def keyed(texts: list[str], own: np.ndarray, text: np.ndarray, nth: np.ndarray, place: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
        key = np.empty(len(text), np.uint64)
        sizes = np.array([len(t) for t in texts])
        for k, length in enumerate(LENGTHS):
            pick = np.flatnonzero(kind == k)
            if len(pick):
                count = np.maximum(sizes - length + 1, 0)
                key[pick] = runs(texts, length)[2][(np.cumsum(count) - count)[text[pick]] + place[pick]]
        return own[text], np.array(LENGTHS)[kind], nth, place, key

    def priced(texts: list[str], own: np.ndarray, sizes: np.ndarray, pieces: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        costs = np.full((len(texts), len(LENGTHS), int(sizes.max())), np.inf)
        for k, length in enumerate(LENGTHS):
            text, place, key = runs(texts, length)
            costs[text, k, place] = counts[_counter(key)]
        return keyed(texts, own, *best_cuts(costs, sizes, pieces))

    kinds = f"id {low.schema['id'].dataType.simpleString()}, n string, chars int, size int, most int"
    return low.select(columns).mapInArrow(cut, f"key long, length int, nth int, at int, s0 long, s1 long, {kinds}")


def probes(low: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, at, s0, s1, id, chars, size): all runs of each text of the lengths; for 0 one row with the key ``ALL``."""
    columns = ["id", "chars", "size"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3).to_pylist()
            found = [runs(texts, length) for length in lengths if length]
            if 0 in lengths:
                found.append((np.arange(len(texts)), np.full(len(texts), -1), np.full(len(texts), ALL, np.uint64)))
            text, at, key = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(at, pa.int32()), *_signed(texts, text), *[c.take(pa.array(text)) for c in b.columns[:3]]], ["key", "at", "s0", "s1", *columns])

    return low.select(*columns, "n").mapInArrow(probe, f"key long, at int, s0 long, s1 long, id {low.schema['id'].dataType.simpleString()}, chars int, size int")


def candidates(low: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, n, size, most, b): texts (id, n, chars, size, most) that share a piece
    of the larger one (of equals, that of the smaller id) at a shift that leaves
    its edits; ``a`` is the larger one, with its own columns. Pairs with several
    such pieces come several times. A piece that many texts have is joined in
    splits of both sides. Runs are many times the texts whose size Spark knows,
    so the join says itself that it is one by shuffle."""
    pieces = written(cut_texts(low, run_counts(low)), "pieces")
    runs_of = probes(low, [r[0] for r in pieces.select("length").distinct().collect()])
    often = pieces.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > tile).select("key", F.ceil(F.col("c") / tile).alias("splits"))
    often = written(often, "often")  # a row for each ``tile`` pieces at most, so its size tells how to join it
    if often.limit(1).count():
        split = lambda df: df.join(often, "key", "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
        pieces = split(pieces).withColumn("part", F.pmod(F.xxhash64("id"), "splits")).drop("splits")
        runs_of = split(runs_of).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1))).drop("splits")
    keys = [c for c in ("key", "part") if c in pieces.columns]
    o, x = (df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys]) for df, p in ((pieces, "o"), (runs_of, "x")))
    shift = F.col("x_at") - F.col("o_at")
    longer = F.col("x_chars") - F.col("o_chars")
    larger = (F.col("o_size") > F.col("x_size")) | ((F.col("o_size") == F.col("x_size")) & (F.col("o_id") < F.col("x_id")))
    fits = (F.col("o_at") < 0) | ((F.abs(shift) <= F.col("o_nth")) & (F.abs(longer - shift) <= F.col("o_most") - F.col("o_nth")))
    differ = F.bit_count(F.col("o_s0").bitwiseXOR(F.col("x_s0"))) + F.bit_count(F.col("o_s1").bitwiseXOR(F.col("x_s1")))
    met = o.join(x.hint("merge"), keys).filter(larger & fits & (F.abs(longer) <= F.col("o_most")) & (differ <= 2 * F.col("o_most")))
    return met.select(F.col("o_id").alias("a"), F.col("o_n").alias("n"), F.col("o_size").alias("size"), F.col("o_most").alias("most"), F.col("x_id").alias("b"))


def edit_pairs(low: DataFrame, threshold: float, unit: str = "bytes", tile: int = TILE) -> DataFrame:
    """(a, b, score), a < b, of all texts (id, n; none empty) with an edit similarity of ``threshold`` or more."""
    size: Column = (F.octet_length if unit == "bytes" else F.length)("n")
    most = F.floor(size * (1 - threshold) + 1e-6).cast("int")
    # a text becomes some hundred rows, so texts are dealt over all tasks first
    spread = low.select("id", "n").repartition(int(low.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    low = written(spread.select("id", "n", F.length("n").cast("int").alias("chars"), size.cast("int").alias("size"), most.alias("most")), "texts")
    both = candidates(low, tile).join(low.select(F.col("id").alias("b"), F.col("n").alias("b_n")), "b")
    near = both.withColumn("d", F.expr("levenshtein(n, b_n, most)")).filter("d >= 0")  # -1: beyond what is allowed
    score = 1 - F.col("d") / F.col("size")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), score.alias("score")).filter(F.round("score", 9) >= threshold).distinct()
