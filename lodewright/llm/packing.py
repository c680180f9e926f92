"""Best-fit packing of tokenised documents into sequences, large items first.

Piece lengths are whole numbers up to the capacity, so the packing problem is
its histogram: one count per length. It is solved on the counts alone, in runs
of equal bins, on the driver; the plan has a few thousand runs whatever the
number of documents. Each piece then finds its bin from its gapless position
among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P, positions, table

CAPACITY = 1024
#: Follows every document.
END = 2
#: Texts of these characters alone are split alike by both libraries; others go to the reference one.
PLAIN = r"[\x00-\x1b\x20-\x7e¡-¬®-ɏ]*"
#: Texts that a task encodes at once.
TEXTS = 64


@dataclass(frozen=True)
class Run:
    """Pieces ``lo`` to ``hi`` (by position among those of ``size``) go ``per`` to a bin, at ``offset`` and on, from bin ``first``."""

    size: int
    lo: int
    hi: int
    first: int
    per: int
    offset: int


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs for ``counts`` (pieces by length), and the number of bins.

    Lengths above a third of the capacity are matched first: at most two share
    a bin, the largest with the largest that fits beside it. Smaller ones, the
    longest first, go where they leave the smallest gap.
    """
    runs: list[Run] = []
    left = {s: n for s, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    bins = 0
    gaps: list[tuple[int, int, int]] = []  # (gap, first bin, bins), sorted

    def put(size: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append(Run(size, used[size], used[size] + n, first, per, offset))
        used[size] += n
        left[size] -= n

    def opened(gap: int, first: int, n: int) -> None:
        if gap and n:
            bisect.insort(gaps, (gap, first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        fits = bisect.bisect_right(large, capacity - a) - 1
        b = large[fits] if fits >= 0 else None
        if b == a and left[a] < 2:
            b = large[fits - 1] if fits else None
        if b is None:
            n = left[a]
            put(a, n, bins, 1, 0)
            opened(capacity - a, bins, n)
        elif b == a:
            n = left[a] // 2
            put(a, 2 * n, bins, 2, 0)
            opened(capacity - 2 * a, bins, n)
        else:
            n = min(left[a], left[b])
            put(a, n, bins, 1, 0)
            put(b, n, bins, 1, a)
            opened(capacity - a - b, bins, n)
        bins += n
        large = [s for s in large if left[s]]
    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            at = bisect.bisect_left(gaps, (s, -1, -1))
            if at == len(gaps):
                per = capacity // s
                n = max(1, left[s] // per)
                got = min(left[s], n * per)
                put(s, got, bins, per, 0)
                opened(capacity - (got // n) * s, bins, n)
                bins += n
                continue
            gap, first, n = gaps.pop(at)
            per = gap // s
            full = min(n, left[s] // per)
            if full:
                put(s, full * per, first, per, capacity - gap)
                opened(gap - per * s, first, full)
                opened(gap, first + full, n - full)
            else:
                got = left[s]
                put(s, got, first, got, capacity - gap)
                opened(gap - got * s, first, 1)
                opened(gap, first + 1, n - 1)
    return runs, bins


def encoder(vocabulary: str, ranks: str | None = None):
    """A function from texts to arrays of ids, as the library ``tokenizers`` gives them.

    With ``ranks`` (the same vocabulary for ``tiktoken``) texts of plain Latin
    characters take that library, which gives equal ids several times faster.
    """
    import base64
    import re

    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(vocabulary)
    if ranks is None:
        return lambda texts: [np.array(e.ids, np.uint32) for e in reference.encode_batch(texts, add_special_tokens=False)]
    import tiktoken

    split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {w: i for w, i in reference.get_vocab().items() if i >= len(known)}
    fast = tiktoken.Encoding("vocabulary", pat_str=split, mergeable_ranks=known, special_tokens=special)
    plain = re.compile(PLAIN)

    def encode(texts: list[str]) -> list[np.ndarray]:
        out: list = [fast.encode_to_numpy(t, allowed_special="all") if plain.fullmatch(t) else None for t in texts]
        slow = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(slow, reference.encode_batch([texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out

    return encode


def token_pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the documents' tokens
    and ``end``, cut into pieces.

    Only documents of more than ``capacity`` tokens are cut; all their pieces
    but the first are full. ``ids`` holds little-endian unsigned 32-bit ids.
    A null text is empty, so its piece is ``end`` alone. Null ids and repeated
    rows give pieces like any other; other columns of ``docs``, whatever their
    names, are not read; an empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for b in batches:
            for at in range(0, len(b), TEXTS):
                part = b.slice(at, TEXTS)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids = np.append(ids, end).astype("<u4")
                    first = len(ids) % capacity or capacity
                    for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                        raw = ids[start : first + k * capacity].tobytes()
                        rows.append((doc, k, start, len(raw) // 4, zlib.crc32(raw), raw))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 6 if with_ids else 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (long column ``length``, 1 to ``capacity``, and doc_id, piece)
    plus ``sequence_id`` and ``offset``: the place in a sequence.

    Offsets in a sequence are gapless from 0. Null ids and repeated rows are
    pieces of their own. An empty table gives no rows. ``pieces`` is evaluated
    once and written.
    """
    spark = pieces.sparkSession
    size = f"{P}size"
    placed, counts = positions(pieces.withColumn(size, F.col("length").cast("int")), size, [F.col("doc_id"), F.col("piece")], f"{P}pos")
    before, starts = 0, {}
    for s in sorted(counts):
        starts[s], before = before, before + counts[s]
    runs, _ = plan_packing(counts, capacity)
    # at most a few thousand rows: bounded by the capacity, not by the pieces
    rows = [(r.size, r.lo + starts[r.size], r.hi + starts[r.size], r.first, r.per, r.offset) for r in runs]
    lanes = spark.createDataFrame(rows or [(0, 0, 0, 0, 1, 0)], f"{size} int, {P}lo long, {P}hi long, {P}first long, {P}per long, {P}offset long")
    inside = (placed[size] == lanes[size]) & (placed[f"{P}pos"] >= lanes[f"{P}lo"]) & (placed[f"{P}pos"] < lanes[f"{P}hi"])
    rank = f"({P}pos - {P}lo)"
    found = placed.join(F.broadcast(lanes), inside).select(
        *[placed[c] for c in pieces.columns],
        F.expr(f"{P}first + {rank} div {P}per").alias("sequence_id"),
        F.expr(f"{P}offset + {rank} % {P}per * length").alias("offset"),
    )
    return found


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack; see ``token_pieces`` and ``pack``."""
    return pack(token_pieces(docs, vocabulary, ranks, capacity, end, with_ids), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 1024 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
