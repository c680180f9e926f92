"""Packing by powers of two: documents cut into pieces of binary lengths, equal lengths in a bucket.

A document of n tokens is cut into as many pieces of the capacity as it has,
and one piece for each bit of the rest, the longest first. A piece is a
sequence, so none crosses documents and none is padded; batches take sequences
of one bucket.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import P, staged, table

CAPACITY = 2048
#: Follows every document.
END = 1
#: Texts that a task encodes at once.
TEXTS = 64
#: Words whose ids a task remembers; beyond that it starts anew.
WORDS = 400_000
#: Texts of these characters alone are cut into words here; others go to the reference library.
PLAIN = r"[\x00-\x1b\x20-\x7e¡-¬®-įıĲ-ɏ]*"
#: Words of plain lower-case texts: endings behind an apostrophe, letters, single digits, and runs of other signs.
LETTERS, DIGITS = "a-zªµºß-öø-ɏ", "0-9²³¹¼½¾"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+"

TASK, NTH = f"{P}task", f"{P}nth"


def binary_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths that are powers of two and add up to ``n``: full ones, then one for each bit of the rest, falling."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity is a power of two")
    return [capacity] * (n // capacity) + [1 << k for k in reversed(range(capacity.bit_length() - 1)) if n & 1 << k]


def word_encoder(vocabulary: str):
    """A function from texts to the little-endian 32-bit ids that the library
    ``tokenizers`` gives them, for vocabularies of words that end in ``</w>``.

    Plain Latin texts are cut into words here, each with a space for its end,
    and encoded by ``tiktoken`` with the ids as ranks: first a word's last
    letter joins its end, then pairs join in the order of their ids, as in the
    vocabulary. What stands between white space is encoded once a task, all new
    ones of a batch in a row, with line ends between them. Texts with other
    characters, or with a special token, go to the reference library.
    """
    import tiktoken
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    reference = Tokenizer.from_file(vocabulary)
    # the vocabulary shows bytes as printable characters: those of Latin-1 as they are, the rest from U+0100 on
    shown = [b for b in range(256) if chr(b) in ByteLevel.alphabet()]
    shown += [b for b in range(256) if b not in shown]
    byte = {c: b for c, b in zip(sorted(ByteLevel.alphabet()), shown, strict=True)}
    special = [t.content for t in reference.get_added_tokens_decoder().values()]
    ranks = {}
    for token, i in reference.get_vocab(with_added_tokens=False).items():
        if token not in special:
            raw = bytes(byte[c] for c in token.removesuffix("</w>"))
            ranks[raw + b" " * token.endswith("</w>")] = i
    ranks[b" "] = len(ranks) + len(special)  # never in a result: each word has letters before its end
    fast = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
    line_end = ranks[b"\n "]
    plain, word = re.compile(PLAIN), re.compile(WORD + "|\n")
    known: dict[str, bytes] = {}

    def learn(new: list[str]) -> None:
        ids = fast.encode_to_numpy("".join([w + " " for w in word.findall("\n".join(new) + "\n")])).astype("<u4")
        at = 0
        for part, until in zip(new, np.flatnonzero(ids == line_end).tolist(), strict=True):
            known[part] = ids[at:until].tobytes()
            at = until + 1

    def encode(texts: list[str]) -> list[bytes]:
        fit = [plain.fullmatch(t) is not None and not any(x in t for x in special) for t in texts]
        parts = [t.lower().split() if ok else [] for t, ok in zip(texts, fit, strict=True)]
        if len(known) > WORDS:
            known.clear()
        if new := set().union(*parts).difference(known):
            learn(list(new))
        slow = iter(reference.encode_batch([t for t, ok in zip(texts, fit, strict=True) if not ok], add_special_tokens=False))
        return [b"".join(map(known.__getitem__, p)) if ok else np.array(next(slow).ids, "<u4").tobytes() for p, ok in zip(parts, fit, strict=True)]

    return encode


def binary_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens) and two columns for ``bucketed``:
    each document's tokens and ``end``, in pieces of binary lengths.

    ``ids`` holds little-endian unsigned 32-bit ids, ``start`` counts those of
    the document before the piece. A null text is empty, so its one piece is
    ``end``. Null ids and repeated rows give pieces like any other, texts of any
    length are taken whole; other columns of ``docs``, whatever their names, are
    not read; an empty table gives no rows.
    """
    binary_lengths(0, capacity)
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = word_encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        for b in batches:
            for at in range(0, len(b), TEXTS):
                part, rows = b.slice(at, TEXTS), []
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids, start = ids + last, 0
                    n = len(ids) // 4
                    for length in binary_lengths(n, capacity):
                        rows.append((doc, start, length, ids[4 * start : 4 * (start + length)], n, task, seen[length]))
                        seen[length] += 1
                        start += length
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "start", "length", "ids", "doc_tokens", TASK, NTH]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, f"doc_id long, start long, length long, ids binary, doc_tokens long, {TASK} int, {NTH} long")


def bucketed(pieces: DataFrame) -> DataFrame:
    """``pieces`` of ``binary_pieces`` plus ``sequence_id``, ``offset`` and ``slot``.

    Each piece is a sequence at ``offset`` 0. ``slot`` is its gapless place (from
    0) among those of its length; the sequence ids of a bucket are gapless too,
    and follow those of shorter ones. The pieces are evaluated once and written;
    places come from counts by task and length, so no piece is sorted or
    shuffled by its length. Columns that the caller added stay. An empty table
    gives no rows.
    """
    told = staged(pieces, "pieces")
    counts = told.groupBy(TASK, "length").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy(TASK).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(TASK, "length", F.coalesce(before, F.lit(0)).alias(f"{P}start"))
    sizes = sorted(told.groupBy("length").count().collect())  # a row per bit of the capacity
    first = dict(zip((n for n, _ in sizes), accumulate((c for _, c in sizes), initial=0)))
    base = F.create_map(*[F.lit(x).cast("long") for pair in first.items() for x in pair])[F.col("length")] if first else F.lit(0).cast("long")
    placed = told.join(starts, [TASK, "length"]).withColumn("slot", F.col(f"{P}start") + F.col(NTH))
    own = [c for c in pieces.columns if c not in (TASK, NTH)]
    return placed.select(*own, (base + F.col("slot")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "slot")


def with_batches(sequences: DataFrame, tokens: int) -> DataFrame:
    """Sequences of ``bucketed`` plus ``batch``: inside a bucket, that of ``tokens`` tokens in which the sequence goes.

    All batches of a bucket but the last are full, where the length divides ``tokens``."""
    return sequences.withColumn("batch", F.expr(f"slot * length div {int(tokens)}"))


def write_sequences(sequences: DataFrame, path: str) -> None:
    """Files of one length each, under ``length=…``, with the columns of ``sequences``."""
    sequences.write.partitionBy("length").parquet(path)


def op11_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens, each a power of two long."""
    import public_tokenizers

    pieces = binary_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return bucketed(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
