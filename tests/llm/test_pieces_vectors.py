"""Packing by powers of two, vector codes and clusters, against plain versions."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodewright.llm import pieces, subspaces, vectors, yinyang

from .helpers import ODD, documents, prose

# ---------------------------------------------------------------- 11 packing by powers of two


def ids_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch(texts, add_special_tokens=False)]


SIGNS = ["", " a\n\n b", "don't we'll DON'T ' '' a's1²³ x_y __ <|endoftext|> b", "İstanbul ÀÉ ß ŉ Dž ǆ ª", "é é ́ a", "a\x85b a\xa0b\x1cc", "ab'sd 's'T''ll", "中文 русский текст ½¾ 12345", "x" * 3000]


def test_words_have_the_ids_of_the_library(spark):
    import public_tokenizers

    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + SIGNS
    encode = pieces.word_encoder(public_tokenizers.path("word_bpe_49k.json"))
    got = [x for i in range(0, len(texts), 50) for x in encode(texts[i : i + 50])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == ids_of(texts)


def test_remembered_words_are_bounded(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(pieces, "WORDS", 20)
    encode = pieces.word_encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = prose(60)
    got = [x for i in range(0, 60, 7) for x in encode(texts[i : i + 7])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == ids_of(texts)


def test_binary_lengths():
    for n in range(200):
        lengths = pieces.binary_lengths(n, 16)
        assert sum(lengths) == n and lengths == sorted(lengths, reverse=True) and all(x & (x - 1) == 0 and x <= 16 for x in lengths)
        assert all(lengths.count(x) == 1 for x in set(lengths) - {16})
    with pytest.raises(ValueError):
        pieces.binary_lengths(5, 12)


def test_pieces_hold_each_id_once_and_buckets_are_gapless(spark, tmp_path):
    import public_tokenizers

    docs = documents(spark, ODD + SIGNS + prose(60), "ids length start __lw_task slot")
    texts = [(t or "") for t in ODD + SIGNS + prose(60)]
    want = {i: [*x, 1] for i, x in enumerate(ids_of(texts))}
    path = public_tokenizers.path("word_bpe_49k.json")
    got = pieces.with_batches(pieces.bucketed(pieces.binary_pieces(docs.repartition(5), path, 64)), 64)
    rows = got.collect()
    whole, slots = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        whole[r.doc_id].append((r.start, ids))
        slots[r.length].append((r.slot, r.sequence_id))
        assert len(ids) == r.length and r.offset == 0 and r.doc_tokens == len(want[r.doc_id]) and r.batch == r.slot * r.length // 64
    assert {d: [x for _, ids in sorted(v) for x in ids] for d, v in whole.items()} == want
    assert all(sorted(s for s, _ in v) == list(range(len(v))) and len({i - s for s, i in v}) == 1 for v in slots.values())
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    pieces.write_sequences(got, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(rows) and back.filter("octet_length(ids) <> 4 * length").count() == 0
    twice = pieces.bucketed(pieces.binary_pieces(docs.unionByName(docs).withColumn("doc_id", F.lit(None).cast("long")), path, 64))
    assert twice.count() == 2 * len(rows) and twice.select("sequence_id").distinct().count() == 2 * len(rows)
    assert pieces.bucketed(pieces.binary_pieces(docs.limit(0), path)).collect() == []


def test_packing_query_against_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {r.doc_id: np.array([*x, 1], "<u4") for r, x in zip(docs, ids_of([r.text or "" for r in docs]), strict=True)}
    rows = pieces.op11_binary_packing(spark, "/root/testdata/sf0.001").collect()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(want[r.doc_id]) and r.length & (r.length - 1) == 0 and r.length <= 2048
    assert sum(r.length for r in rows) == sum(map(len, want.values())) and len({r.sequence_id for r in rows}) == len(rows)


# ---------------------------------------------------------------- 12 vector codes


def plain_nearest(points, entries):
    d = ((points[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
    near = np.array([min(range(len(entries)), key=lambda e, row=row: (row[e], e)) for row in d])
    return near, np.array([int(row[e]) for row, e in zip(d, near, strict=True)])


@pytest.mark.parametrize("n,spread,width", [(1, 5, 4), (17, 3, 1), (500, 3, 2), (700, 1000, 4), (300, 1, 3), (200, 1 << 26, 4)])
def test_trees_find_the_nearest_entry(n, spread, width):
    r = np.random.default_rng(n)
    points = r.integers(-spread, spread + 1, (n, width)).astype(np.int32)
    points[n // 2 :] = points[0] if n % 3 == 0 else points[n // 2 :]  # half of the rows alike
    entries = np.concatenate([points[:8], r.integers(-spread, spread + 1, (9, width)), points[:3]]).astype(np.int64)
    tree = subspaces.build(points, 4)
    assert (tree.points == points[tree.order]).all() and subspaces.edges(n, tree.levels - 1)[-1] == n
    near, apart = plain_nearest(points, entries)
    got = subspaces.nearest_entries(tree, entries)
    assert (got[0] == near).all() and (got[1] == apart).all()
    sums, counts = subspaces.entry_sums(tree, entries)
    assert (counts == np.bincount(near, minlength=len(entries))).all()
    assert all((sums[e] == points[near == e].astype(np.int64).sum(0)).all() for e in range(len(entries)))


def test_subtrees_go_whole():
    r = np.random.default_rng(1)
    points = (r.integers(0, 4, (4000, 1)) * 1000 + r.integers(-9, 10, (4000, 4))).astype(np.int32)
    whole, rest, _ = subspaces.filtered(subspaces.build(points), np.arange(4)[:, None].repeat(4, 1) * 1000)
    assert len(rest) < 200 and sum(len(nodes) for _, nodes, _ in whole) < 200


ODD_VECTORS = [None, [], [1.0], [None] * 32, [float("nan")] * 32, [float("inf")] + [0.0] * 31, [1e30] * 32, [-1e30] * 32, [0.0] * 32, [0.0] * 32, [-0.001] * 32]


def vector_rows(spark, n=120, dim=32):
    r = np.random.default_rng(5)
    rows = [(int(i), x, int(i) % 3 or None) for i, x in enumerate(ODD_VECTORS)]
    rows += [(100 + i, [float(x) for x in r.normal(0, 0.1, dim)], int(i % 4) or None) for i in range(n)]
    rows += [(200 + i, [0.25] * dim, None) for i in range(40)]  # copies
    rows += [(None, [0.5] * dim, 1), (None, [float(x) for x in r.normal(0, 0.1, dim)], 2)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def whole(rows, dim):
    most = vectors.bound(dim)
    return [(r.vec_id, r.label, [max(-most, min(most, int(np.floor(x * 256)))) for x in r.embedding]) for r in rows if r.embedding is not None and len(r.embedding) == dim and all(x is not None and np.isfinite(x) for x in r.embedding)]


def test_codes_against_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(subspaces, "BLOCK", 32)
    df = vector_rows(spark)
    rows = whole(df.collect(), 32)
    v = np.array([x for *_, x in rows], np.int64)
    first = sorted((i, x) for i, _, x in rows if i is not None)[:9]
    books = [np.array([x for _, x in first], np.int64)[:, 2 * p : 2 * p + 2] for p in range(16)]
    for _ in range(2):
        for p, book in enumerate(books):
            near, _ = plain_nearest(v[:, 2 * p : 2 * p + 2], book)
            for e in set(near):
                book[e] = [int(s) // int((near == e).sum()) for s in v[near == e, 2 * p : 2 * p + 2].astype(object).sum(0)]
    clashing = df.withColumn("v", F.lit(1)).withColumn("entries", F.lit("x")).withColumn("__lw_trees", F.lit(0))
    coded, got_books = subspaces.vector_codes(clashing, entries=9)
    assert all((a == b).all() for a, b in zip(got_books, books, strict=True))
    found = [plain_nearest(v[:, 2 * p : 2 * p + 2], b) for p, b in enumerate(books)]
    error = [int(sum(d[i] for _, d in found)) for i in range(len(v))]
    want = [(i, l, [int(n[k]) for n, _ in found], error[k]) for k, (i, l, _) in enumerate(rows)]
    got = subspaces.with_label_error(coded).collect()
    assert sorted(map(str, ((r.vec_id, r.label, r.entries, r.error) for r in got))) == sorted(map(str, want))
    by = defaultdict(int)
    for (_, l, _), e in zip(rows, error, strict=True):
        by[l] += e
    fits = {l: e if e < 1 << 63 else None for l, e in by.items()}
    assert all(r.label_error == fits[r.label] for r in got)


def test_codes_of_no_rows(spark):
    df = vector_rows(spark)
    for rows in (df.limit(0), df.filter("embedding is null"), df.withColumn("vec_id", F.lit(None).cast("long"))):
        coded, books = subspaces.vector_codes(rows)
        assert books == [] and subspaces.with_label_error(coded).collect() == []
    few = df.filter("vec_id in (100, 101, 102)")
    assert sorted(r.error for r in subspaces.vector_codes(few.unionByName(few))[0].collect()) == [0] * 6


# ---------------------------------------------------------------- 13 clusters


def test_bounds_never_change_a_cluster():
    seen = 0
    for seed, spread in ((1, 3), (2, 40), (3, 2000)):
        r = np.random.default_rng(seed)
        v = (r.integers(0, 12, (900, 1)) * spread * 4 + r.integers(-spread, spread + 1, (900, 6))).astype(np.int32)
        v[600:] = v[0]
        centroids = v[r.permutation(600)[:23]].astype(np.int64)
        centroids[5] = centroids[4]
        groups = yinyang.group_centroids(centroids, 4)
        cluster, upper, lower = np.zeros(900, np.int64), np.full(900, np.inf), np.full((900, len(groups)), -np.inf)
        old = centroids
        for _ in range(7):
            seen += yinyang.reassign(v, cluster, upper, lower, centroids, np.sqrt(((centroids - old) ** 2).sum(1)), groups)
            near, _ = plain_nearest(v, centroids)
            assert (cluster == near).all()
            old, centroids = centroids, np.stack([v[near == c].astype(np.int64).sum(0) // (near == c).sum() if (near == c).any() else centroids[c] for c in range(23)])
    assert seen < 0.5 * 3 * 7 * 900 * 23  # most distances are never computed


def test_clusters_against_plain_rounds(spark):
    import hashlib

    df = vector_rows(spark)
    rows = whole(df.collect(), 32)
    v = np.array([x for *_, x in rows], np.int64)
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, _, x in rows if i is not None)
    centroids = np.array([x for _, x in named[:12]], np.int64)
    for _ in range(3):
        near, _ = plain_nearest(v, centroids)
        centroids = np.array([[int(s) // int((near == c).sum()) for s in v[near == c].astype(object).sum(0)] if (near == c).any() else centroids[c] for c in range(12)], np.int64)
    near, apart = plain_nearest(v, centroids)
    clashing = df.withColumn("v", F.lit(1)).withColumn("cluster", F.lit("x")).withColumn("name", F.lit(0))
    clustered, got = yinyang.centroid_clusters(clashing.repartition(3), dim=32, k=12, rounds=3)
    assert (got == centroids).all()
    told = yinyang.with_inertia(clustered, got).collect()
    want = sorted(map(str, ((i, int(c), int(d)) for (i, _, _), c, d in zip(rows, near, apart, strict=True))))
    assert sorted(map(str, ((r.vec_id, r.cluster, r.distance) for r in told))) == want
    sums = {int(c): int(sum(apart[near == c].astype(object))) for c in set(near)}
    fits = lambda x: x if x < 1 << 63 else None
    assert all(r.cluster_inertia == fits(sums[r.cluster]) and r.inertia == fits(sum(sums.values())) for r in told)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest() for r in told)


def test_clusters_of_no_rows(spark):
    df = vector_rows(spark)
    for rows in (df.limit(0), df.filter("embedding is null"), df.withColumn("vec_id", F.lit(None).cast("long"))):
        assert yinyang.with_inertia(*yinyang.centroid_clusters(rows, dim=32)).collect() == []
    few = df.filter("vec_id in (100, 101)")
    assert [r.distance for r in yinyang.centroid_clusters(few, dim=32)[0].collect()] == [0, 0]
