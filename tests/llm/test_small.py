"""The operators on odd rows and against brute force."""

import base64
import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodewright.llm import common, exactdup, hilbert, jaccard, linededup, mixing, packing, secrets, shingles, tiff, toxicity, warc

from .helpers import ODD, documents, prose


# ---------------------------------------------------------------- 1 sharding


def test_curve_is_a_walk_over_all_cells():
    for dims, bits in ((2, 3), (3, 2)):
        at = {hilbert.curve_index(p, bits): p for p in np.ndindex(*[1 << bits] * dims)}
        assert sorted(at) == list(range(1 << dims * bits))
        assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(len(at) - 1))


def test_shards_differ_by_one_row_and_slots_are_gapless(spark):
    docs = documents(spark, ODD + prose(90), "shard slot __lw_x n key")
    for rows in (docs, docs.unionByName(docs), docs.limit(0), docs.withColumn("doc_id", F.lit(None).cast("long"))):
        got = hilbert.hilbert_shards(rows, 7).select("shard", "slot", "hilbert").collect()
        by = defaultdict(list)
        for r in got:
            by[r.shard].append((r.slot, r.hilbert))
        assert len(got) == rows.count()
        if got:
            sizes = [len(by[s]) for s in range(7)]
            assert max(sizes) - min(sizes) <= 1 and all(sorted(x for x, _ in v) == list(range(len(v))) for v in by.values())
            runs = [h for s in range(7) for _, h in sorted(by[s])]
            assert runs == sorted(runs)


def test_sizes_checksums_and_pruning(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in hilbert.op1_hilbert_sharding(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        assert (got[r.doc_id].size, got[r.doc_id].text_crc32, got[r.doc_id].law) == (len(raw) + 1, zlib.crc32(raw), "rows")
    hilbert.write_shards(docs.filter("n_chars is not null"), str(tmp_path / "h"), 16)
    files = spark.read.parquet(str(tmp_path / "h")).groupBy(F.input_file_name()).agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources")).toPandas()
    middle = docs.agg(F.median("n_chars")).first()[0]
    # a file of unordered rows would have all languages and most lengths
    assert len(files) == 16 and ((files.lo <= middle) & (files.hi >= middle)).mean() < 0.5 and files.langs.mean() < docs.select("lang").distinct().count()


def test_cells_are_those_of_an_independent_walk(spark):
    docs = spark.range(64).selectExpr("id as doc_id", "id % 8 as x", "id div 8 as y")
    got = {(r.x, r.y): r.hilbert for r in hilbert.hilbert_shards(docs, 4, ("x", "y"), 3).collect()}

    def walk(n, x, y):  # the textbook recursion over quadrants
        d, s = 0, n // 2
        while s:
            rx, ry = int(x & s > 0), int(y & s > 0)
            d += s * s * ((3 * rx) ^ ry)
            if not ry:
                if rx:
                    x, y = n - 1 - x, n - 1 - y
                x, y = y, x
            s //= 2
        return d

    same = [got[x, y] == walk(8, x, y) for x in range(8) for y in range(8)]
    turned = [got[x, y] == walk(8, y, x) for x in range(8) for y in range(8)]
    assert all(same) or all(turned)


# ---------------------------------------------------------------- 2 archives


def test_archives_round_trip(spark, tmp_path):
    rows = [(0, "u0", "aa"), (1, None, "bb"), (2, "u\r\n2", "aa"), (3, "u3", None), (4, "u4", ""), (5, "u5", "é" * 50_000), (None, "u6", "aa"), (7, "u7", "aa")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit(1))
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w"), with_payload=True).collect()
    assert all(r.kind == "record" for r in got) and len(got) == 8
    first = {"aa": 0, "bb": 1, "": 3, "é" * 50_000: 5}
    for i, _, html in rows:
        r = next(r for r in got if r.page_id == i)
        raw = (html or "").encode()
        keep = first[html or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if i == keep else ("revisit", keep))
        assert i != keep or bytes(r.payload) == raw
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_salvage_loses_only_what_is_damaged():
    r = random.Random(1)

    def record(i):
        body = r.randbytes(40 + 37 * i)
        return warc.make_record(i, f"http://x/{i}", body, warc.base32(hashlib.sha1(body).digest()), None)

    records = [record(i) for i in range(12)]
    members = [warc.member(x) for x in records]
    ids = lambda raw: [int(re.search(r"page:(\d+)", x[3][0]["warc-record-id"])[1]) for x in warc.salvage(raw) if x[0] == "record"]
    gaps = lambda raw: [x[1:3] for x in warc.salvage(raw) if x[0] == "gap"]
    whole = b"".join(members)
    assert ids(whole) == list(range(12)) and gaps(whole) == []
    for bad in (0, 5, 11):
        start = len(b"".join(members[:bad]))
        raw = bytearray(whole)
        raw[start + len(members[bad]) // 2] ^= 0x55
        assert ids(bytes(raw)) == [i for i in range(12) if i != bad] and gaps(bytes(raw)) == [(start, len(members[bad]))]
    cut = whole[: -len(members[11]) // 2]
    assert ids(cut) == list(range(11)) and len(gaps(cut)) == 1
    plain = records[0] + b"noise WARC/1.1\r\nX" + records[1] + members[2]
    assert ids(plain) == [0, 1, 2] and gaps(plain) == [(len(records[0]), 17)]
    assert list(warc.salvage(b"")) == [] and gaps(b"\x1f\x8b\x08") == [(0, 3)]


def test_large_members_end_in_zero():
    raw = random.Random(2).randbytes((16 << 20) + 5)
    assert warc.member(raw)[-1] == 0 and warc._inflate(warc.member(raw), 0)[::2] == (raw, None)


def test_damaged_members_of_several_records():
    r = random.Random(14)
    bodies = [r.randbytes(300) for _ in range(9)]
    records = [warc.make_record(i, f"u{i}", x, warc.base32(hashlib.sha1(x).digest()), None) for i, x in enumerate(bodies)]
    ids = lambda raw: [int(m[1]) for x in warc.salvage(raw) if x[0] == "record" and (m := re.search(r"page:(\d+)", x[3][0].get("warc-record-id", "")))]
    gaps = lambda raw: [x[1:] for x in warc.salvage(raw) if x[0] == "gap"]
    bad = records[1][:-40] + b"#" * 36 + records[1][-4:]
    sound = warc.member(records[0] + bad + records[2]) + warc.member(records[3])
    assert ids(sound) == [0, 2, 3] and len(gaps(sound)) == 1 and "of the content" in gaps(sound)[0][2]
    whole = warc.member(b"".join(records))
    cut = whole[: len(whole) * 2 // 3]
    assert ids(cut) == list(range(len(ids(cut)))) and 4 <= len(ids(cut)) <= 6 and gaps(cut)[-1][:2] == (0, len(cut))
    crc = bytearray(whole)
    crc[-6] ^= 1
    assert ids(bytes(crc) + warc.member(records[0])) == [*range(9), 0]
    flipped = bytearray(whole)
    flipped[len(whole) // 2] ^= 0xFF
    assert ids(bytes(flipped) + warc.member(records[8]))[:3] == [0, 1, 2] and ids(bytes(flipped) + warc.member(records[8]))[-1] == 8
    assert [x[3][2] is None for x in warc.salvage(bytes(flipped) + warc.member(records[8])) if x[0] == "record"][-1:] == [True] != [x[3][2] is None for x in warc.salvage(bytes(flipped)) if x[0] == "record"][-1:]
    hostile = (b"\x1f\x8b\x08" + b"\0" * 7) * 20_000
    assert ids(hostile + warc.member(records[5])) == [5]


def test_archives_of_bounded_size_with_junk(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", random.Random(i).randbytes(400).hex()) for i in range(200)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), file_bytes=5_000, junk_every=7)
    files = [f.stat().st_size for f in (tmp_path / "w").rglob("part-*")]
    assert len(files) > 10 and max(files) < 7_000
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted(r.page_id for r in got if r.kind == "record") == list(range(200))
    assert {r.page_id for r in got if r.kind == "record" and r.gap_before == warc.JUNK} == set(range(0, 200, 7))
    assert all(r.length == warc.JUNK for r in got if r.kind == "gap") and sum(r.kind == "gap" for r in got) == 29


# ---------------------------------------------------------------- 3 lines


def brute_lines(texts, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    count = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("limit, keys, probes", [(1 << 30, 1000, 9), (1 << 30, 2, 9), (0, 2, 1000), (0, 10, 3)])
def test_lines_dropped_as_by_counting(spark, limit, keys, probes, monkeypatch):
    monkeypatch.setattr(linededup, "BUCKET_DOCS", 20)
    r = random.Random(4)
    common_lines = ["Terms apply", " terms APPLY\t", "footer é", "É", "é", "one two", "x", ""]
    texts = ODD + ["\n".join(r.choice(common_lines + [f"own {i} {j}"]) for j in range(r.randint(0, 6))) for i in range(60)]
    got = linededup.drop_frequent_lines(documents(spark, texts, "n_lines key docs bucket print"), 5, limit=limit, shard_keys=keys, probes_a_task=probes)
    rows = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got.collect()}
    assert [rows[i] for i in range(len(texts))] == brute_lines(texts, 5)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "docs", "bucket", "print", "n_lines", "n_dropped"]


def test_lines_of_an_empty_table(spark):
    assert linededup.drop_frequent_lines(documents(spark, ["a"]).limit(0)).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    keys = np.unique(keys)
    keys = np.concatenate((keys, keys[:5]))  # equal first halves, other second ones
    prints = np.arange(len(keys)).astype(np.uint64)
    mph, _ = linededup.PerfectHash.load(linededup.PerfectHash.of(keys, prints).dump())
    assert sorted(mph.index(keys, prints)) == list(range(len(keys)))
    for least, top in ((10, 255), (1000, 65535), (70_000, 1 << 32)):
        blob = linededup.Shard.of(keys, prints, np.arange(len(keys)), least).dump()
        shard = linededup.Shard.load(blob)
        assert (shard.count(keys, prints) == np.minimum(np.arange(len(keys)), top)).all()
        assert shard.count(keys + np.uint64(1), prints).sum() == 0 and len(blob) < (11 if least == 70_000 else 9) * len(keys)


# ---------------------------------------------------------------- 4 secrets


@pytest.fixture(scope="module")
def language(spark):
    return secrets.learn_language(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


@pytest.fixture(scope="module")
def forest(spark, language):
    return secrets.train_forest(secrets.labelled_findings(spark, 4200), language)


def lower_words(text):
    """Runs of lower-case letters of any script."""
    return "".join(c if unicodedata.category(c) == "Ll" else " " for c in text).split()


def test_longest_words_of_a_dictionary():
    r = random.Random(4)
    words = tuple(sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 6))) for _ in range(300)}))
    shared, plain = re.compile(secrets.longest_word(words)), re.compile("|".join(sorted(words, key=lambda w: (-len(w), w))))
    for _ in range(300):
        t = "".join(r.choice("abé_") for _ in range(40))
        assert shared.sub("", t) == plain.sub("", t)
    assert secrets.longest_word(("one",)) == "one" and re.fullmatch(secrets.longest_word(("a", "ab")), "ab")


def test_language_is_that_of_counting(spark, language):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    seen = Counter(w for t in texts for w in set(lower_words(t)) if 3 <= len(w) <= 20)
    best = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: secrets.WORDS]
    assert language == secrets.Language.of(best)
    assert secrets.learn_language(documents(spark, ["a"]).limit(0)).pairs["ab"] == 0.0


def test_forest_on_held_out_findings(spark, forest, language):
    held = secrets.labelled_findings(spark, 9000).withColumn("n", F.monotonically_increasing_id()).filter("n >= 6000")
    score = sum(forest[1:], forest[0]) / len(forest)
    got = secrets.features(held, language).select("label", (score >= 0.5).cast("int").alias("said")).collect()
    assert np.mean([r.label == r.said for r in got]) > 0.97


def test_expressions_are_the_model(spark, language):
    model = secrets.fit_model(secrets.labelled_findings(spark, 2100), language, trees=4)
    trees = secrets.as_expressions(model)
    held = secrets.feature_vectors(secrets.labelled_findings(spark, 3000), language)
    rows = model.transform(held.select("*", (sum(trees[1:], trees[0]) / 4).alias("mine"))).select("mine", "probability").collect()
    assert max(abs(r.mine - r.probability[1]) for r in rows) < 1e-9 and len({round(r.mine, 3) for r in rows}) > 5


def test_features_over_whole_candidates(spark, language):
    long = "a" * 300 + "bcd0"
    row = secrets.features(spark.createDataFrame([("p", "", long, ""), ("p", "", "zq", ""), ("p", "", "q", "")], "path string, before string, candidate string, after string"), language).collect()
    assert row[0].distinct == 5 / len(secrets.ALPHABET) and row[1].distinct == 1.0
    pair = lambda t: np.mean([language.pairs.get(x + y, -2.0) for x, y in zip(t, t[1:], strict=False)])
    assert abs(row[0].transitions - pair(long)) < 1e-9 and abs(row[1].transitions - pair("zq")) < 1e-9 and row[2].transitions == 0.0


def planted(n):
    """Texts with one secret or one false alarm each, by another rule than the training data."""
    r = random.Random(16)
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    some = lambda k, of=alnum: "".join(r.choice(of) for _ in range(k))
    text = lambda: " ".join(r.choice("lake moon tower bread salt copper wind paper road green under never always small".split()) for _ in range(30))
    good = [
        lambda: f"DB_PASSWORD={some(18)}", lambda: f'apiKey: "{some(32, "0123456789abcdef")}"', lambda: f"access_token = {some(40)}", lambda: f"secret: '{some(28)}'",
        lambda: f"Authorization token={some(36)}", lambda: f"AKIA{some(16, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')}", lambda: f"ghp_{some(36)}", lambda: f'"client_secret":"{some(24)}"',
    ]
    bad = [
        lambda: f"commit {some(40, '0123456789abcdef')}", lambda: f"sha256 {some(64, '0123456789abcdef')}", lambda: f"call +1-{some(3, '0123456789')}-{some(3, '0123456789')}-{some(4, '0123456789')}",
        lambda: "password = changeme123", lambda: "https://www.lake.com/moon/tower2.html", lambda: f"card {some(16, '0123456789')}", lambda: "api_key: your_api_key_here", lambda: "docs/bread/salt_copper_v12.json",
    ]
    kinds = [*((f, 1) for f in good), *((f, 0) for f in bad)]
    return [(f"{text()} {kinds[i % len(kinds)][0]()} {text()}", kinds[i % len(kinds)][1], i % len(kinds)) for i in range(n)]


def test_planted_secrets_are_found_and_false_alarms_left(spark, forest, language):
    rows = planted(960)
    got = secrets.scan_secrets(documents(spark, [t for t, *_ in rows]), forest, language).filter("secret").select("doc_id").distinct().collect()
    found = {r.doc_id for r in got}
    share = lambda kind: np.mean([i in found for i, (*_, k) in enumerate(rows) if k == kind])
    shares = {k: share(k) for k in range(16)}
    assert all(shares[k] >= 0.8 for k in range(8)) and np.mean([shares[k] for k in range(8)]) >= 0.9, shares
    assert all(shares[k] <= 0.2 for k in range(8, 16)) and np.mean([shares[k] for k in range(8, 16)]) <= 0.1, shares


def test_secrets_in_odd_tables(spark, forest, language):
    rows = [(None, 'token = "Zk3vQ9xTn7Lw2RbY8mHd5JcF1sGp6AqE"', None), (3, None, "x"), (3, "", "x"), (4, "x1" * 100_000, None)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, source string").withColumn("candidate", F.lit("q"))
    got = secrets.scan_secrets(docs, forest, language).collect()
    assert sorted((str(r.doc_id), len(r.candidate), r.secret) for r in got) == [("4", 200_000, False), ("None", 32, True), ("None", 32, True)]
    assert secrets.scan_secrets(docs.limit(0), forest, language).count() == 0


def test_secret_scan_runs_no_python(spark, forest, language):
    plan = secrets.scan_secrets(documents(spark, ["a"]), forest, language)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- 5 mixing


def brute_copies(doc, rate, seed=17):
    u = int(hashlib.md5(f"{seed}:{doc}:1".encode()).hexdigest()[:13], 16) / (1 << 52)
    total, term, k = 0.0, math.exp(-rate), 0
    while True:
        total += term
        if u < total or k > 200:
            return k
        k += 1
        term *= rate / k


def test_copies_are_inverted_poisson_numbers(spark):
    docs = documents(spark, ODD + prose(200), "rate copies cdf u")
    for weights in (None, {"s0": 3.0, "s1": 1.0}):
        got = mixing.mix_sources(docs, weights).collect()
        n = Counter(f"s{i % 4}" for i in range(docs.count()))
        w = {s: math.sqrt(n[s]) for s in n} if weights is None else weights
        want = {}
        for i in range(docs.count()):
            s = f"s{i % 4}"
            want[i] = brute_copies(i, round(w.get(s, 0.0) * sum(n.values()) / sum(w.values()) / n[s], 9))
        have = Counter(r.doc_id for r in got)
        assert {i: have[i] for i in want} == want
        assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)
        assert all(sorted(r.copy for r in got if r.doc_id == i) == list(range(k)) for i, k in list(want.items())[:20])


def test_rows_of_null_id_draw_each_for_itself(spark):
    rows = spark.range(4000).selectExpr("cast(null as bigint) as doc_id", "'same' as text", "'s' as source")
    got = mixing.mix_sources(rows.unionByName(spark.createDataFrame([(7, "t", "s")] * 3, rows.schema)), epochs=1.0)
    sizes = got.filter("doc_id is null").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert abs(sizes.sum() - 4000) < 6 * math.sqrt(4000) and len(sizes) == 8 and sizes.max() < 2 * sizes.mean()
    assert len(Counter(r.n for r in got.filter("doc_id = 7").groupBy("copy").agg(F.count("*").alias("n")).collect())) <= 1


def test_many_sources_as_few(spark):
    docs = documents(spark, prose(300)).withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").when(F.col("doc_id") > 30, F.col("source")))
    many = mixing.mix_sources(docs, most=0)
    assert sorted(map(tuple, many.collect()), key=str) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)


def test_high_rates_and_empty_tables(spark):
    docs = documents(spark, ["a", "b", "c", "d"])
    got = Counter(r.doc_id for r in mixing.mix_sources(docs, {"s0": 1.0}, epochs=500.0).select("doc_id").collect())
    assert set(got) == {0} and abs(got[0] - 2000) < 6 * math.sqrt(2000)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs.withColumn("source", F.lit(None).cast("string")).unionByName(docs)).filter("copies < 1").count() == 0


# ---------------------------------------------------------------- 6 media


def test_codecs_round_trip():
    r = random.Random(5)
    for n in (0, 1, 2, 129, 600, 5000, 30_000):
        for raw in (r.randbytes(n), bytes(r.choice(b"ab") for _ in range(n)), b"x" * n):
            assert tiff.packbits_decode(tiff.packbits_encode(raw)) == raw and tiff.lzw_decode(tiff.lzw_encode(raw)) == raw


@pytest.mark.parametrize("code", tiff.ENCODERS)
@pytest.mark.parametrize("order", "<>")
def test_pages_round_trip(code, order):
    g = np.random.default_rng(6)
    images = [g.integers(0, 256, s).astype(np.uint8) for s in ((1, 1), (200, 64), (130, 70))]
    for predictor in (1, 2):
        got = list(tiff.read_pages(tiff.write_tiff(images, code, predictor, [False, True, True], order)))
        assert [(p.page, p.height, p.width, p.tiled, p.data) for p in got] == [(i, *im.shape, i > 0, im.tobytes()) for i, im in enumerate(images)]


def test_texts_as_media(spark):
    texts = ODD + ["é" * 40_000]
    files = tiff.encode_texts(documents(spark, texts, "page data error")).withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    got = {r.doc_id: r for r in tiff.payload_features(tiff.decode_pages(files)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        counts = [payload.count(bytes((k,))) for k in range(256)]
        entropy = -sum(c / len(payload) * math.log2(c / len(payload)) for c in counts if c)
        parts = dict(x.split("=") for x in got[i].feature.split(";"))
        assert (int(parts["pages"]), int(parts["rows"]), int(parts["zeros"]), int(parts["levels"])) == (-(-len(payload) // 65536), len(payload) // 64, counts[0], sum(c > 0 for c in counts))
        assert abs(float(parts["entropy"]) - entropy) < 1e-4 and abs(float(parts["mean"]) - sum(k * c for k, c in enumerate(counts)) / len(payload)) < 1e-4
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[7].media_sha256 == got[8].media_sha256 and got[7].feature == got[8].feature
    used = {(r.compression, r.tiled) for r in tiff.decode_pages(files).collect()}
    assert used >= {(c, False) for c in tiff.CODES} and any(t for _, t in used)
    odd = spark.createDataFrame([(None, "é" * 70_000), (3, None), (3, "q" * 200_000), (3, "q" * 200_000)], "doc_id long, text string")
    twice = tiff.encode_texts(odd).withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    assert sorted((str(r.doc_id), r.n_bytes) for r in tiff.payload_features(tiff.decode_pages(twice)).collect()) == [("3", 0), ("3", 200_000), ("3", 200_000), ("None", 140_000)]
    assert tiff.payload_features(tiff.decode_pages(files.limit(0))).count() == 0


def test_broken_files_are_told(spark):
    good = tiff.store_payload(b"a" * 128)
    looped = bytearray(good)
    rows = [(0, good), (1, None), (2, b"II*\0"), (3, good[:40]), (4, bytes(looped[:4]) + b"\xff\xff\xff\xff" + bytes(looped[8:]))]
    got = tiff.decode_pages(spark.createDataFrame(rows, "id int, media binary")).collect()
    assert [(r.id, r.error is None) for r in got] == [(0, True), (1, False), (2, False), (3, False), (4, False)]


# ---------------------------------------------------------------- 7 exact


@pytest.mark.parametrize("limit, keys", [(1 << 30, 1000), (1 << 30, 3), (0, 3)])
def test_exact_groups_are_those_of_a_dictionary(spark, limit, keys):
    texts = ODD + [f"copy {i % 7} " for i in range(60)] + ["copy  1 "]
    docs = documents(spark, texts, "digest old n keep_id group_size copy")
    got = exactdup.exact_dedup(docs, F.pmod("doc_id", F.lit(2)) == 0, limit=limit, shard_keys=keys).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for r in got:
        same = [i for i, t in enumerate(norm) if t == norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (same[0], len(same), r.doc_id == same[0], hashlib.sha256(norm[r.doc_id].encode()).hexdigest())
    assert len(got) == len(texts)


def test_texts_of_one_digest_are_compared(spark):
    texts = [f"{k} same" for k in "abcab"] + ["zz"] + ["x" * 9, "x" * 8 + "y"] * 2 + [None, ""]
    docs = documents(spark, texts)
    got = exactdup.exact_dedup(docs.unionByName(docs.filter("doc_id = 0")), F.col("doc_id") % 2 == 0, digest=lambda norm: F.substring(norm, -4, 4)).collect()
    norm = [t or "" for t in texts]
    for r in got:
        same = [i for i, t in enumerate(norm) if t == norm[r.doc_id]]
        assert (r.keep_id, r.group_size) == (same[0], len(same) + (0 in same))
    assert len(got) == len(texts) + 1 and sum(r.kept for r in got) == len(set(norm))


def test_a_snapshot_serves_several_batches(spark, tmp_path, monkeypatch):
    rows = lambda ids: spark.createDataFrame([(f"{i % 50:064x}", 3, i, 1) for i in ids], "digest string, size long, keep_id long, group_size long")
    exactdup.write_snapshot(rows(range(40)), str(tmp_path / "s"), 7)
    for most in (exactdup.BROADCAST_KEYS, 0):
        monkeypatch.setattr(exactdup, "BROADCAST_KEYS", most)
        for ids in (range(35, 45), range(95, 100), []):
            snapshot = exactdup.read_snapshot(spark, str(tmp_path / "s"))
            seen, fresh = exactdup.dedup_batch(rows(ids), snapshot)
            assert sorted(r.keep_id for r in seen.collect()) == [i % 50 for i in ids if i % 50 < 40] and all(r.group_size == 2 for r in seen.collect())
            assert sorted(r.keep_id for r in fresh.collect()) == [i for i in ids if i % 50 >= 40]


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c")]
    got = exactdup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 1).collect()
    kept = Counter((r.doc_id, r.keep_id, r.group_size) for r in got if r.kept)
    assert len(got) == 6 and kept == {(1, 1, 3): 1, (None, None, 2): 1, (2, 2, 1): 1}
    assert exactdup.exact_dedup(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).count() == 0


def test_filters_never_miss_and_seldom_err():
    g = np.random.default_rng(7)
    for n in (1, 2, 3, 100, 20_000):
        keys = np.unique(g.integers(0, 1 << 63, n).astype(np.uint64))
        blob = exactdup.build_filter(keys)
        assert exactdup.probe_filter(blob, keys).all()
        assert exactdup.probe_filter(blob, g.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.012
        assert n < 20_000 or len(blob) < 1.4 * n


# ---------------------------------------------------------------- 8 packing


def test_packing_of_odd_rows_and_its_bins(spark):
    import public_tokenizers as P

    rows = [(None, "a b"), (None, "a b"), (1, None), (1, None), (2, "word " * 1500)]
    docs = spark.createDataFrame(rows * 9, "doc_id long, text string").withColumn("sequence_id", F.lit("x"))
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")).collect()
    assert len(got) == 9 * 6 and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    real = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")).agg(F.countDistinct("sequence_id"), F.sum("length")).first()
    assert real[0] <= 1.01 * -(-real[1] // 1024)  # the least possible number of bins, and one percent


def test_both_tokenizers_agree_on_all_documents(spark):
    import public_tokenizers as P

    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    quick, slow = packing.encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")), packing.encoder(P.path("byte_bpe_50k.json"))
    assert all(np.array_equal(a, b) for a, b in zip(quick(texts), slow(texts), strict=True))


def test_plan_fills_bins():
    r = random.Random(8)
    for trial in range(60):
        cap = r.choice((10, 64, 1024))
        counts = Counter(r.randint(1, cap) for _ in range(r.choice((1, 30, 3000))))
        runs, bins = packing.plan_packing(dict(counts), cap)
        used, large, placed = Counter(), Counter(), Counter()
        where = defaultdict(list)
        for run in runs:
            for k in range(run.hi - run.lo):
                b, at = run.first + k // run.per, run.offset + k % run.per * run.size
                where[b].append((at, run.size))
                large[b] += 3 * run.size > cap
                placed[run.size] += 1
        assert placed == counts and max(where) + 1 == bins == len(where) and max(large.values()) <= 2
        for items in where.values():
            at = 0
            for start, size in sorted(items):
                assert start == at
                at += size
            assert at <= cap
        total = sum(s * n for s, n in counts.items())
        # never worse than the bound for matched large items, or 11/9 of the least for best fit
        assert bins <= max(11 / 9 * max(-(-total // cap), sum(n for s, n in counts.items() if 2 * s > cap)) + 1, sum(n for s, n in counts.items() if 3 * s > cap))


def test_pieces_are_those_of_the_tokenizer(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    texts = [t if len(t or "") < 1000 else "ab c é " * 3000 for t in ODD] + ["a <|endoftext|> b", "日本語 テキスト", "don't 123 x", "\u0085᠎", "word " * 1023, "word " * 2047]
    got = packing.pack_documents(documents(spark, texts, "piece length start"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), with_ids=True).collect()
    reference = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    seqs = defaultdict(list)
    for i, t in enumerate(texts):
        ids = np.array(reference.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in pieces) == ids.tobytes() and [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == 1024 for r in pieces[1:]) and pieces[0].length <= 1024
        for r in pieces:
            assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.start == sum(p.length for p in pieces[: r.piece])
            seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        assert [o for o, _ in sorted(s)] == list(np.cumsum([0] + [n for _, n in sorted(s)])[:-1]) and sum(n for _, n in s) <= 1024
    assert packing.pack_documents(documents(spark, ["a"]).limit(0), P.path("byte_bpe_50k.json")).count() == 0


# ---------------------------------------------------------------- 9 near copies


def brute_components(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    at = list(range(len(texts)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                at[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def test_components_are_those_of_all_pairs(spark):
    base = " ".join(f"w{i}" for i in range(120))
    r = random.Random(9)
    family = []
    for _ in range(90):  # near copies of one text, of which a part only are near each other
        w = base.split(" ")
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"z{r.randrange(10_000)}"
        family.append(" ".join(w))
    texts = ODD + ["A b c", "a B c", "a b c d", "a b c d"] + prose(150) + family
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, texts, "k n token links")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_trees_lose_no_pair():
    r = random.Random(10)
    sets = []
    for _ in range(120):
        s = set(r.sample(range(3000), r.randint(5, 90))) if r.random() < 0.4 or not sets else {x for x in r.choice(sets) if r.random() > 0.06} | {r.randrange(3000)}
        sets.append(s)
    arrays = [np.sort(shingles.mix(np.array(sorted(s), np.uint64))) for s in sets]
    members = [jaccard._member(i, len(a), i, int(a[0]), jaccard.bitmap(a, jaccard.width_of(len(a)))) for i, a in enumerate(arrays)]
    found = {(min(x.key, y.key), max(x.key, y.key)) for x, y in jaccard.block_pairs(members)}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert want and want <= found and len(found) < len(sets) * (len(sets) - 1) // 4


def test_near_copies_of_odd_tables(spark):
    none = documents(spark, ["a"]).limit(0)
    assert jaccard.jaccard_components(none).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None), (5, "q")]
    got = sorted(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (None, 0, None), (5, 1, 5)], key=str)


def test_links_are_all_linked_sets(spark, monkeypatch):
    r = random.Random(12)
    texts = prose(60, 21)
    for size, changes in ((3, 1), (90, 2), (40, 6)):
        words = [f"w{r.randrange(10**6)}" for _ in range(120)]
        for _ in range(size):
            w = list(words)
            for _ in range(r.randint(0, changes)):
                w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
            texts.append(" ".join(w[r.randint(0, 4) :]))
    texts += texts[-5:] + ["", None]
    sets = [frozenset(s.tolist()) for s in shingles.shingle_sets(pa.array(texts))]
    distinct = {s for s in sets if s}
    want = {s: sum(s is not t and 100 * len(s & t) >= 80 * len(s | t) for t in distinct) for s in distinct}
    assert max(want.values()) > 50
    for chunk in (jaccard.CHUNK_SHINGLES, 4096):
        monkeypatch.setattr(jaccard, "CHUNK_SHINGLES", chunk)
        got = {x.doc_id: x.links for x in jaccard.jaccard_components(documents(spark, texts)).select("doc_id", "links").collect()}
        assert [got[i] for i in range(len(texts))] == [want.get(s, 0) for s in sets]


def test_hot_blocks_and_both_sides_of_each_bound(spark, monkeypatch):
    r = random.Random(15)
    words = [f"w{i}" for i in range(60)]
    texts = prose(80, 31)
    for i in range(2500):  # a family whose members share nearly all shingles, in rings that only some links join
        w = list(words)
        for j in range(i % 3):
            w[(i * 7 + 13 * j) % 60] = f"y{i % 40}"
        texts.append(" ".join(w) + f" e{i}")
    docs = documents(spark, texts)
    sets = [frozenset(s.tolist()) for s in shingles.shingle_sets(pa.array(texts))]
    names = sorted({s for s in sets if s}, key=sorted)
    at = {s: i for i, s in enumerate(names)}
    tokens = {t: i for i, t in enumerate({t for s in names for t in s})}
    grid = np.zeros((len(names), len(tokens)), np.float32)
    for i, s in enumerate(names):
        grid[i, [tokens[t] for t in s]] = 1
    n = grid.sum(1)
    linked = 180 * (grid @ grid.T) >= 80 * (n[:, None] + n[None, :])
    degree = linked.sum(1) - 1
    label = np.arange(len(names))
    for _ in range(len(names)):
        low = np.where(linked, label[None, :], len(names)).min(1)
        if (low == label).all():
            break
        label = low
    root = {}
    for i, s in enumerate(sets):
        if s:
            root.setdefault(label[at[s]], i)
    want = [(len(s), root[label[at[s]]] if s else i, int(degree[at[s]]) if s else 0) for i, s in enumerate(sets)]
    assert max(w[2] for w in want) > 500
    for piece, ids, most, least in ((512, 2_000_000, 4_000_000, 64), (40, 0, 0, 64), (100, 2_000_000, 4_000_000, 1 << 30)):
        monkeypatch.setattr(jaccard, "PIECE", piece)
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", ids)
        monkeypatch.setattr(jaccard, "MOST_FREQUENT", most)
        monkeypatch.setattr(jaccard, "FREQUENT", least)
        got = {x.doc_id: (x.n_shingles, x.component_id, x.links) for x in jaccard.jaccard_components(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_shared_shingles_by_either_way(monkeypatch):
    r = random.Random(13)
    sets = [np.array(sorted(r.sample(range(400), r.randint(1, 200))), np.uint64) for _ in range(150)]
    want = [[len(np.intersect1d(a, b)) for b in sets[60:]] for a in sets[:60]]
    for few in (-1, 700, 1 << 30):
        monkeypatch.setattr(jaccard, "FEW_PAIRS", few)
        assert jaccard.shared(sets[:60], sets[60:]).tolist() == want


# ---------------------------------------------------------------- 10 toxicity


def test_chain_on_held_out_documents(spark):
    r = random.Random(11)
    bad = ["vile", "scumly", "rotten"]
    texts, labels = [], []
    for i in range(600):
        w = prose(1, i, 40)[0].split(" ")
        toxic = i % 6 == 0
        if toxic:
            w += [r.choice(bad) + r.choice(["", "ish", "er"]), r.choice(bad)]
        r.shuffle(w)
        texts.append(" ".join(w))
        labels.append((i, 0 if i % 5 == 0 else 1, int(toxic)))
    docs = documents(spark, texts, "p_toxic is_toxic")
    told = spark.createDataFrame(labels[:400] + [(None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train_chain(docs, told, toxicity.label_categories())
    got = {r.doc_id: r.is_toxic for r in toxicity.score(docs, chain).collect()}
    assert all(got[i] == bool(t) for i, _, t in labels[400:])
    assert chain.categories == ["low_quality", "toxic"] and chain.held_out.shape[1] == 2
    # one id in half of all rows, with another text too: the sample keeps one row of each id
    often = docs.unionByName(docs.filter("doc_id = 3").withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(400)))).drop("_"))
    again = toxicity.train_chain(often.unionByName(docs.filter("doc_id = 3").withColumn("text", F.concat("text", F.lit(" ~")))), told, toxicity.label_categories())
    assert again.features == chain.features and (again.held_out == chain.held_out).all()


def test_chain_without_labels_or_texts(spark):
    docs = documents(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train_chain(docs, none, toxicity.label_categories())
    assert toxicity.score(docs, chain).filter("is_toxic").count() == 0
    assert toxicity.score(docs.limit(0), chain).count() == 0


# ---------------------------------------------------------------- shared


def test_positions_split_hot_classes(spark):
    rows = spark.range(5000).withColumn("c", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("int"))
    got, counts = common.positions(rows, "c", [F.col("id")], "at", least=16)
    found = got.select("c", "at").orderBy("at").collect()
    assert [r["at"] for r in found] == list(range(5000)) and [r.c for r in found] == sorted(r.c for r in found) and sum(counts.values()) == 5000
