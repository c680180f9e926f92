"""Operators against brute force and the driver's contract."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from lodewright.functions import names
from lodewright.operators import dedup, snapshots
from lodewright.plans import registry
from lodewright.sources import catalogs
from lodewright.streaming import ingest

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda p: sorted(repr(tuple(map(plain, r))) for r in p[sorted(p.columns)].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_components_are_those_of_union_find(spark):
    pairs = [(1, 2), (2, 3), (5, 9), (9, 7), (7, 5), (10, 11), (11, 12), (12, 13), (13, 14)]
    got = dict(dedup.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 7: 5, 9: 5, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10}


def test_word_overlap_is_that_of_all_pairs(spark):
    texts = ["ноутбук asus gaming", "ноутбук lenovo gaming", "мышь компьютерная", "клавиатура компьютерная", "ноутбук dell", ""]
    got = {(r.a, r.b): (r.common, r.score) for r in dedup.word_overlap_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, name string"), names.tokens(F.col("name"))).collect()}
    sets = [set(t.split()) for t in texts]
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in range(6) for b in range(a + 1, 6) if sets[a] & sets[b]}
    assert got == want


@pytest.mark.parametrize("common, keep", [(1, False), (1, True), (2, False)])
def test_groups_by_common_words(spark, common, keep):
    texts = ["hammer steel", "hammer wood", "saw для wood", "клей для обоев", "vise big red", "pump big red", "lamp", "big"]
    rows = [(i, f"c{i}", t) for i, t in enumerate(texts)]
    got = {r.id: r.group_id for r in dedup.duplicate_groups(spark.createDataFrame(rows, "id long, code string, name string"), 0.999, common, keep).collect()}
    sets = [set(t.split()) - (set() if keep else {"для"}) for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if len(sets[a] & sets[b]) >= common:
                    want[a] = want[b] = min(want[a], want[b])
    assert got == {i: g for i, g in enumerate(want) if want.count(g) > 1}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_word_overlap_of_frequent_words(spark, least):
    texts = [f"big red {'steel ' if i % 3 else ''}w{i // 2}" if i % 7 else f"u{i} big" for i in range(150)]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    got = sorted((r.a, r.b, r.common) for tile in (1000, 40) for r in dedup.word_overlap_pairs(items, names.tokens(F.col("name")), least, tile=tile).collect())
    sets = [set(t.split()) for t in texts]
    want = [(a, b, len(sets[a] & sets[b])) for a in range(150) for b in range(a + 1, 150) if len(sets[a] & sets[b]) >= least]
    assert got == sorted(want * 2)


@pytest.mark.parametrize("threshold", [0.9, 0.7])
@pytest.mark.parametrize("letters", ["abcdxyz0123456789", "клмнрстуabc", "𐐨𐐩a"])
def test_phonetic_pairs_are_those_of_all_pairs(spark, letters, threshold):
    r = random.Random(5)
    texts = ["", "", "a", "aaaaaaaaaaaa", "aaaaaaaaaaaaa"]
    for _ in range(12):
        t = "".join(r.choice(letters) for _ in range(r.randint(8, 40)))
        at = r.randrange(len(t))
        texts += [t, t[1:], r.choice(letters) + t, t[1] + t[0] + t[2:], t[:at] + t[at + 1 :], r.choice(letters) * 2 + t[1:]]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    keys = items.select("id", names.phonetic_key(F.col("name")).alias("k"))
    all_pairs = keys.toDF("a", "x").crossJoin(keys.toDF("b", "y")).filter("a < b and x <> '' and y <> ''")
    want = all_pairs.filter(F.round(names.similarity(F.col("x"), F.col("y")), 9) >= threshold).select("a", "b").collect()
    got = dedup.phonetic_pairs(items, threshold=threshold).select("a", "b").collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("measure", ["jaccard", "longest"])
def test_word_overlap_meets_hardly_more_than_it_gives(spark, monkeypatch, measure):
    rows = [(i, f"n{i % 4} a{i % 9} {'t' if i % 3 else 's'} h{i // 2}") for i in range(1440)]
    met, meet = [], dedup._meet

    def counted(*args, **named):
        out = meet(*args, **named)
        met.append(out.count())
        return out

    monkeypatch.setattr(dedup, "_meet", counted)
    got = dedup.word_overlap_pairs(spark.createDataFrame(rows, "id long, name string"), F.split("name", " "), 3, measure).collect()
    sets = {i: set(n.split()) for i, n in rows}
    want = {(i, j): len(sets[i] & sets[j]) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 3}
    assert {(x.a, x.b): x.common for x in got} == want and len(got) == len(want)
    assert all(abs(x.score - (x.common / (8 - x.common) if measure == "jaccard" else x.common / 4)) < 1e-12 for x in got)
    assert sum(met) < 1.1 * len(want)


@pytest.mark.parametrize("least", [1, 2, 5, 12])
def test_word_overlap_of_long_and_short_names(spark, least):
    r = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.sample(words[: r.choice((15, 40))], r.choice((1, 3, 8, 10, 11, 14))))) for i in range(70)] + [(100, " ".join(words[:14]) + " own"), (101, " ".join(words[:14])), (102, None), (103, "")]
    got = dedup.word_overlap_pairs(spark.createDataFrame(rows, "id long, name string"), F.split("name", " "), least, tile=7).collect()
    sets = {i: set(n.split(" ")) for i, n in rows if n is not None}
    want = {(i, j): (len(x & y), len(x & y) / len(x | y)) for i, x in sets.items() for j, y in sets.items() if i < j and len(x & y) >= least}
    assert sorted((x.a, x.b, x.common, round(x.score, 9)) for x in got) == sorted((*k, n, round(s, 9)) for k, (n, s) in want.items())


def test_upsert_and_latest(spark):
    stored = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("d", 9, 7)], "code string, v int, seq int")
    new = spark.createDataFrame([("b", 3, 0), ("b", 4, 1), ("c", 5, 2), ("c", 6, 2), ("d", 8, 6)], "code string, v int, seq int")
    assert sorted(snapshots.upsert(stored, new, ["code"]).collect()) == [("a", 1, 0), ("b", 4, 1), ("c", 6, 2), ("d", 9, 7)]
    assert sorted(snapshots.upsert(new.filter("v < 5"), stored, ["code"]).collect()) == [("a", 1, 0), ("b", 2, 1), ("d", 9, 7)]
    assert sorted(snapshots.insert_missing(stored, new.filter("v in (4, 5)"), ["code"]).collect()) == [("a", 1, 0), ("b", 2, 1), ("c", 5, 2), ("d", 9, 7)]


def test_classifier_file(spark, tmp_path):
    lines = ["h1", "h2", "h3", "h4", "A\tSection a", "01\tClass one", "  goes on", "01.1\tGroup", "01.11\tSub", "B\tSection b", "05\tClass five"]
    (tmp_path / "c.txt").write_text("\n".join(lines), encoding="utf-8")
    got = sorted(map(tuple, catalogs.read_classifier(spark, str(tmp_path / "c.txt")).select("code", "name", "parent_code", "level").collect()))
    assert got == [("01", "Class one goes on", "A", 1), ("01.1", "Group", "01", 2), ("01.11", "Sub", "01.1", 2), ("05", "Class five", "B", 1), ("A", "Section a", "", 0), ("B", "Section b", "", 0)]


def test_xml_items(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<items><item><code>1</code><name>Болт</name></item><item><code>2</code><name>Гайка</name></item></items>", encoding="utf-8")
    got = catalogs.read_xml(spark, str(tmp_path / "x.xml")).select("code", "name", "reference").collect()
    assert sorted(map(tuple, got)) == [("1", "Болт", None), ("2", "Гайка", None)]


def test_batches(spark):
    seen = []
    assert catalogs.in_batches(spark.range(25).repartition(3), lambda b: seen.append(len(b)), 10) == 25
    assert sum(seen) == 25 and max(seen) <= 10


def test_stream_upserts_versions(spark, tmp_path):
    schema = T.StructType([T.StructField("code", T.StringType()), T.StructField("name", T.StringType()), T.StructField("seq", T.LongType())])
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i, rows in enumerate(['{"code":"1","name":"Болт 10мм","seq":1}', '{"code":"1","name":"Гайка","seq":2}\n{"code":"2","name":"Кабель","seq":3}']):
        (source / f"{i}.json").write_text(rows, encoding="utf-8")
        ingest.upsert_stream(ingest.normalised_stream(spark, str(source), schema), str(target), str(tmp_path / "check")).awaitTermination()
    got = ingest.current(spark, str(target), T.StructType([*schema.fields, T.StructField("normalized_name", T.StringType()), T.StructField("category", T.StringType())])).select("code", "normalized_name").collect()
    assert sorted(map(tuple, got)) == [("1", "гайка"), ("2", "кабель")]
