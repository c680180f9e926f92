"""What is kept between runs: versions, manifests, snapshots, answers, progress; and candidates before a model."""

import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodewright.functions import names
from lodewright.operators import retrieval, reports, snapshots, store
from lodewright.streaming import cache, ingest, progress

ROW = T.StructType([T.StructField("code", T.StringType()), T.StructField("name", T.StringType()), T.StructField("seq", T.LongType())])


def batch(source, number, rows):
    (source / f"{number:03d}.json").write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")


def stream(spark, tmp_path, **kwargs):
    rows = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    return ingest.upsert_stream(rows, str(tmp_path / "out"), str(tmp_path / "check"), buckets=4, **kwargs)


def test_twenty_batches_keep_few_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = {}
    for i in range(20):
        rows = [{"code": f"k{(i * 3 + j) % 17}", "name": f"n{i}.{j}", "seq": i * 10 + j} for j in range(3)]
        want |= {r["code"]: r["name"] for r in rows}
        batch(tmp_path / "in", i, rows)
    stream(spark, tmp_path, keep=2).awaitTermination()
    got = ingest.current(spark, str(tmp_path / "out"), ROW)
    assert {r.code: r.name for r in got.collect()} == want and got.count() == len(want)
    live = {f.rsplit("/", 1)[0] for f in got.inputFiles()}
    assert len(live) == 4
    kept = [p for p in (tmp_path / "out").glob("version=*/bucket=*")]
    assert len(kept) <= 8 and len(list((tmp_path / "out" / "_manifests").glob("[0-9]*.json"))) == 2
    # without cleaning, a reader still lists the live folders alone
    assert ingest.compact(spark, str(tmp_path / "out"), 1) >= 0
    assert {r.code: r.name for r in ingest.current(spark, str(tmp_path / "out"), ROW).collect()} == want


def test_a_batch_run_again_writes_the_same(spark, tmp_path):
    (tmp_path / "in").mkdir()
    target = str(tmp_path / "out")
    batch(tmp_path / "in", 0, [{"code": "a", "name": "x", "seq": 1}, {"code": "b", "name": "y", "seq": 1}])
    stream(spark, tmp_path).awaitTermination()
    batch(tmp_path / "in", 1, [{"code": "a", "name": "z", "seq": 2}])
    stream(spark, tmp_path).awaitTermination()
    assert ingest.manifest(spark, target, 1) != ingest.manifest(spark, target) and set(ingest.manifest(spark, target).values()) <= {0, 1}
    assert {(r.code, r.name) for r in ingest.current(spark, target, ROW, 1).collect()} == {("a", "x"), ("b", "y")}
    last = sorted((tmp_path / "check" / "commits").glob("[0-9]*"))[-1]
    for f in (last, last.with_name(f".{last.name}.crc")):
        f.unlink(missing_ok=True)
    stream(spark, tmp_path).awaitTermination()
    assert {(r.code, r.name) for r in ingest.current(spark, target, ROW).collect()} == {("a", "z"), ("b", "y")}
    assert ingest.current(spark, str(tmp_path / "none"), ROW).collect() == []


# ---------------------------------------------------------------- snapshots


def test_rows_are_kept_once(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("price", T.DoubleType())])
    frame = lambda rows: spark.createDataFrame(rows, schema)
    first = [(1, "a", 1.0), (2, None, 2.0), (3, "", None), (4, "d", 4.0), (4, "d", 4.0)]
    second = [(1, "a", 1.5), (2, None, 2.0), (3, "", None), (5, "e", 5.0)]
    kept = store.SnapshotStore(spark, str(tmp_path / "s"), schema)
    assert kept.create(frame(first), "one") and kept.create(frame(second), "two", "auto")
    assert not kept.create(frame(list(reversed(second))), "same", "auto") and kept.create(frame(second), "by hand")
    assert kept.create(frame(first[:4]), "fewer", "auto") and kept.create(frame([]), "none") and not kept.create(frame([]), "none again", "auto")
    again = store.SnapshotStore(spark, str(tmp_path / "s"), schema)
    text = lambda df: sorted(map(str, df.collect()))
    assert text(again.read("one")) == text(frame(first)) and text(again.read("two")) == text(again.read("by hand")) == text(frame(second))
    assert again.read("none").collect() == [] and [r.snapshot for r in again.heads().orderBy("seq").collect()] == ["one", "two", "by hand", "fewer", "none"]
    assert spark.read.parquet(str(tmp_path / "s" / "rows")).count() == 6
    assert {r.id: r.change for r in again.difference("one", "two", "id").collect()} == {1: "updated", 4: "removed", 5: "added"}
    assert again.difference("two", "by hand", "id").collect() == []
    with pytest.raises(ValueError):
        again.create(frame(first), "one")


def test_own_reference_where_the_snapshot_has_none(spark):
    rows = [(1, "Болт М10", "r1"), (2, "болт", "r2"), (3, "123", "r3"), (4, None, "r4"), (5, "гайка", "r5"), (6, "БОЛТ", "r6")]
    items = spark.createDataFrame(rows, "id int, name string, reference string")
    master = snapshots.master_names(items.filter("id < 5"), "name", "reference", names.normalize_name)
    got = {r.id: (r.normalized_name, r.normalized_reference) for r in snapshots.normalize_upload(items, master, "name", "reference", names.normalize_name).collect()}
    assert got[3] == ("123", "r3") and got[4] == (None, "r4") and got[5] == ("гайка", "r5") and got[6] == ("болт", "r2") and got[2] == ("болт", "r2")


def test_members_of_null_keys(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, "a", "x")], "id int, k string, n string")
    assert {r.id: (r.merged_count, r.first_id) for r in reports.members(df, ["k", "n"], "id").collect()} == {1: (2, 1), 2: (2, 1), 3: (1, 3)}


# ---------------------------------------------------------------- candidates


def test_candidates_are_those_of_all_entries(spark):
    import random

    r = random.Random(2)
    word = lambda: f"w{int(r.paretovariate(0.7)) % 30}"
    entries = {f"c{i:03d}": sorted({word() for _ in range(r.randint(1, 6))}) for i in range(150)}
    asked = {i: sorted({word() for _ in range(r.randint(0, 5))} | ({"nowhere"} if i % 9 == 0 else set())) for i in range(80)}
    df = {}
    for ws in entries.values():
        for w in ws:
            df[w] = df.get(w, 0) + 1
    want = {}
    for i, ws in asked.items():
        met = sorted((min((df[w], w) for w in ws if w in e), len(e), c) for c, e in entries.items() if set(ws) & set(e))
        want |= {(i, p + 1): (c, w) for p, ((_, w), _, c) in enumerate(met[:4])}
    rows = lambda d: spark.createDataFrame([(k, " ".join(v)) for k, v in d.items()], ["id", "t"])
    split = F.filter(F.split("t", " "), lambda w: w != "")
    index = retrieval.word_index(rows(entries).withColumnRenamed("id", "code"), split, k=4)
    assert index.groupBy("word").count().agg(F.max("count")).first()[0] <= 4
    got = retrieval.candidates(rows(asked), split, index, 4).collect()
    assert {(x.id, x.place): (x.key, x.word) for x in got} == want


def test_a_model_chooses_among_candidates(spark):
    titles = spark.createDataFrame([("1", "steel bolts"), ("2", "steel nuts"), ("3", "paint")], "code string, title string")
    index = retrieval.word_index(titles, F.split("title", " "))
    items = spark.createDataFrame([(1, "steel bolts long", "old"), (2, "paint", "old"), (3, "glass", "old"), (4, None, "old"), (5, "paint", "old")], "id int, name string, code string")

    def model(asked):
        return [("1" if "bolts" in name else "9", 0.9) if "3" not in keys else (keys[0], 0.8) for name, keys in asked]

    got = retrieval.classify_among(items, "name", lambda c: F.split(c, " "), index, model).collect()
    assert {r.id: (r.code, r.confidence) for r in got} == {1: ("1", 0.9), 2: ("3", 0.8), 3: (None, None), 4: (None, None), 5: ("3", 0.8)}
    known = spark.createDataFrame([("steel bolt", "bolts"), ("steel bolt", "any"), ("paint", None)], "name string, category string")
    told = {r.id: (r.similar, r.source) for r in retrieval.similar_context(items.select("id", "name"), F.split("name", " "), known, F.split("name", " ")).collect()}
    assert [tuple(x) for x in told[1][0]] == [("steel bolt", "any")] and told[1][1] == "similar" and told[2] == ([], "none") and told[4] == ([], "none")


# ---------------------------------------------------------------- streams


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_answers_live_for_a_time_and_the_oldest_goes(rocks, tmp_path):
    (tmp_path / "in").mkdir()

    def run(rows, ttl=600.0, most=3, check="check"):
        number = len(list((tmp_path / "in").iterdir()))
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(json.dumps({"name": n}) for n in rows), encoding="utf-8")
        seen = []
        asked = rocks.readStream.schema("name string").json(str(tmp_path / "in"))
        told = cache.answered(asked, lambda ns: [n.upper() for n in ns], ttl, most, buckets=1)
        told.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / check)).trigger(availableNow=True).start().awaitTermination()
        assert all(r.value == r.name.upper() for r in seen)
        return {r.name: r.hit for r in seen}

    assert run(["a", "b", "a", None]) == {"a": False, "b": False}
    assert run(["a", "c"]) == {"a": True, "c": False}
    assert run(["d"]) == {"d": False}  # a fourth answer: the oldest of a and b goes
    again = run(["a", "b", "c", "d"])
    assert again["c"] and again["d"] and sum(again.values()) == 3
    assert run(["x"], ttl=2.0, check="short")["x"] is False
    time.sleep(3)
    assert run(["x"], ttl=2.0, check="short") == {"x": False}


def test_hit_rate(spark):
    df = spark.createDataFrame([("a", "A", False), ("a", "A", True), ("b", "B", False)], cache.ANSWER)
    assert tuple(cache.hit_rate(df).first()) == (1, 2, 1 / 3, 2)
    assert tuple(cache.hit_rate(df.limit(0)).first()) == (0, 0, 0.0, 0)


def test_progress_as_a_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        batch(tmp_path / "in", i, [{"code": "a", "name": "x", "seq": i}] * (i + 1))
    table = progress.ProgressTable(spark, str(tmp_path / "progress"))
    try:
        stream(spark, tmp_path).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(50):
            if (tmp_path / "progress").exists() and table.read().filter("event = 'ended'").count():
                break
            time.sleep(0.2)
    finally:
        table.stop()
    got = table.read().collect()
    assert sorted({r.event for r in got}) == ["batch", "ended", "started"] and len({r.query for r in got}) == 1
    assert sorted(r.rows for r in got if r.event == "batch" and r.rows) == [1, 2, 3]
