"""Operators of workflows on small tables and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from lodewright.functions import answers, names, parsing
from lodewright.functions.text import any_contains
from lodewright.operators import classify, dedup, pipelines, quality, reports, snapshots
from lodewright.sources import catalogs
from lodewright.streaming import ingest


def test_cosine_pairs_are_those_of_all_pairs(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice(words[: r.choice((4, 40))]) for _ in range(r.randint(1, 6)))) for i in range(150)]
    items = spark.createDataFrame(rows, "id long, name string")
    vectors = dedup.tfidf(items, F.split("name", " "))
    v = {}
    for x in vectors.collect():
        v.setdefault(x.id, {})[x.word] = x.w
    norm = {i: sum(x * x for x in d.values()) ** 0.5 for i, d in v.items()}
    cosine = lambda a, b: sum(x * v[b].get(w, 0.0) for w, x in v[a].items()) / (norm[a] * norm[b])
    for threshold in (0.9, 0.5, 0.2):
        want = [(a, b) for a in v for b in v if a < b and round(cosine(a, b), 9) >= threshold]
        got = dedup.cosine_pairs(vectors, threshold, tile=9).collect()
        assert sorted((x.a, x.b) for x in got) == sorted(want) and all(abs(x.score - cosine(x.a, x.b)) < 1e-9 for x in got)


@pytest.mark.parametrize("unit", ["bytes", "chars"])
def test_fuzzy_pairs_with_errors_at_the_start(spark, unit):
    r = random.Random(4)
    texts = ["", " "]
    for _ in range(25):
        t = "".join(r.choice("абвгдabcd1") for _ in range(r.randint(3, 30)))
        texts += [t, t[1:], r.choice("яz") + t, t[1:2] + t[:1] + t[2:], "zz" + t[2:]]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    low = items.select("id", F.lower(F.trim("name")).alias("n")).filter("n <> ''")
    both = low.toDF("a", "x").crossJoin(low.toDF("b", "y")).filter("a < b")
    want = both.filter(F.round(names.similarity(F.col("x"), F.col("y"), unit), 9) >= 0.85).select("a", "b").collect()
    assert want and sorted(map(tuple, dedup.fuzzy_pairs(items, unit=unit).select("a", "b").collect())) == sorted(map(tuple, want))


def test_names_that_contain_others(spark):
    stored = ["Болт М10", "гайка", "болт", "", None, "xy"]
    batch = ["болт", "о", "М1", "", None, "нет такого"]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id long, name string")
    got = sorted(map(tuple, dedup.containing(frame(batch), frame(stored)).collect()))
    assert got == sorted((i, j) for i, a in enumerate(batch) for j, b in enumerate(stored) if a and b and a.lower() in b.lower())


def test_only_sure_rows_are_dropped(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 5)], "normalized_name string, merged_count long")
    batch = spark.createDataFrame([("A ", 0.99), ("a", 0.5), ("c", 0.99), (None, 0.99)], "normalized_name string, sure double")
    new, raised = dedup.drop_known(batch, stored, sure=F.col("sure") >= 0.95)
    assert sorted(map(str, (r[0] for r in new.collect()))) == ["None", "a", "c"] and sorted(raised.collect()) == [("a", 2), ("b", 5)]


def test_service_codes_of_rows(spark):
    rows = [("33.1", True), ("32.99.5", False), ("71.20.1", True), ("99", True), ("100.1", False), ("01.11", False), ("x", False), (None, False)]
    got = spark.createDataFrame(rows, "c string, want boolean").select("want", classify.is_service_code(F.col("c")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    told = spark.range(1).select(classify.is_service_code(F.lit("01.11"), F.lit("Услуги прочие")).alias("x")).first()
    assert told.x


def test_learned_keywords_and_context(spark):
    rows = [("bolt", "1", 0.9), ("bolt", "1", 0.85), ("bolt", "2", 0.99), ("nut", "3", 0.5)]
    got = classify.learned_keywords(spark.createDataFrame(rows, "root string, code string, confidence double")).collect()
    assert [(r.root, r.code, r.uses) for r in got] == [("bolt", "1", 3)]
    c = spark.range(1).select(answers.prompt_context(F.lit(" a  b "), F.lit("c"), F.lit("cable"), F.array(F.lit("a")), F.array(F.lit("x"))).alias("c")).first().c
    assert c.name == "a b" and abs(c.confidence - 0.9) < 1e-9


def test_own_schemas(spark):
    parsing.register_schema("Own", [parsing.Slot("a", required=True), parsing.Slot("b", default="x")])
    good, bad = parsing.extract_by_position(F.array(F.lit("1")), parsing.SCHEMAS.pop("Own"))
    r = spark.range(1).select(good.alias("g"), bad.alias("b")).first()
    assert [(x.name, x.value, x.confidence) for x in r.g] == [("a", "1", 1.0), ("b", "x", 0.8)] and r.b == []
    with pytest.raises(ValueError):
        parsing.register_schema("bad", [])


def test_related_attributes_of_articles_and_codes(spark):
    of = lambda text, pattern, kind: {(x.name, x.value, x.unit) for x in spark.createDataFrame([(text,)], "t string").select(names.related_attributes(F.col("t"), pattern, kind).alias("a")).first().a}
    assert of("wbc00z0002 панель 1200x1000 50мм", names.ARTICLE, "article_code") == {("width", "1200", ""), ("height", "1000", ""), ("thickness", "50", "мм"), ("type", "панель", "")}
    assert of("лист 10x20 2.5 мм сталь 3 белый оцинкованный", names.DIMENSION, "dimension") == {("thickness", "2.5", "мм"), ("material", "сталь", ""), ("color", "белый", ""), ("coating", "оцинкованный", "")}
    assert of("nothing", names.DIMENSION, "dimension") == set()


def test_sessions(spark):
    s = snapshots.start_session(spark.createDataFrame([(1, "A b"), (2, "c")], "id long, name string"), "id", "name")
    s = snapshots.apply_stage(snapshots.apply_stage(s, "lower", F.lower), "upper", F.upper)
    assert snapshots.revert(s, 1).count() == 4
    assert sorted(snapshots.complete_session(snapshots.revert(s, 1)).collect()) == [(1, "A b", "a b", 2, True), (2, "c", "c", 2, False)]


def test_benchmarks_come_first(spark):
    b = spark.createDataFrame([("Болт", "болт оцинк.", "крепёж", 0.9, 1), ("Болт", "болт 2", "x", 0.8, 9), ("", "y", "z", 1.0, 1)], "original_name string, normalized_name string, category string, quality double, usage int")
    items = spark.createDataFrame([(1, " болт "), (2, "гайка"), (3, None), (1, " болт ")], "id int, name string")
    got = pipelines.benchmark_first(items, b, lambda c: F.lit("rule"), F.lower).select("id", "category", "normalized_name", "by_benchmark").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "крепёж", "болт оцинк.", True)] * 2 + [(2, "rule", "гайка", False), (3, "rule", None, False)]))


def test_reports_and_merged_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "<a>"), (2, None)], "id int, name string")
    lines = [r.line for r in reports.html_report(df, ["id", "name"], "t").collect()]
    assert lines[1] == "<tr><td>1</td><td>&lt;a&gt;</td></tr>" and len(lines) == 4
    catalogs.write_report(df, str(tmp_path / "r"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2
    both = catalogs.merge([df, spark.createDataFrame([(3, "c")], "id int, code string")])
    assert sorted(map(str, both.columns)) == ["code", "id", "name"] and both.count() == 3
    df.createOrReplaceTempView("catalog_items")
    sizes = {r.name: (r.rows, r.bytes) for r in catalogs.table_sizes(spark).collect()}
    assert sizes["catalog_items"] == (2, 1000)
    spark.catalog.dropTempView("catalog_items")
    told = catalogs.mapped(spark.createDataFrame([("r2", "b"), ("r1", "a")], "ref string, title string"), "ref", "ref", "title").collect()
    assert sorted(map(tuple, told)) == [(1, "r1", "r1", "a"), (2, "r2", "r2", "b")]


def test_cache_and_table_suggestions(spark):
    cache = spark.createDataFrame([("a", 1, 10), ("b", 2, 5)], "k string, value int, expires_at int")
    hit, miss = ingest.cached(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), cache, "k", 7)
    assert [tuple(r) for r in hit.collect()] == [("a", 1)] and sorted(r.k for r in miss.collect()) == ["b", "c"]
    t = spark.createDataFrame([(1, "ok name", "")], "nr int, title string, okpd string")
    got = pipelines.table_suggestions(t, "nr", {"normalized_name": "title", "kpved_code": "okpd"}).collect()
    assert {r.field for r in got} == {"kpved_code", "processing_level"}
    score = dedup.table_master_score(F.array(F.lit("a"), F.lit("b")), F.lit("x"), F.lit(0.25))
    assert spark.range(1).select(score.alias("s"), any_contains(F.lit("abc"), ["b"]).alias("h")).first() == (2.75, True)


def test_metrics_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, name string, inn string, kpp string, attributes string")
    m = quality.counterparty_metric(none, "name", "inn", "kpp", "attributes").first()
    assert (m.total, m.uniqueness, m.uniqueness_status) == (0, 100.0, "PASS") and quality.number_issues(none, "id", "attributes").count() == 0


def test_a_table_of_another_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(250).selectExpr("id", "concat('n', id) as name")
    try:
        rows.coalesce(1).write.format("jdbc").options(url=url, dbtable="items", **driver).save()
    except Exception as e:  # the driver is not part of every Spark build
        if "ClassNotFound" not in str(e):
            raise
        pytest.skip("no embedded database")
    got = catalogs.read_jdbc(spark, url, "items", "id", 0, 249, 100, **driver)
    assert got.rdd.getNumPartitions() == 3 and got.count() == 250


def test_rows_are_numbered_in_order_without_gaps(spark):
    names = ["same"] * 40 + [None] * 5 + [f"n{i % 37}" for i in range(200)]
    rows = [(f"r{i % 11}", n) for i, n in enumerate(names)]
    told = catalogs.mapped(spark.createDataFrame(rows, "ref string, title string").repartition(7), "ref", "ref", "title")
    assert told.columns == ["id", "reference", "code", "name"]
    got = sorted(told.collect())
    assert [r.id for r in got] == list(range(1, len(rows) + 1))
    first = lambda r: (r[1] is not None, r[1] or "", r[0])
    assert [(r.reference, r.name) for r in got] == sorted(rows, key=first)
    assert catalogs.mapped(spark.createDataFrame([], "ref string, title string"), "ref", "ref", "title").count() == 0


def test_rows_of_one_code_are_linked_with_the_first(spark):
    rows = [(9, " A1", "qqq"), (3, "a1 ", "zzz"), (5, "A1", None), (4, "", "vvv"), (6, None, "VVV "), (7, "b", "")]
    pairs = dedup.detected_pairs(spark.createDataFrame(rows, "id long, code string, name string")).filter("type = 'exact'")
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(3, 5), (3, 9), (4, 6)]
