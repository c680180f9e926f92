"""The pipeline's stages against brute force on a small table, and the queries' contract."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lodewright.llm import jaccard, registry
from lodewright.llm.common import ARROW_ROWS

from .helpers import ODD, documents
from .test_small import brute_components, brute_lines

SF = "/root/testdata/sf0.001"


def test_line_and_near_copy_stages(spark):
    texts = [f"footer\nown text number {i} with some more words here {i * 7}" for i in range(12)]
    texts += [" ".join(f"w{j}" for j in range(60)) + end for end in ("", " x", " y", " z")] + ["", None]
    docs = documents(spark, texts)
    lines = {r.doc_id: r for r in cp.drop_lines(spark, docs, SF).collect()}
    want = brute_lines(texts, 10)
    assert {i: r.text for i, r in lines.items()} == {i: w[2] for i, w in enumerate(want)}
    assert all(r.n_chars == len(want[i][2]) for i, r in lines.items())
    near = cp.drop_near_duplicates(spark, docs, SF)
    roots = brute_components(texts)
    assert near.columns == cp.COLUMNS
    assert sorted(r.doc_id for r in near.collect()) == [i for i, (_, root) in enumerate(roots) if root == i]
    twice = docs.unionByName(docs.filter("doc_id = 0"))
    assert sorted(r.doc_id for r in cp.drop_near_duplicates(spark, twice, SF).collect()) == sorted(r.doc_id for r in near.collect())


@pytest.mark.parametrize("ids", [2_000_000, 0])
def test_repeated_ids_of_unlike_texts(spark, monkeypatch, ids):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", ids)
    a, b, c = (" ".join(f"{x}{j}" for j in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " x"), (2, b), (2, b), (3, c), (3, c + " y"), (4, b + " z"), (5, ""), (5, None), (None, a), (6, c + " q")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, set_key string")
    got = cp.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:1]) for r in got) == [("1", "a"), ("2", "b"), ("3", "c"), ("5", ""), ("5", ""), ("None", "a")]


def test_no_unlike_text_of_a_repeated_id_is_lost(spark):
    x, y, z = (" ".join(f"{c}{j}" for j in range(60)) for c in "xyz")
    rows = [(7, x), (7, y), (7, y), (8, z), (7, x + " more"), (9, y + " more"), (9, x + " other"), (10, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for order in (docs, docs.orderBy(F.desc("text")).repartition(3)):
        got = cp.drop_near_duplicates(spark, order, SF).collect()
        assert sorted((r.doc_id, r.text or "") for r in got) == [(7, x), (7, y), (8, z), (10, ""), (10, "")]


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    rows = [(i, t, "en", f"s{i % 2}", 1) for i, t in enumerate(ODD)] + [(None, "lone text", None, None, None), (3, "a", "en", "s1", 1), (3, "a", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("copies", "n_dropped", "is_toxic", "length", "component_id"):
        docs = docs.withColumn(c, F.lit("x"))
    got = stage(spark, docs, SF)
    n = got.count()
    assert got.columns == cp.COLUMNS if name != "packing" else "sequence_id" in got.columns
    assert {"toxicity": n == len(rows), "line_dedup": n == len(rows), "near_dedup": 0 < n < len(rows), "mixing": n > 0, "packing": n >= len(rows)}[name]
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = cp.drop_toxic(spark, docs, SF)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    assert clean.columns == cp.COLUMNS and sum(t == 0 and i not in kept for i, t in labels.items()) <= 2
    sequences = cp.run(spark, SF)
    assert sequences.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0 < sequences.count()
    assert [name for name, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n != "pipeline"])
def test_queries_over_whole_tables(spark, name):
    rows = registry.QUERIES[name](spark, SF)
    source = {"op2": "pages", "op12": "embeddings", "op13": "embeddings"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{SF}/{source}.parquet").count()
    if re.match("op[123679]_|op1[023]_", name):
        assert rows.count() == n
    else:
        assert rows.count() > 0


@pytest.mark.parametrize("k", [0, 1, 2, 4])
def test_stages_pass_few_texts_at_once(spark, k):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = documents(spark, ["a text", "another one"])
    rows = spark.range(0, 9000, 1, 1)
    most = lambda: max(r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in batches), "n long").collect())
    try:
        for own, want in ((None, ARROW_ROWS), ("700", 700)):
            spark.conf.unset(key) if own is None else spark.conf.set(key, own)
            cp.STAGES[k][1](spark, docs, SF)
            assert most() == want
    finally:
        spark.conf.unset(key)
