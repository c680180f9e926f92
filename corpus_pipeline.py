"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; ``run`` writes each as Parquet in the shared folder and
rereads it for the next. All but the last return the columns of ``documents``.
Stages of Python set ``small_batches`` for the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.llm import jaccard, linededup, mixing, packing, toxicity
from lodewright.llm.common import new_path, small_batches, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go.

    The decision is by text alone, so repeated rows go or stay together and a
    probability at the threshold counts as toxic; null ids play no part, a null
    or empty text has no words and stays unless the chain's bias alone says
    otherwise. Columns beyond those of ``documents`` are left out, whatever
    their names. An empty table gives no rows.
    """
    small_batches(spark)
    return toxicity.toxic_scores(spark, docs.select(COLUMNS), sf_dir).filter("not is_toxic").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; ``n_chars`` follows the text.

    Every document stays, one whose lines all go with an empty text. A null text
    becomes empty; repeated rows count as documents of their own, null ids play
    no part, and a line in exactly ten documents goes. Other columns are left
    out. An empty table gives no rows.
    """
    small_batches(spark)
    kept = linededup.drop_frequent_lines(docs.select(COLUMNS))
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays.

    Rows are told apart by id and component: of a component's rows with its
    smallest id the one with the smallest text stays, and where an id stands for
    unlike texts each is judged by its own component. Rows without an id, and
    those without words, stay. Other columns are left out. An empty table gives
    no rows.
    """
    small_batches(spark)
    docs = docs.select(COLUMNS)
    found = jaccard.jaccard_components(docs.select("doc_id", "text"), count_links=False, with_key=True)
    found = staged(found.select("doc_id", "component_id", "set_key", "component").filter("doc_id is not null"), "near-copies")
    often = staged(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    gone = found.filter("component_id <> doc_id").select("doc_id")
    kept = docs.join(few(gone.union(often).distinct()), "doc_id", "left_anti").select(COLUMNS)
    if not often.limit(1).count():
        return kept
    mine = jaccard.with_set_keys(docs.join(few(often), "doc_id", "left_semi").select(COLUMNS))
    told = found.join(few(often), "doc_id", "left_semi").filter("set_key is not null").distinct()
    first = mine.join(few(told), ["doc_id", "set_key"]).filter("component_id = doc_id")
    first = first.groupBy("doc_id", "component").agg(F.min(F.struct(COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return kept.unionByName(first.select(COLUMNS)).unionByName(mine.filter("set_key is null").select(COLUMNS))


def few(ids: DataFrame) -> DataFrame:
    """Ids that a task can hold are broadcast, so that texts stay where they are; more are joined by a shuffle."""
    return F.broadcast(ids) if ids.limit(jaccard.BROADCAST_IDS + 1).count() <= jaccard.BROADCAST_IDS else ids


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents so that sources reach their target weights, in a global shuffle.

    A document may have no copy. A null source is a source; rows of null id draw
    each for itself, repeated rows of one id draw alike; null and empty texts
    count like others. Other columns are left out. An empty table gives no rows.
    """
    return mixing.mix_sources(docs.select(COLUMNS)).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: a row per piece of a document.

    Null ids and repeated rows are pieces of their own; a null or empty text is
    its end mark alone. Other columns are not read. An empty table gives no rows.
    """
    import public_tokenizers

    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Stages need trained models and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
