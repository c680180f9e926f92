"""XML messages of catalog uploads: all kinds told apart in one pass over files, batches with the fields of their message.

A file (or a row) holds one message. What stands inside ``value``, an item's
attributes and its table parts is kept as XML text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The kinds of messages and their fields.
HANDSHAKE = ["database_id", "version_1c", "config_name", "config_version", "computer_name", "user_name", "timestamp", "upload_type", "iteration_number", "iteration_label", "programmer_name", "upload_purpose", "parent_upload_id"]
METADATA = ["upload_uuid", "database_id", "version_1c", "config_name", "config_version", "computer_name", "user_name", "timestamp"]
CONSTANT = ["upload_uuid", "name", "synonym", "type", "value", "timestamp"]
CATALOG_META = ["upload_uuid", "name", "synonym", "timestamp"]
CATALOG_ITEM = ["upload_uuid", "catalog_name", "reference", "code", "name", "attributes_xml", "table_parts", "timestamp"]
CATALOG_ITEMS = ["upload_uuid", "catalog_name"]
NOMENCLATURE_BATCH = ["upload_uuid", "database_id", "timestamp"]
COMPLETE = ["upload_uuid", "timestamp"]
ITEM = ["reference", "code", "name", "attributes_xml", "table_parts", "timestamp"]
NOMENCLATURE_ITEM = ["nomenclature_reference", "nomenclature_code", "nomenclature_name", "characteristic_reference", "characteristic_name", "attributes", "table_parts", "timestamp"]
KINDS = {
    "handshake": HANDSHAKE, "metadata": METADATA, "constant": CONSTANT, "catalog_meta": CATALOG_META, "catalog_item": CATALOG_ITEM,
    "catalog_items": CATALOG_ITEMS, "nomenclature_batch": NOMENCLATURE_BATCH, "complete": COMPLETE,
}


def _texts(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_ITEMS = T.StructType([T.StructField("item", T.ArrayType(T.StructType(_texts(list(dict.fromkeys(ITEM + NOMENCLATURE_ITEM))))))])
#: One schema for all kinds: a field that a message lacks is null.
MESSAGE = T.StructType([*_texts(list(dict.fromkeys(f for fields in KINDS.values() for f in fields))), T.StructField("items", _ITEMS), T.StructField("_corrupt", T.StringType())])


def kind_of(text: Column) -> Column:
    """The tag of the outermost element, behind a declaration and comments, without a prefix."""
    return F.regexp_extract(text, r"^\x{FEFF}?\s*(?:<\?(?s:.*?)\?>\s*|<!--(?s:.*?)-->\s*|<!DOCTYPE[^>\[]*>\s*)*<(?:[\w.-]+:)?([\w.-]+)", 1)


def parse_messages(df: DataFrame, column: str = "value") -> DataFrame:
    """``df`` plus kind and message (``MESSAGE``) of the XML text in ``column``.

    Kind is ``unknown`` for other tags and ``bad`` where the text is null or no
    XML; such a message is null, or holds its text in ``_corrupt``."""
    text = F.col(column)
    tag = kind_of(F.coalesce(text, F.lit("")))
    told = df.withColumn("message", F.from_xml(text, MESSAGE.simpleString(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("message").isNull() | F.col("message._corrupt").isNotNull()
    return told.withColumn("kind", F.when(broken, "bad").when(tag.isin(list(KINDS)), tag).otherwise("unknown"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, message): a row for each file, which is read whole; files are
    single messages, so their size is that of a batch. An empty file has no row."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return parse_messages(whole).drop("value").select("file", "kind", "message")


def of_kind(messages: DataFrame, kind: str) -> DataFrame:
    """The messages of a kind, a column for each of its fields; iteration numbers are whole numbers."""
    out = messages.filter(F.col("kind") == kind).select(*[F.col(f"message.{f}").alias(f) for f in KINDS[kind]])
    return out.withColumn("iteration_number", F.col("iteration_number").try_cast("int")) if kind == "handshake" else out


def _batched(messages: DataFrame, kind: str, header: list[str], fields: list[str]) -> DataFrame:
    rows = messages.filter(F.col("kind") == kind).select(*[F.col(f"message.{f}").alias(f"_{f}") for f in header], F.explode("message.items.item").alias("i"))
    return rows.select(*[F.col(f"_{f}").alias(f) for f in header if f not in fields], *[F.coalesce(f"i.{f}", f"_{f}").alias(f) if f in header else F.col(f"i.{f}").alias(f) for f in fields])


def catalog_items(messages: DataFrame) -> DataFrame:
    """Items of single messages and of batches, each with the upload and catalog of its message."""
    single = of_kind(messages, "catalog_item")
    return single.unionByName(_batched(messages, "catalog_items", CATALOG_ITEMS, ITEM)).withColumnRenamed("table_parts", "table_parts_xml")


def nomenclature_items(messages: DataFrame) -> DataFrame:
    """Items of nomenclature batches with the upload and database of their message; a time of their own comes first."""
    return _batched(messages, "nomenclature_batch", NOMENCLATURE_BATCH, NOMENCLATURE_ITEM).withColumnsRenamed({"attributes": "attributes_xml", "table_parts": "table_parts_xml"})


def upload_summary(messages: DataFrame) -> DataFrame:
    """(upload_uuid, constants, catalogs, items, complete): what an upload's messages hold."""
    uploads = [
        of_kind(messages, "metadata").select("upload_uuid", F.lit("none").alias("what")),
        of_kind(messages, "constant").select("upload_uuid", F.lit("constant").alias("what")),
        of_kind(messages, "catalog_meta").select("upload_uuid", F.lit("catalog").alias("what")),
        catalog_items(messages).select("upload_uuid", F.lit("item").alias("what")),
        nomenclature_items(messages).select("upload_uuid", F.lit("item").alias("what")),
        of_kind(messages, "complete").select("upload_uuid", F.lit("complete").alias("what")),
    ]
    told = uploads[0]
    for u in uploads[1:]:
        told = told.unionByName(u)
    n = lambda what: F.count(F.when(F.col("what") == what, 1))
    return told.groupBy("upload_uuid").agg(n("constant").alias("constants"), n("catalog").alias("catalogs"), n("item").alias("items"), (n("complete") > 0).alias("complete"))
