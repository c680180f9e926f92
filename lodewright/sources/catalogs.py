"""Reading catalog exports: XML items, classifier text files, tables with any column names; writing reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodewright.operators.classify import tree_level, tree_parent
from lodewright.operators.staging import numbered

ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("reference", "code", "name", "attributes_xml", "table_parts", "timestamp")])


def read_xml(spark: SparkSession, path: str, tag: str = "item", schema: T.StructType = ITEM) -> DataFrame:
    """One row per element ``tag``, without what stands outside of it (see
    ``messages`` for that); bad records keep their text in ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").schema(full).load(path)


def mapped(df: DataFrame, reference: str, code: str, name: str, ident: str | None = None) -> DataFrame:
    """(id, reference, code, name) of a table with other column names.

    Without an id column rows are numbered by name and reference, a null first.
    """
    cols = [F.col(reference).alias("reference"), F.col(code).alias("code"), F.col(name).alias("name")]
    if ident:
        return df.select(F.col(ident).cast("long").alias("id"), *cols)
    return numbered(df.select(*cols), ["name", "reference"], "id").select("id", "reference", "code", "name")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, page: int = 10_000, **options: str) -> DataFrame:
    """A table of another database, read in ranges of its numeric ``key`` from
    ``low`` to ``high`` of about ``page`` keys each, one a task."""
    parts = max(1, -(-(high - low + 1) // page))
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), fetchsize=str(min(page, 1000)), **options).load()


def read_classifier(spark: SparkSession, path: str, skip: int = 4) -> DataFrame:
    """(code, name, parent_code, level) of a tab-separated classifier text.

    The first ``skip`` lines are a heading. A line with a code starts an entry;
    other lines go on with the name of the entry above. A class (two digits)
    belongs to the section letter above it. The file is one table of some
    thousand lines, so it is read whole, as one row.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).filter(F.col("at") >= skip)
    order = Window.orderBy("at")
    starts = F.col("line").rlike(r"^([A-Z]|\d{2}(?:\.\d{1,2}){0,3})[ ]*\t")
    numbered = lines.withColumn("starts", starts).withColumn("entry", F.sum(F.col("starts").cast("int")).over(order)).filter("entry > 0")
    fields = numbered.withColumn("code", F.when(F.col("starts"), F.trim(F.substring_index("line", "\t", 1)))).withColumn("part", F.trim(F.when(F.col("starts"), F.get(F.split("line", "\t"), F.lit(1))).otherwise(F.col("line"))))
    entries = fields.filter("part <> '' or starts").groupBy("entry").agg(F.max("code").alias("code"), F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), " ")).alias("name"))
    section = F.last(F.when(F.col("code").rlike("^[A-Z]$"), F.col("code")), ignorenulls=True).over(Window.orderBy("entry"))
    return entries.withColumn("section", section).select("code", "name", tree_parent(F.col("code"), F.col("section")).alias("parent_code"), tree_level(F.col("code")).alias("level"))


def in_batches(df: DataFrame, handle: Callable[[list[Row]], None], size: int = 1000) -> int:
    """Hand rows to ``handle`` in batches, a partition at a time; the number of rows."""
    def batches(rows: Iterator[Row]) -> Iterator[list[Row]]:
        held = []
        for r in rows:
            held.append(r)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

    n = 0
    for b in batches(df.toLocalIterator(prefetchPartitions=True)):
        handle(b)
        n += len(b)
    return n


def merge(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


#: Bytes of a row, by the kind of its table, when sizes are estimated.
ROW_BYTES = {"constants": 200, "catalog_items": 500, "nomenclature_items": 500}


def table_sizes(spark: SparkSession) -> DataFrame:
    """(name, rows, bytes) of the session's tables; bytes are an estimate from the rows."""
    found = [(t.name, spark.table(t.name).count()) for t in spark.catalog.listTables()]
    return spark.createDataFrame([(n, c, c * ROW_BYTES.get(n, 300)) for n, c in found], "name string, rows long, bytes long")


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """As JSON or CSV files with a header."""
    df.write.mode("overwrite").option("header", True).format(kind).save(path)
