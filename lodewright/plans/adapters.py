"""Catalog tables over the driver's tables, for Spark and as DuckDB expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.functions import names
from lodewright.operators.staging import spread

#: Latin categories for the driver's names.
CATEGORIES = {"fasteners": ["bolt", "screw", "nut"], "rings": ["ring", "gear"], "devices": ["widget", "gadget"]}
OTHER = "other"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str, deal=spread) -> DataFrame:
    """(id, code, name, category, price): parts with sizes and stars in their names."""
    p = deal(table(spark, sf_dir, "part"))
    size = F.when(F.col("p_partkey") % 3 == 0, "mm").when(F.col("p_partkey") % 3 == 1, " kg").otherwise("x20")
    star = F.when(F.col("p_partkey") % 5 == 0, " *").otherwise("")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat("p_brand", F.lit("-"), "p_size").alias("code"),
        F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), F.lit(" "), "p_size", size, star).alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
    )


ITEMS = """items AS (SELECT p_partkey AS id, concat(p_brand, '-', p_size) AS code,
  concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), ' ', p_size, CASE p_partkey % 3 WHEN 0 THEN 'mm' WHEN 1 THEN ' kg' ELSE 'x20' END,
         CASE WHEN p_partkey % 5 = 0 THEN ' *' ELSE '' END) AS name,
  p_type AS category, p_retailprice AS price FROM part)"""


def normalized_sql(c: str) -> str:
    """The normalisation of a name as DuckDB SQL."""
    out = f"lower({c})"
    for p in names.REMOVED:
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    return f"trim(regexp_replace(trim(regexp_replace({out}, '\\s+', ' ', 'g')), '{names.TAIL}', ''), '{names.EDGES}')"


def categorized_sql(c: str) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'contains(lower({c}), {w!r})' for w in ws)} THEN {k!r}" for k, ws in CATEGORIES.items())
    return f"CASE {whens} ELSE {OTHER!r} END"


def normalized(spark: SparkSession, sf_dir: str, deal=spread) -> DataFrame:
    """``items`` plus normalized_name, group category, processing level and confidences."""
    level = F.element_at(F.array(*map(F.lit, ["basic", "enhanced", "ai_enhanced", "benchmark"])), (F.col("id") % 4 + 1).cast("int"))
    return (
        items(spark, sf_dir, deal)
        .withColumn("normalized_name", names.normalize_name(F.col("name")))
        .withColumn("group_category", names.categorize(F.col("name"), CATEGORIES, OTHER))
        .withColumn("processing_level", level)
        .withColumn("ai_confidence", F.when(F.col("id") % 4 >= 2, (F.col("id") % 101) / 100.0).otherwise(0.0))
        .withColumn("kpved_code", F.when(F.col("id") % 7 == 0, "").when(F.col("id") % 7 == 1, "4690").otherwise("46.90.10"))
        .withColumn("kpved_confidence", (F.col("id") % 97) / 97.0)
        .withColumn("ai_reasoning", F.when(F.col("id") % 3 == 0, "short").otherwise("by the keywords of its name"))
    )


NORMALIZED = f"""{ITEMS}, normalized AS (SELECT *, {normalized_sql('name')} AS normalized_name, {categorized_sql('name')} AS group_category,
  ['basic', 'enhanced', 'ai_enhanced', 'benchmark'][id % 4 + 1] AS processing_level,
  CASE WHEN id % 4 >= 2 THEN (id % 101) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS ai_confidence,
  CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN '4690' ELSE '46.90.10' END AS kpved_code,
  (id % 97) / 97.0::DOUBLE AS kpved_confidence,
  CASE WHEN id % 3 = 0 THEN 'short' ELSE 'by the keywords of its name' END AS ai_reasoning FROM items)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant rows of uploads: upload, code, name, characteristic; return flag N stands for a missing name, line status O for a missing characteristic."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("upload_id"),
        F.col("l_partkey").cast("string").alias("code"),
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("name"),
        F.nullif(F.col("l_linestatus"), F.lit("O")).alias("characteristic"),
        F.col("l_orderkey").alias("reference"),
        F.col("l_linenumber").alias("line"),
    )


LINES = """lines AS (SELECT l_suppkey AS upload_id, l_partkey::VARCHAR AS code, nullif(l_returnflag, 'N') AS name,
  nullif(l_linestatus, 'O') AS characteristic, l_orderkey AS reference, l_linenumber AS line FROM lineitem)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements: database, category, value, time, severity."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("database_id"), F.col("event_type").alias("category"), F.col("value"), F.col("ts").cast("timestamp").alias("measured_at"), severity(F.col("value")).alias("severity"))


def severity(v: Column) -> Column:
    return F.when(v >= 40, "CRITICAL").when(v >= 20, "HIGH").when(v >= 5, "MEDIUM").otherwise("LOW")


METRICS = """metrics AS (SELECT event_id AS id, user_id AS database_id, event_type AS category, value, ts AS measured_at,
  CASE WHEN value >= 40 THEN 'CRITICAL' WHEN value >= 20 THEN 'HIGH' WHEN value >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM events)"""


_NOUNS = ["болт", "винт", "гайка", "кабель", "bolt", "gear", "widget", "valve", "насос", "труба", "filter", "pump"]
_ADJECTIVES = ["красный", "синий", "red", "steel", "медный", "large", "small", "гибкий", "flat"]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, code, name): as many distinct names as parts, in fives: a name in
    Cyrillic and Latin words, one with a character lost, one with its first two
    letters swapped, one with its words in another order, and one of other
    things with the same words. A third of all names share a word."""
    k = F.col("p_partkey")
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i % len(words) + 1).cast("int"))
    rows = spread(table(spark, sf_dir, "part")).select(k.alias("id"), (k % 5).alias("v"), F.floor(k / 5).cast("long").alias("q")).withColumn("h", F.md5(F.col("q").cast("string").cast("binary")))
    rows = rows.withColumns({"noun": pick(_NOUNS, F.col("q")), "adj": pick(_ADJECTIVES, F.floor(F.col("q") / 12)), "tail": F.when(F.col("q") % 3 == 0, " опт").otherwise("")})
    rows = rows.withColumn("base", F.concat("noun", F.lit(" "), "adj", F.lit(" "), F.substring("h", 1, 12), "tail"))
    at = (F.lit(2) + F.col("q") % 5).cast("int")
    name = (
        F.when(F.col("v") == 1, F.concat(F.substring(F.col("base"), F.lit(1), at - 1), F.expr("substring(base, cast(3 + q % 5 as int))")))
        .when(F.col("v") == 2, F.concat(F.substring("base", 2, 1), F.substring("base", 1, 1), F.expr("substring(base, 3)")))
        .when(F.col("v") == 3, F.concat("adj", F.lit(" "), "noun", F.lit(" "), F.substring("h", 1, 12), "tail"))
        .when(F.col("v") == 4, F.concat("noun", F.lit(" "), "adj", F.lit(" "), F.substring("h", 13, 12), "tail"))
        .otherwise(F.col("base"))
    )
    code = F.when(F.col("id") % 11 == 0, "").when(F.col("id") % 7 == 0, F.concat(F.lit("X"), F.floor(F.col("id") / 14).cast("string"))).otherwise(F.concat(F.lit("K"), F.col("id").cast("string")))
    return rows.select("id", code.alias("code"), name.alias("name"))


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


CATALOG = f"""fives AS (SELECT p_partkey AS id, p_partkey % 5 AS v, p_partkey // 5 AS q, md5((p_partkey // 5)::VARCHAR) AS h FROM part),
  worded AS (SELECT *, {_listed(_NOUNS)}[(q % 12 + 1)::INT] AS noun, {_listed(_ADJECTIVES)}[((q // 12) % 9 + 1)::INT] AS adj, CASE WHEN q % 3 = 0 THEN ' опт' ELSE '' END AS tail FROM fives),
  based AS (SELECT *, noun || ' ' || adj || ' ' || substr(h, 1, 12) || tail AS base FROM worded),
  catalog AS (SELECT id, CASE WHEN id % 11 = 0 THEN '' WHEN id % 7 = 0 THEN 'X' || (id // 14) ELSE 'K' || id END AS code,
    CASE v WHEN 1 THEN substr(base, 1, (1 + q % 5)::INT) || substr(base, (3 + q % 5)::INT) WHEN 2 THEN substr(base, 2, 1) || substr(base, 1, 1) || substr(base, 3)
      WHEN 3 THEN adj || ' ' || noun || ' ' || substr(h, 1, 12) || tail WHEN 4 THEN noun || ' ' || adj || ' ' || substr(h, 13, 12) || tail ELSE base END AS name FROM based)"""

#: Names as they stand in Russian catalogs; each rule, category and detector meets some.
SAMPLES = [
    "Болт М10х50 оцинкованный", "Кабель ВВГнг 3х2.5 черный", "Samsung Galaxy S21 Ultra телефон", "ПАНЕЛЬ СЭНДВИЧ 100х2000 isowall", "ER-00013004 датчик давления 10 бар",
    "Молоток   слесарный 500г", "НАСОС насос циркуляционный", "Гайка гайка М8 #5", "Ноутбук Lenovo IdeaPad 3", "Услуга монтаж оборудования", "Труба стальная 57x3 мм",
    "Ключ гаечный 10мм Bosch", "АБВГ-12345 Фильтр масляный", "краска белая 2.5 л", "№ 15 Шайба пружинная", "Стол пи... деревянный", "Ремонт и обслуживание насосов",
    "молоко сыр хлеб", "Преобразователь давления MBS 3000", "фасонные элементы из стали", "Подшипник 6205-2RS", "Код: 123 лопата", "Ёлочная игрушка йод", "wbc00z0002 панель 1200x1000 белый",
]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name): parts under Russian names, some with a size or an article behind."""
    k = F.col("p_partkey")
    tail = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit(" "), (k % 50).cast("string"), F.lit("мм"))).otherwise(F.concat(F.lit(" арт. "), k.cast("string")))
    return spread(table(spark, sf_dir, "part")).select(k.alias("id"), F.concat(F.element_at(F.array(*map(F.lit, SAMPLES)), (k % len(SAMPLES) + 1).cast("int")), tail).alias("name"))


RUSSIAN = f"""samples AS (SELECT p_partkey AS id, {_listed(SAMPLES)}[(p_partkey % {len(SAMPLES)} + 1)::INT] || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' || (p_partkey % 50) || 'мм' ELSE ' арт. ' || p_partkey END AS name FROM part)"""
