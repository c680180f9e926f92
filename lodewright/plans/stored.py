"""Queries of messages, stored snapshots, candidates before a model, and item lists by state."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.functions import names, patterns
from lodewright.operators import reports, retrieval, snapshots, staging, store
from lodewright.sources import messages

from .adapters import CATALOG, ITEMS, NORMALIZED, catalog, items, normalized, normalized_sql, table
from .base import query


@query(f"""WITH {ITEMS} SELECT 'u' || (id // 50 % 7) AS upload_uuid, 'catalog ' || (id // 50) AS catalog_name, 'r' || id AS reference, code, name, '<price n="' || (id % 3) || '">' || category || '</price>' AS attributes_xml,
  CASE WHEN id % 2 = 0 THEN '<row>' || id || '</row>' END AS table_parts_xml FROM items""")
def message_items(spark, d):
    """Items of batch messages, fifty a message, with the upload and catalog that stand in the message."""
    i = items(spark, d)
    parts = F.when(F.col("id") % 2 == 0, F.concat(F.lit("<table_parts><row>"), "id", F.lit("</row></table_parts>"))).otherwise("")
    one = F.concat(F.lit("<item><reference>r"), "id", F.lit("</reference><code>"), "code", F.lit("</code><name>"), "name", F.lit("</name><attributes_xml><price n=\""), F.col("id") % 3, F.lit("\">"), "category", F.lit("</price></attributes_xml>"), parts, F.lit("</item>"))
    batch = F.floor(F.col("id") / 50)
    texts = i.groupBy(batch.alias("k")).agg(F.array_join(F.array_sort(F.collect_list(one)), "").alias("items"))
    value = F.concat(F.lit("<?xml version=\"1.0\"?><catalog_items><upload_uuid>u"), F.col("k") % 7, F.lit("</upload_uuid><catalog_name>catalog "), "k", F.lit("</catalog_name><items>"), "items", F.lit("</items></catalog_items>"))
    return messages.catalog_items(messages.parse_messages(texts.select(value.alias("value")))).drop("timestamp")


_WORDS = f"""{CATALOG}, words AS (SELECT DISTINCT id, unnest(list_filter(string_split(lower(name), ' '), lambda w: strlen(w) >= 2)) AS word FROM catalog)"""


@query(f"""WITH {_WORDS}, known AS (SELECT word, w.id, name, count(*) OVER (PARTITION BY word) AS df, count(*) OVER (PARTITION BY w.id) AS size FROM words w JOIN catalog c ON c.id = w.id WHERE w.id % 5 = 0),
  met AS (SELECT x.id, k.name AS key, k.df, k.word, k.size, row_number() OVER (PARTITION BY x.id, k.name ORDER BY k.df, k.word) AS n FROM words x JOIN known k ON x.word = k.word WHERE x.id % 5 <> 0)
  SELECT id, place::INT AS place, key, word FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY df, word, size, key) AS place FROM met WHERE n = 1) WHERE place <= 5""")
def similar_classified(spark, d):
    """For each name that isn't classified five that are and share its rarest words."""
    rows = catalog(spark, d)
    index = retrieval.word_index(rows.filter("id % 5 = 0"), names.tokens(F.col("name")), "name")
    return retrieval.candidates(rows.filter("id % 5 <> 0"), names.tokens(F.col("name")), index)


def _stored(spark, d):
    """A table as it was and as it is, kept as two snapshots; a third, automatic one has nothing new and isn't kept."""
    was = items(spark, d)
    now = was.filter("id % 11 <> 0").withColumn("price", F.when(F.col("id") % 7 == 0, F.col("price") + 1).otherwise(F.col("price")))
    now = now.unionByName(was.filter("id % 13 = 0").withColumn("id", -F.col("id") - 1))
    kept = store.SnapshotStore(spark, staging.new_path(spark, "snapshots"), was.schema)
    kept.create(was, "first")
    kept.create(now, "second")
    kept.create(now, "third", "auto")
    return kept


@query(f"WITH {ITEMS} SELECT *, 2 AS snapshots FROM items")
def snapshot_read_back(spark, d):
    """A stored snapshot read back after a later one was made."""
    kept = _stored(spark, d)
    return kept.read("first").withColumn("snapshots", F.lit(kept.heads().count()).cast("int"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'removed' ELSE 'updated' END AS change FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 7 = 0
  UNION ALL SELECT -p_partkey - 1, 'added' FROM part WHERE p_partkey % 13 = 0""")
def snapshot_difference(spark, d):
    """What a stored snapshot has added, removed and updated."""
    return _stored(spark, d).difference("first", "second", "id")


@query(f"""WITH {NORMALIZED}, w AS (SELECT DISTINCT normalized_name, group_category AS category, kpved_code FROM normalized WHERE kpved_confidence < 0.3),
  t AS (SELECT count(DISTINCT normalized_name || '|' || category) AS total FROM w) SELECT normalized_name, category, kpved_code, total FROM w, t ORDER BY 1, 2, 3 LIMIT 100""")
def incorrect_items(spark, d):
    """The first of the names whose code was marked wrong, and how many there are."""
    n = normalized(spark, d).withColumn("validation_status", F.when(F.col("kpved_confidence") < 0.3, "incorrect").otherwise("open")).withColumn("category", F.col("group_category"))
    return reports.incorrect(n, ["normalized_name", "category"], ["kpved_code"], 100)


@query("""SELECT o_orderkey AS id, coalesce(nullif(o_orderstatus, 'O'), 'pending') AS status FROM orders WHERE o_orderstatus = 'O' ORDER BY 1 LIMIT 50 OFFSET 10""")
def waiting_records(spark, d):
    """A page of the records that have no state yet, or wait."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("status"))
    return reports.waiting(o, "status", [F.col("id")], 10, 50)


@query(f"""WITH {ITEMS}, n AS (SELECT *, {normalized_sql('name')} AS bare FROM items), m AS (SELECT bare, arg_min('r' || id, (lower(name), 'r' || id)) AS reference FROM n WHERE bare <> '' AND id % 4 = 0 GROUP BY 1)
  SELECT n.id, CASE WHEN n.bare = '' THEN n.name ELSE n.bare END AS normalized_name, coalesce(m.reference, 'r' || n.id) AS normalized_reference FROM n LEFT JOIN m ON m.bare = CASE WHEN n.bare = '' THEN n.name ELSE n.bare END""")
def upload_references(spark, d):
    """Items under the reference of their snapshot, or their own where it has none."""
    i = items(spark, d).withColumn("reference", F.concat(F.lit("r"), "id"))
    master = snapshots.master_names(i.filter("id % 4 = 0"), "name", "reference", names.normalize_name)
    return snapshots.normalize_upload(i, master, "name", "reference", names.normalize_name).select("id", "normalized_name", "normalized_reference")


@query(f"""WITH {NORMALIZED} SELECT id, group_category AS category, normalized_name, count(*) OVER (PARTITION BY group_category, normalized_name) AS merged_count,
  min(id) OVER (PARTITION BY group_category, normalized_name) AS first_id FROM normalized""")
def normalized_members(spark, d):
    """The members of each group of category and normalised name, with its size."""
    n = normalized(spark, d).withColumn("category", F.col("group_category"))
    return reports.members(n, ["category", "normalized_name"], "id").select("id", "category", "normalized_name", "merged_count", "first_id")


def _match_counts_sql() -> str:
    kinds = [p for p in patterns.PATTERNS if p.kind in ("technical_code", "dimension", "units_of_measure", "special_chars", "numbers_in_name")]
    sum_of = " + ".join(f"len(regexp_extract_all(name, '{p.regex}'))" for p in kinds)
    return f"""WITH {ITEMS}, n AS (SELECT category, {sum_of} AS n FROM items) SELECT category, count(*) AS items, sum(n)::BIGINT AS matches, min(n)::BIGINT AS least, max(n)::BIGINT AS most,
      round(avg(n), 6) AS mean, count(*) FILTER (n = 0) AS without FROM n GROUP BY 1"""


@query(_match_counts_sql())
def pattern_extent(spark, d):
    """Fewest, most and mean matches of an item, by category."""
    kinds = [p for p in patterns.PATTERNS if p.kind in ("technical_code", "dimension", "units_of_measure", "special_chars", "numbers_in_name")]
    told = items(spark, d).select("category", F.size(patterns.detect(F.col("name"), kinds)).alias("n"))
    return reports.extent(told, "category", "n").withColumn("mean", F.round("mean", 6))


@query("""WITH m AS (SELECT user_id AS database_id, ts::DATE AS day, avg(value) FILTER (value > 5) AS old, avg(value) AS new FROM events GROUP BY ALL)
  SELECT database_id, day::VARCHAR AS day, round(CASE WHEN database_id % 3 = 0 THEN old ELSE new END, 6) AS score FROM m WHERE database_id % 3 <> 0 OR old IS NOT NULL""")
def trend_upsert_partial(spark, d):
    """As ``trend_upsert``, but the second run covers two thirds of the databases; the others keep their rows."""
    e = table(spark, d, "events").select(F.col("user_id").alias("database_id"), F.to_date("ts").alias("day"), "value")
    scores = lambda part, n: part.groupBy("database_id", "day").agg(F.avg("value").alias("score")).withColumn("seq", F.lit(n))
    both = snapshots.upsert(scores(e.filter("value > 5"), 1), scores(e.filter("database_id % 3 <> 0"), 2), ["database_id", "day"])
    return both.select("database_id", F.col("day").cast("string").alias("day"), F.round("score", 6).alias("score"))
