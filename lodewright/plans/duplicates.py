"""Duplicate queries over thousands of distinct names; their SQL compares all pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodewright.functions import dictionaries, names
from lodewright.operators import dedup, overlap

from .adapters import CATALOG, catalog
from .base import query

# letters beyond ASCII become single bytes, as levenshtein counts bytes in SQL
_LETTERS, _BYTES = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()"


def _near(key: str, threshold: float) -> str:
    return f"""SELECT x.id AS a, y.id AS b, 1 - levenshtein(x.t, y.t) / greatest(x.n, y.n) AS score FROM {key} x JOIN {key} y ON x.id < y.id
      AND abs(strlen(x.t) - strlen(y.t)) <= {1 - threshold} * greatest(x.n, y.n) + 1e-6 WHERE round(1 - levenshtein(x.t, y.t) / greatest(x.n, y.n), 9) >= {threshold}"""


_KEYS = f"""{CATALOG}, lowered AS (SELECT id, translate(lower(name), '{_LETTERS}', '{_BYTES}') AS t, strlen(lower(name)) AS n FROM catalog),
  sounds AS (SELECT id, regexp_replace(translate(lower(name), '{dictionaries.SOUND_FROM}', '{dictionaries.SOUND_TO}'), '[^\\p{{L}}\\p{{Nd}}]', '', 'g') AS s FROM catalog),
  sounding AS (SELECT id, translate(s, '{_LETTERS}', '{_BYTES}') AS t, strlen(s) AS n FROM sounds),
  words AS (SELECT DISTINCT id, unnest(list_filter(string_split(lower(name), ' '), lambda w: strlen(w) >= 2)) AS word FROM catalog), counts AS (SELECT id, count(*) AS k FROM words GROUP BY 1)"""
_OVERLAP = """SELECT x.id AS a, y.id AS b, count(*) AS common, count(*) / (any_value(p.k) + any_value(q.k) - count(*)) AS score, count(*) / greatest(any_value(p.k), any_value(q.k)) AS longest
  FROM words x JOIN words y ON x.word = y.word AND x.id < y.id JOIN counts p ON p.id = x.id JOIN counts q ON q.id = y.id GROUP BY 1, 2"""
_COSINE = """t AS (SELECT count(*) AS n FROM catalog), f AS (SELECT word, count(*) AS df FROM words GROUP BY 1), v AS (SELECT id, word, 1 / k * ln((SELECT n FROM t) / df) AS x FROM words JOIN counts USING (id) JOIN f USING (word)),
  m AS (SELECT id, sqrt(sum(x * x)) AS norm FROM v GROUP BY 1),
  alike AS (SELECT p.id AS a, q.id AS b, sum(p.x * q.x) / any_value(g.norm * h.norm) AS score FROM v p JOIN v q ON p.word = q.word AND p.id < q.id JOIN m g ON g.id = p.id JOIN m h ON h.id = q.id GROUP BY 1, 2)"""


def _millionths(score: str) -> Column:
    """A score from 0 to 1 rounded to six decimals, without a decimal number for each of hundreds of millions of pairs."""
    return F.floor(F.col(score) * 1e6 + 0.5) / 1e6


@query(f"WITH {_KEYS} SELECT a, b, round(score, 6) AS score FROM ({_near('lowered', 0.85)})")
def fuzzy_pairs(spark, d):
    return dedup.fuzzy_pairs(catalog(spark, d)).select("a", "b", F.round("score", 6).alias("score"))


@query(f"WITH {_KEYS} SELECT a, b, round(score, 6) AS score FROM ({_near('sounding', 0.9)})")
def phonetic_pairs(spark, d):
    return dedup.phonetic_pairs(catalog(spark, d)).select("a", "b", F.round("score", 6).alias("score"))


@query(f"WITH {_KEYS} SELECT a, b, common, round(score, 6) AS score FROM ({_OVERLAP}) WHERE common >= 2")
def word_overlap_pairs(spark, d):
    pairs = dedup.word_overlap_pairs(catalog(spark, d), names.tokens(F.col("name")), 2)
    return pairs.select("a", "b", F.col("common").cast("long").alias("common"), _millionths("score").alias("score"))


@query(f"WITH {_KEYS} SELECT a, b, common, round(longest, 6) AS score FROM ({_OVERLAP}) WHERE common >= 3")
def table_word_overlap(spark, d):
    """Common words over the larger set."""
    pairs = dedup.word_overlap_pairs(catalog(spark, d), names.tokens(F.col("name")), 3, "longest")
    return pairs.select("a", "b", F.col("common").cast("long").alias("common"), _millionths("score").alias("score"))


@query(f"WITH {_KEYS}, {_COSINE} SELECT a, b, round(score, 6) AS score FROM alike WHERE round(score, 9) >= 0.85")
def tfidf_pairs(spark, d):
    return dedup.cosine_pairs(dedup.tfidf(catalog(spark, d), names.tokens(F.col("name")))).select("a", "b", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {_KEYS}, {_COSINE}, ends AS (SELECT a, b FROM alike WHERE round(score, 9) >= 0.85 UNION ALL SELECT b, a FROM alike WHERE round(score, 9) >= 0.85),
  reach(id, m) AS (SELECT a, a FROM ends UNION SELECT r.id, e.b FROM reach r JOIN ends e ON r.m = e.a), groups AS (SELECT id, min(m) AS group_id FROM reach GROUP BY 1),
  sizes AS (SELECT group_id, count(*) AS size FROM groups GROUP BY 1)
  SELECT group_id, size, round(sum(p.score) / (size * (size - 1) / 2), 6) AS score FROM sizes s JOIN groups x USING (group_id) JOIN alike p ON p.a = x.id JOIN groups y ON y.id = p.b AND y.group_id = x.group_id GROUP BY group_id, size""")
def semantic_groups(spark, d):
    """Groups by cosine, with the mean of all their pairs."""
    vectors = dedup.tfidf(catalog(spark, d), names.tokens(F.col("name")))
    groups = dedup.components(dedup.cosine_pairs(vectors)).select("group_id", "id")
    return dedup.mean_cosine(vectors, groups).withColumn("score", F.round("score", 6))


_FOUND = f"""WITH RECURSIVE {_KEYS}, {_COSINE}, found AS (
  SELECT x.id AS b, min(x.id) OVER (PARTITION BY lower(trim(code))) AS a, 'exact' AS type, 1.0::DOUBLE AS score FROM catalog x WHERE trim(code) <> ''
  UNION SELECT b, a, 'fuzzy', score FROM ({_near('lowered', 0.85)}) UNION SELECT b, a, 'phonetic', score FROM ({_near('sounding', 0.9)})
  UNION SELECT b, a, 'semantic', score FROM alike WHERE round(score, 9) >= 0.85 UNION SELECT b, a, 'words', score FROM ({_OVERLAP}) WHERE common >= 3),
  pairs AS (SELECT a, b, type, score FROM found WHERE a <> b), ends AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
  reach(id, m) AS (SELECT a, a FROM ends UNION SELECT r.id, e.b FROM reach r JOIN ends e ON r.m = e.a), groups AS (SELECT id, min(m) AS group_id FROM reach GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_KEYS}, both_of AS ({_OVERLAP}), ends AS (SELECT a, b FROM both_of WHERE common >= 3 UNION ALL SELECT b, a FROM both_of WHERE common >= 3),
  reach(id, m) AS (SELECT a, a FROM ends UNION SELECT r.id, e.b FROM reach r JOIN ends e ON r.m = e.a), groups AS (SELECT id, min(m) AS group_id FROM reach GROUP BY 1),
  inside AS (SELECT x.group_id, p.common, p.score FROM both_of p JOIN groups x ON x.id = p.a JOIN groups y ON y.id = p.b AND y.group_id = x.group_id),
  sizes AS (SELECT group_id, count(*) AS size FROM groups GROUP BY 1), alike AS (SELECT group_id, word FROM words JOIN groups USING (id) JOIN sizes USING (group_id) GROUP BY group_id, word HAVING count(*) = any_value(size))
  SELECT group_id, size, count(*) FILTER (common >= 3) AS links, round(sum(score) / (size * (size - 1) / 2), 6) AS score, coalesce((SELECT string_agg(word, ' ' ORDER BY word COLLATE "BINARY") FROM alike a WHERE a.group_id = s.group_id), '') AS common
  FROM sizes s JOIN inside USING (group_id) GROUP BY group_id, size""")
def overlap_groups(spark, d):
    """Groups by three common words, counted from subsets of words: links, mean similarity of all pairs, words that all have."""
    _, told = overlap.overlap_groups(catalog(spark, d), names.tokens(F.col("name")), 3)
    return told.select("group_id", "size", "links", F.round("score", 6).alias("score"), F.array_join("common", " ").alias("common"))


@query(f"{_FOUND} SELECT group_id, id FROM groups")
def dup_components(spark, d):
    """Groups by all detectors, merged; three common words link two names."""
    return dedup.duplicate_groups(catalog(spark, d), common_words=3)


@query(f"""{_FOUND}, links AS (SELECT group_id, CASE WHEN count(DISTINCT type) = 1 THEN min(type) ELSE 'mixed' END AS type, avg(score) AS score, avg(CASE type WHEN 'phonetic' THEN 0.8 ELSE score END) AS confidence
  FROM pairs JOIN groups ON id = a GROUP BY 1), best AS (SELECT group_id, arg_max(id, (least(length(name) / 2.0, 10.0) + CASE WHEN code <> '' THEN 0.5 ELSE 0.0 END, -id)) AS master_id, count(*) AS size FROM groups JOIN catalog USING (id) GROUP BY 1)
  SELECT group_id, type, round(score + 1e-9, 6) AS score, round(confidence + 1e-9, 6) AS confidence, size, master_id FROM links JOIN best USING (group_id)""")
def dup_groups(spark, d):
    """Kind, score, confidence, size and master of each group."""
    rows = catalog(spark, d)
    groups, links = dedup.found_groups(rows, common_words=3)
    worth = F.least(F.length("name") / 2.0, F.lit(10.0)) + F.when(F.col("code") != "", 0.5).otherwise(0.0)
    g = dedup.group_summary(links, groups, rows, worth)
    return g.select("group_id", "type", F.round(F.col("score") + 1e-9, 6).alias("score"), F.round(F.col("confidence") + 1e-9, 6).alias("confidence"), "size", "master_id")


@query(f"""WITH {CATALOG}, n AS (SELECT id, lower(name) AS name FROM catalog) SELECT x.id, y.id AS match_id FROM (SELECT id, substr(name, 3, 9) AS part FROM n WHERE id % 50 = 0) x JOIN n y ON contains(y.name, x.part)""")
def names_containing(spark, d):
    """For parts of each fiftieth name, the names that contain them."""
    rows = catalog(spark, d)
    return dedup.containing(rows.filter("id % 50 = 0").select("id", F.substring(F.lower("name"), 3, 9).alias("name")), rows)


@query(f"""WITH {CATALOG}, h AS (SELECT md5('code-[' || string_agg(id::VARCHAR, ',' ORDER BY id) || ']') AS hash, min(id) AS first, count(*) AS size FROM catalog WHERE code <> '' GROUP BY lower(trim(code)) HAVING count(*) > 1)
  SELECT hash, size, CASE WHEN first % 2 = 0 THEN 'merged' ELSE 'open' END AS status FROM h""")
def stored_groups(spark, d):
    """Groups kept under their hash: a later run adds those that are new, a third none, and some are marked."""
    rows = catalog(spark, d).filter("code <> ''")
    g = rows.groupBy(F.lower(F.trim("code")).alias("key")).agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)
    g = g.select(dedup.group_hash("code", F.col("ids")).alias("hash"), F.size("ids").cast("long").alias("size"), F.col("ids")[0].alias("first"), F.lit("open").alias("status"))
    stored = g.filter("first % 3 = 0")
    kept = stored.unionByName(dedup.new_groups(g, stored))
    kept = kept.unionByName(dedup.new_groups(g, kept))
    return dedup.mark(kept, g.filter("first % 2 = 0"), "merged").select("hash", "size", "status")
