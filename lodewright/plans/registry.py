"""Queries of the catalog engine and their DuckDB equivalents, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.functions import answers, dictionaries, names, parsing, patterns, tokens, validators
from lodewright.functions.text import ascii_edges
from lodewright.operators import classify, dedup, quality, reports, snapshots
from lodewright.operators.staging import spread_runs

from . import cyrillic, duplicates, rules, stored, workflows  # noqa: F401  they register their queries
from .adapters import ITEMS, LINES, METRICS, NORMALIZED, RUSSIAN, items, lines, metrics, normalized, samples, table
from .base import ORACLES, QUERIES, query  # noqa: F401

# ---------------------------------------------------------------- names


@query(f"""WITH {NORMALIZED} SELECT group_category AS category, normalized_name, count(*) AS merged_count, min(id) AS first_id,
  round(avg(ai_confidence), 6) AS avg_confidence, max(ai_confidence) AS max_confidence FROM normalized GROUP BY 1, 2""")
def norm_groups(spark, d):
    """Items grouped by category and normalised name.

    Confidences are added up in the order of the file, as the SQL does: a mean that lies
    between two sixth decimals is rounded by the last bits of its sum.
    """
    n = normalized(spark, d, spread_runs).withColumn("part", F.spark_partition_id())
    parts = n.groupBy(F.col("group_category").alias("category"), "normalized_name", "part").agg(
        F.count("*").alias("n"), F.min("id").alias("id"), F.sum("ai_confidence").alias("total"), F.max("ai_confidence").alias("most")
    )
    groups = parts.groupBy("category", "normalized_name").agg(
        F.sum("n").alias("merged_count"), F.min("id").alias("first_id"), F.sort_array(F.collect_list(F.struct("part", "total"))).alias("totals"), F.max("most").alias("max_confidence")
    )
    mean = F.aggregate("totals", F.lit(0.0), lambda total, x: total + x["total"]) / F.col("merged_count")
    return groups.select("category", "normalized_name", "merged_count", "first_id", (F.round(mean * 1e6) / 1e6).alias("avg_confidence"), "max_confidence")


@query(f"WITH {NORMALIZED} SELECT id, name, normalized_name FROM normalized")
def name_normalize(spark, d):
    return normalized(spark, d).select("id", "name", "normalized_name")


@query(f"""WITH {ITEMS} SELECT id, regexp_extract(lower(name), '(\\d+)[xх](\\d+)', 1) AS width, regexp_extract(lower(name), '(\\d+)[xх](\\d+)', 2) AS height
  FROM items WHERE regexp_matches(lower(name), '\\d+[xх]\\d+')""")
def attr_dimension(spark, d):
    """Width and height of items that have a size in their name."""
    a = items(spark, d).select("id", F.filter(names.extract_attributes(F.col("name")), lambda x: x["type"] == "dimension").alias("a")).filter(F.size("a") > 0)
    of = lambda n: F.get(F.filter("a", lambda x: x["name"] == n), F.lit(0))["value"]
    return a.select("id", of("width").alias("width"), of("height").alias("height"))


@query(f"""WITH {ITEMS}, u AS (SELECT id, regexp_extract(lower(name), '(\\d+\\.?\\d*)\\s*({dictionaries.UNITS_SPACED})', 1) AS value,
  regexp_extract(lower(name), '(\\d+\\.?\\d*)\\s*({dictionaries.UNITS_SPACED})', 2) AS unit FROM items WHERE NOT regexp_matches(lower(name), '\\d+[xх]\\d+'))
  SELECT unit, CASE unit WHEN 'mm' THEN 'thickness' WHEN 'm' THEN 'thickness' WHEN 'kg' THEN 'weight' END AS meaning, count(*) AS n, sum(value::BIGINT)::BIGINT AS total FROM u WHERE unit <> '' GROUP BY ALL""")
def attr_units(spark, d):
    """Quantities in names by unit and meaning."""
    each = items(spark, d).select(F.explode(names.extract_attributes(F.col("name"))).alias("a")).filter("a.type = 'numeric_value'")
    return each.groupBy(F.col("a.unit").alias("unit"), F.col("a.name").alias("meaning")).agg(F.count("*").alias("n"), F.sum(F.col("a.value").cast("long")).alias("total"))


def _pattern_sql(kind: str) -> str:
    p = next(p for p in patterns.PATTERNS if p.kind == kind)
    return f"SELECT id, category, '{kind}' AS type, '{p.severity}' AS severity, len(regexp_extract_all(name, '{p.regex.replace("(?iu)", "(?i)")}')) AS n FROM items"


_COMPARED = [p.kind for p in patterns.PATTERNS]
_PATTERNS_SQL = f"{ITEMS}, matches AS ({' UNION ALL '.join(map(_pattern_sql, _COMPARED))})"


def _matches(spark, d):
    picked = [p for p in patterns.PATTERNS if p.kind in _COMPARED]
    return items(spark, d).select("id", "category", F.explode(patterns.detect(F.col("name"), picked)).alias("m"))


@query(f"WITH {_PATTERNS_SQL} SELECT type, severity, sum(n)::BIGINT AS matches, count(*) AS items FROM matches WHERE n > 0 GROUP BY ALL")
def pattern_summary(spark, d):
    m = _matches(spark, d)
    return m.groupBy(F.col("m.type").alias("type"), F.col("m.severity").alias("severity")).agg(F.count("*").alias("matches"), F.countDistinct("id").alias("items"))


@query(f"""WITH {_PATTERNS_SQL}, c AS (SELECT category, type, sum(n)::BIGINT AS matches FROM matches WHERE n > 0 GROUP BY ALL)
  SELECT category, type, matches, round(matches * 100.0 / sum(matches) OVER (PARTITION BY category), 6) AS percentage FROM c""")
def pattern_stats_by_category(spark, d):
    c = _matches(spark, d).groupBy("category", F.col("m.type").alias("type")).agg(F.count("*").alias("matches"))
    totals = c.groupBy("category").agg(F.sum("matches").alias("t"))
    return c.join(totals, "category").select("category", "type", "matches", F.round(F.col("matches") * 100.0 / F.col("t"), 6).alias("percentage"))


@query(f"""WITH {ITEMS} SELECT id, trim(regexp_replace(regexp_replace(name, '\\b\\d+[xхXХ]\\d+([xхXХ]\\d+)?\\b', '', 'g'), '[!@#$%^&*_=+<>?/\\\\|~`]', ' ', 'g')) AS once,
  trim(regexp_replace(trim(regexp_replace(regexp_replace(name, '\\b\\d+[xхXХ]\\d+([xхXХ]\\d+)?\\b', '', 'g'), '[!@#$%^&*_=+<>?/\\\\|~`]', ' ', 'g')), '\\s+', ' ', 'g')) AS fixed FROM items""")
def pattern_fixes(spark, d):
    """Names after the fixes for sizes and special characters."""
    picked = [p for p in patterns.PATTERNS if p.kind in ("dimension", "special_chars")]
    size, special = (ascii_edges(p.regex) for p in picked)
    return items(spark, d).select("id", F.trim(F.regexp_replace(F.regexp_replace("name", size, ""), special, " ")).alias("once"), patterns.apply_fixes(F.col("name"), picked).alias("fixed"))


@query(f"""WITH {NORMALIZED}, w AS (SELECT id, unnest(string_split(trim(regexp_replace(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS token FROM normalized)
  SELECT token, count(*) AS n, count(DISTINCT id) AS items FROM w WHERE strlen(token) >= 2 GROUP BY token""")
def name_tokens(spark, d):
    each = items(spark, d).select("id", F.explode(names.tokens(F.col("name"))).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("id").alias("items"))


@query(f"""WITH {ITEMS} SELECT id, md5(concat('exact-', '[', id, ']')) AS hash, sha256(name) AS cache_key,
  replace(replace(replace(replace(replace(concat(name, ' <"&''>'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '\'\'', '&apos;') AS xml FROM items""")
def name_hashes(spark, d):
    escaped = answers.xml_escaped(F.concat("name", F.lit(" <\"&'>")))
    return items(spark, d).select("id", dedup.group_hash("exact", F.array("id")).alias("hash"), F.sha2("name", 256).alias("cache_key"), escaped.alias("xml"))


@query("""SELECT n_nationkey AS id, concat(trim(regexp_replace(regexp_replace(translate(lower(n_name), ' -', '__'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_'), '_items') AS table_name FROM nation""")
def translit_name(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), names.table_name(F.col("n_name")).alias("table_name"))


@query(f"WITH {ITEMS} SELECT id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS sound FROM items")
def phonetic_keys(spark, d):
    return items(spark, d).select("id", names.phonetic_key(F.col("name")).alias("sound"))


@query("""WITH n AS (SELECT c_custkey AS id, lpad((c_custkey * 7919 + 1000000007)::VARCHAR, 10, '0') AS inn FROM customer),
  s AS (SELECT id, inn, list_sum(list_transform([2,4,10,3,5,9,4,6,8], lambda w, i: w * inn[i]::INT)) % 11 % 10 AS digit FROM n)
  SELECT id, inn, digit = inn[10]::INT AS valid, false AS valid_kpp FROM s""")
def inn_checksum(spark, d):
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lpad((F.col("c_custkey") * 7919 + 1000000007).cast("string"), 10, "0").alias("inn"))
    return n.select("id", "inn", validators.valid_inn(F.col("inn")).alias("valid"), validators.valid_kpp(F.col("inn")).alias("valid_kpp"))


@query("""WITH a AS (SELECT c_custkey AS id, concat('name ', c_name, ' INN: ', lpad((c_custkey + 1000000000)::VARCHAR, 10, '0'), ' kpp 123456', lpad((c_custkey % 1000)::VARCHAR, 3, '0')) AS t FROM customer)
  SELECT id, regexp_extract(t, '(?i)(?:инн|inn)[\\s:]*(\\d{10,12})', 1) AS inn, regexp_extract(t, '(?i)(?:кпп|kpp)[\\s:]*(\\d{9})', 1) AS kpp FROM a""")
def inn_extract(spark, d):
    c = F.col("c_custkey")
    t = F.concat(F.lit("name "), "c_name", F.lit(" INN: "), F.lpad((c + 1000000000).cast("string"), 10, "0"), F.lit(" kpp 123456"), F.lpad((c % 1000).cast("string"), 3, "0"))
    return table(spark, d, "customer").select(c.alias("id"), validators.extract_inn(t).alias("inn"), validators.extract_kpp(t).alias("kpp"))


@query(f"""WITH {ITEMS} SELECT id, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS main_text, concat_ws('|', category, 'x, y') AS inside, 1 AS max_depth,
  len(regexp_extract_all(name || ' (' || category, '\\S+')) + len(regexp_extract_all(name || ' (' || category, '\\s')) + 7 AS tokens FROM items""")
def name_parse(spark, d):
    """Bracket-aware tokens of names: main text, bracketed parts, structure."""
    t = items(spark, d).select("id", tokens.tokenize(F.concat("name", F.lit(" ("), "category", F.lit(", \"x, y\")"))).alias("t"))
    told = t.select("id", tokens.main_text(F.col("t")).alias("main_text"), F.array_join(tokens.bracketed(F.col("t")), "|").alias("inside"), tokens.structure(F.col("t")).alias("s"))
    return told.select("id", "main_text", "inside", "s.max_depth", F.col("s.tokens").cast("long").alias("tokens"))


@query(f"""WITH {ITEMS}, p AS (SELECT id, code, name, category FROM items) SELECT id, unnest([code || ' (a,b)', name, category || ' "c;d"']) AS part, unnest([0, 1, 2]) AS at FROM p""")
def split_names(spark, d):
    """Names cut at two separators, but not inside brackets or quotes."""
    t = items(spark, d).select("id", tokens.tokenize(F.concat("code", F.lit(" (a,b), ,"), "name", F.lit(";"), "category", F.lit(" \"c;d\""))).alias("t"))
    parts = F.filter(tokens.split_at(F.col("t"), ",", ";"), lambda p: p != "")
    return t.select("id", F.posexplode(F.transform(parts, F.trim)).alias("at", "part"))


_FOUND_AT = ("dimension", "units_of_measure", "special_chars", "numbers_in_name", "brand")


def _positions_sql() -> str:
    """Starts of matches from the lengths of what stands between them and of the matches before."""
    one = []
    for p in (p for p in patterns.PATTERNS if p.kind in _FOUND_AT):
        r, flags = (p.regex.removeprefix("(?iu)"), "'i'") if p.regex.startswith("(?iu)") else (p.regex, "''")
        r = r.replace("'", "''")
        one.append(f"SELECT id, '{p.kind}' AS type, regexp_split_to_array(name, '{r}', {flags}) AS s, regexp_extract_all(name, '{r}', 0, {flags}) AS m FROM samples")
    return f"""WITH {RUSSIAN}, f AS ({' UNION ALL '.join(one)}), k AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM f)
      SELECT id, type, (list_sum(list_transform(s[1:k], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: strlen(x))), 0))::INT AS position, strlen(m[k])::INT AS length,
        (list_sum(list_transform(s[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::INT AS char_position, m[k] AS matched_text FROM k"""


@query(_positions_sql())
def pattern_positions(spark, d):
    """Where patterns stand in Russian names, in bytes and in characters."""
    rules = [p for p in patterns.PATTERNS if p.kind in _FOUND_AT]
    return samples(spark, d).select("id", F.inline(patterns.detect_at(F.col("name"), rules)))


@query(f"""WITH {ITEMS} SELECT id, code AS brand, category AS model, name AS color FROM items""")
def positional_attributes(spark, d):
    """Attributes by position of a delimited text."""
    parts = parsing.split_top(F.concat_ws(", ", "code", "category", "name"), ",")
    good, _ = parsing.extract_by_position(parts, parsing.SCHEMAS["StandardProduct"])
    rows = items(spark, d).select("id", good.alias("a"))
    of = lambda n: F.get(F.filter("a", lambda x: x["name"] == n), F.lit(0))["value"]
    return rows.select("id", of("brand").alias("brand"), of("model").alias("model"), of("color").alias("color"))


# ---------------------------------------------------------------- metrics


@query(f"""WITH {LINES}, s AS (SELECT upload_id, count(*) AS total, count(code) * 100.0 / count(*) AS c, count(name) * 100.0 / count(*) AS n, count(characteristic) * 100.0 / count(*) AS h FROM lines GROUP BY 1)
  SELECT upload_id, total, round(c, 6) AS code_share, round(n, 6) AS name_share, round(h, 6) AS characteristic_share, round((c + n) / 2, 6) AS value,
  CASE WHEN (c + n) / 2 >= 95 THEN 'PASS' WHEN (c + n) / 2 >= 80 THEN 'WARNING' ELSE 'FAIL' END AS status FROM s""")
def completeness(spark, d):
    m = quality.completeness_metric(lines(spark, d), "upload_id", "code", "name", "characteristic")
    return m.select("upload_id", "total", *[F.round(c, 6).alias(c) for c in ("code_share", "name_share", "characteristic_share", "value")], "status")


@query(f"""WITH {LINES}, c AS (SELECT upload_id, code, count(*) AS n FROM lines GROUP BY ALL), s AS (SELECT upload_id, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicates FROM c GROUP BY 1)
  SELECT *, round((total - duplicates) * 100.0 / total, 6) AS value, CASE WHEN (total - duplicates) * 100.0 / total >= 99 THEN 'PASS' WHEN (total - duplicates) * 100.0 / total >= 95 THEN 'WARNING' ELSE 'FAIL' END AS status FROM s""")
def uniqueness(spark, d):
    return quality.uniqueness_metric(lines(spark, d), "upload_id", "code").withColumn("value", F.round("value", 6))


@query(f"""WITH {LINES}, s AS (SELECT upload_id, count(*) AS total, count(*) - count(code) AS invalid_codes, count(*) - count(name) AS invalid_names FROM lines GROUP BY 1)
  SELECT *, round((total - invalid_codes - invalid_names) * 100.0 / total, 6) AS value,
  CASE WHEN (total - invalid_codes - invalid_names) * 100.0 / total >= 95 THEN 'PASS' WHEN (total - invalid_codes - invalid_names) * 100.0 / total >= 80 THEN 'WARNING' ELSE 'FAIL' END AS status FROM s""")
def validity(spark, d):
    return quality.validity_metric(lines(spark, d), "upload_id", "code", "name").withColumn("value", F.round("value", 6))


@query(f"""WITH {LINES}, s AS (SELECT upload_id, count(*) AS total, count(*) FILTER ((name IS NULL) = (characteristic IS NULL)) AS consistent FROM lines GROUP BY 1)
  SELECT *, round(consistent * 100.0 / total, 6) AS value, CASE WHEN consistent * 100.0 / total >= 95 THEN 'PASS' WHEN consistent * 100.0 / total >= 80 THEN 'WARNING' ELSE 'FAIL' END AS status FROM s""")
def consistency(spark, d):
    return quality.consistency_metric(lines(spark, d), "upload_id", "name", "characteristic").withColumn("value", F.round("value", 6))


@query(f"WITH {LINES} SELECT upload_id, code, count(*) AS n FROM lines WHERE code <> '' GROUP BY ALL HAVING count(*) > 1")
def dup_codes_having(spark, d):
    return lines(spark, d).filter("code <> ''").groupBy("upload_id", "code").agg(F.count("*").alias("n")).filter("n > 1")


_PARTY = """CASE c_custkey % 4 WHEN 0 THEN 'INN 77' || lpad((c_custkey % 600)::VARCHAR, 8, '0') || ' KPP ' || lpad(c_custkey::VARCHAR, 9, '0') || ' address ' || c_nationkey WHEN 1 THEN 'phone ' || c_phone WHEN 2 THEN 'inn: ' || lpad((c_custkey * 7919)::VARCHAR, 12, '5') ELSE NULL END"""


def _parties(spark, d):
    k = F.col("c_custkey")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("INN 77"), F.lpad((k % 600).cast("string"), 8, "0"), F.lit(" KPP "), F.lpad(k.cast("string"), 9, "0"), F.lit(" address "), "c_nationkey"))
        .when(k % 4 == 1, F.lit("phone 5")).when(k % 4 == 2, F.concat(F.lit("inn: "), F.lpad((k * 7919).cast("string"), 12, "5")))
    )
    rows = table(spark, d, "customer").select(k.alias("id"), F.concat(F.lit("party "), (k % 900).cast("string")).alias("name"), text.alias("attributes"))
    return rows.withColumn("inn", validators.extract_inn(F.col("attributes"))).withColumn("kpp", validators.extract_kpp(F.col("attributes")))


_PARTIES = f"""t AS (SELECT c_custkey AS id, 'party ' || (c_custkey % 900) AS name, {_PARTY.replace("'phone ' || c_phone", "'phone 5'")} AS a FROM customer),
  parties AS (SELECT id, name, a, coalesce(nullif(regexp_extract(a, '(?i)(?:инн|inn)[\\s:]*(\\d{{10,12}})', 1), ''), nullif(regexp_extract(a, '(\\d{{10}}|\\d{{12}})', 1), '')) AS inn,
    coalesce(nullif(regexp_extract(a, '(?i)(?:кпп|kpp)[\\s:]*(\\d{{9}})', 1), ''), nullif(regexp_extract(a, '(\\d{{9}})', 1), '')) AS kpp FROM t)"""


@query(f"""WITH {_PARTIES}, s AS (SELECT count(*) AS total, count(inn) * 100.0 / count(*) AS inns, count(kpp) * 100.0 / count(*) AS kpps, count(*) FILTER (contains(a, 'address')) * 100.0 / count(*) AS addresses,
    count(*) FILTER (contains(a, 'phone')) * 100.0 / count(*) AS contacts FROM parties), i AS (SELECT coalesce(sum(n), 0) AS n FROM (SELECT count(*) AS n FROM parties WHERE inn IS NOT NULL GROUP BY inn HAVING count(*) > 1)),
  m AS (SELECT coalesce(sum(n), 0) AS n FROM (SELECT count(*) AS n FROM parties GROUP BY name HAVING count(*) > 1)), u AS (SELECT *, (total - greatest(i.n, m.n)) * 100.0 / total AS u FROM s, i, m)
  SELECT total, round(inns, 6) AS inns, round(kpps, 6) AS kpps, round((inns + kpps + addresses + contacts) / 4, 6) AS completeness, round(u::DOUBLE, 6) AS uniqueness, CASE WHEN u >= 99 THEN 'PASS' WHEN u >= 95 THEN 'WARNING' ELSE 'FAIL' END AS uniqueness_status FROM u""")
def counterparty_metrics(spark, d):
    m = quality.counterparty_metric(_parties(spark, d), "name", "inn", "kpp", "attributes")
    return m.select("total", *[F.round(c, 6).alias(c) for c in ("inns", "kpps", "completeness", "uniqueness")], "uniqueness_status")


@query(f"""WITH {_PARTIES}, v AS (SELECT id, inn, CASE strlen(inn) WHEN 10 THEN list_sum(list_transform([2,4,10,3,5,9,4,6,8], lambda w, i: w * inn[i]::INT)) % 11 % 10 = inn[10]::INT
    WHEN 12 THEN list_sum(list_transform([7,2,4,10,3,5,9,4,6,8], lambda w, i: w * inn[i]::INT)) % 11 % 10 = inn[11]::INT AND list_sum(list_transform([3,7,2,4,10,3,5,9,4,6,8], lambda w, i: w * inn[i]::INT)) % 11 % 10 = inn[12]::INT ELSE false END AS good FROM parties WHERE inn IS NOT NULL)
  SELECT id, 'invalid_inn' AS issue, 'HIGH' AS severity, inn AS value FROM v WHERE NOT good""")
def number_issues(spark, d):
    """Wrong tax numbers by row."""
    return quality.number_issues(_parties(spark, d).select("id", "attributes"), "id", "attributes")


@query(f"""WITH {LINES}, c AS (SELECT upload_id, code, count(*) AS n FROM lines GROUP BY ALL), d AS (SELECT upload_id, (sum(n) - coalesce(sum(n) FILTER (n > 1), 0)) * 100.0 / sum(n) AS u FROM c GROUP BY 1),
  s AS (SELECT upload_id, (count(code) + count(name)) * 50.0 / count(*) AS f, greatest(0, (count(code) + count(name) - count(*)) * 100.0 / count(*)) AS v, count(*) FILTER ((name IS NULL) = (characteristic IS NULL)) * 100.0 / count(*) AS k FROM lines GROUP BY 1),
  m AS (SELECT upload_id, unnest(['completeness', 'uniqueness', 'validity', 'consistency', 'overall']) AS category, unnest([f, u, v, k, (f + u + v + k) / 4]) AS value FROM s JOIN d USING (upload_id))
  SELECT upload_id, category, round(value::DOUBLE, 6) AS value FROM m""")
def upload_metrics(spark, d):
    """All metrics of all uploads, and their mean."""
    m = quality.upload_metrics(lines(spark, d), "upload_id", "code", "name", "characteristic")
    return m.select("upload_id", "category", F.round("value", 6).alias("value"))


_CATEGORIES = ["view", "click", "purchase", "error"]
_MEANS = ", ".join(f"avg(value) FILTER (category = '{c}') AS {c}" for c in _CATEGORIES)
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _CATEGORIES)


@query(f"""WITH {METRICS}, m AS (SELECT database_id, measured_at::DATE AS day, {_MEANS} FROM metrics GROUP BY ALL)
  SELECT database_id, day::VARCHAR AS day, {_ROUNDED}, round(coalesce(list_avg([{', '.join(_CATEGORIES)}]), 0), 6) AS overall FROM m""")
def trend_pivot(spark, d):
    m = metrics(spark, d).withColumn("day", F.to_date("measured_at"))
    t = reports.trend_pivot(m, ["database_id", "day"], "category", "value", _CATEGORIES)
    return t.select("database_id", F.col("day").cast("string").alias("day"), *[F.round(c, 6).alias(c) for c in (*_CATEGORIES, "overall")])


@query(f"WITH {METRICS} SELECT id, database_id, category, value FROM metrics m WHERE measured_at = (SELECT max(measured_at) FROM metrics x WHERE x.database_id = m.database_id)")
def trend_latest(spark, d):
    return reports.latest_batch(metrics(spark, d), "database_id", "measured_at").select("id", "database_id", "category", "value")


@query(f"""WITH {NORMALIZED}, g AS (SELECT coalesce(processing_level, 'basic') AS level, count(*) AS n, avg(ai_confidence) FILTER (ai_confidence > 0) AS m FROM normalized GROUP BY 1)
  SELECT level, n, round(coalesce(m, CASE level WHEN 'basic' THEN 50.0 WHEN 'enhanced' THEN 70.0 WHEN 'ai_enhanced' THEN 85.0 ELSE 95.0 END), 6) AS avg_quality, round(n * 100.0 / sum(n) OVER (), 6) AS percentage FROM g""")
def level_stats(spark, d):
    return reports.level_stats(normalized(spark, d), "processing_level", "ai_confidence").select("level", "n", F.round("avg_quality", 6).alias("avg_quality"), F.round("percentage", 6).alias("percentage"))


@query(f"""WITH {METRICS} SELECT id, database_id, severity, value FROM metrics
  ORDER BY CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END, value DESC, id LIMIT 20""")
def top_issues(spark, d):
    return metrics(spark, d).orderBy(reports.severity_order(F.col("severity")), F.desc("value"), "id").limit(20).select("id", "database_id", "severity", "value")


@query(f"""WITH {METRICS}, c AS (SELECT severity, count(*) AS n FROM metrics GROUP BY 1)
  SELECT s AS severity, coalesce(n, 0) AS n FROM (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO']) AS s) LEFT JOIN c ON severity = s""")
def severity_hist(spark, d):
    return reports.histogram(metrics(spark, d), "severity", ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"])


@query(f"""WITH {NORMALIZED} SELECT count(*) AS total, count(DISTINCT category) AS level1, count(DISTINCT concat(category, '|', group_category)) AS level2,
  round(avg(ai_confidence), 6) AS avg_confidence, count(*) FILTER (processing_level = 'basic') AS basic FROM normalized""")
def classif_stats(spark, d):
    return normalized(spark, d).agg(
        F.count("*").alias("total"), F.countDistinct("category").alias("level1"), F.countDistinct(F.concat_ws("|", "category", "group_category")).alias("level2"),
        F.round(F.avg("ai_confidence"), 6).alias("avg_confidence"), F.count(F.when(F.col("processing_level") == "basic", 1)).alias("basic"),
    )


@query(f"""WITH {NORMALIZED} SELECT count(*) AS total, count(*) FILTER (kpved_code <> '') AS classified, count(*) FILTER (kpved_code <> '' AND kpved_confidence >= 0.9) AS high,
  count(*) FILTER (kpved_code <> '' AND kpved_confidence >= 0.7 AND kpved_confidence < 0.9) AS medium, count(*) FILTER (kpved_code <> '' AND kpved_confidence < 0.7) AS low FROM normalized""")
def kpved_bands(spark, d):
    return reports.confidence_bands(normalized(spark, d), "kpved_code", "kpved_confidence")


@query(f"""WITH {NORMALIZED} SELECT id, CASE WHEN kpved_code = '4690' THEN '' ELSE kpved_code END AS kpved_code, round(CASE WHEN kpved_code = '4690' THEN 0 ELSE kpved_confidence END, 6) AS kpved_confidence FROM normalized""")
def reset_classification(spark, d):
    n = normalized(spark, d).withColumn("kpved_name", F.lit("x"))
    return classify.reset_classification(n, F.col("kpved_code") == "4690").select("id", "kpved_code", F.round("kpved_confidence", 6).alias("kpved_confidence"))


# ---------------------------------------------------------------- scores


@query(f"""WITH {NORMALIZED} SELECT id, 1.0 - 0.0 AS standard, CASE WHEN normalized_name = '' THEN 0.0 ELSE
  greatest(0.0, 1.0 - CASE WHEN length(normalized_name) < 3 THEN 0.5 WHEN length(normalized_name) < 10 THEN 0.2 WHEN length(normalized_name) > 100 THEN 0.3 WHEN length(normalized_name) > 50 THEN 0.1 ELSE 0 END
  - CASE WHEN length(regexp_replace(normalized_name, '[^0-9]', '', 'g')) / length(normalized_name) > 0.4 THEN 0.2 ELSE 0 END
  - CASE WHEN length(regexp_replace(normalized_name, '[a-z0-9\\s]', '', 'g')) / length(normalized_name) > 0.05 THEN 0.3 ELSE 0 END) END::DOUBLE AS clarity FROM normalized""")
def name_clarity(spark, d):
    n = normalized(spark, d)
    return n.select("id", quality.standardisation(F.col("normalized_name")).alias("standard"), quality.name_clarity(F.col("normalized_name")).alias("clarity"))


_SCORES = f"""k AS (SELECT *, list_filter(list_transform(string_split(trim(regexp_replace(lower(name), '\\\\s+', ' ', 'g')), ' '), lambda w: trim(w, '.,!?;:-"''')), lambda w: strlen(w) >= 3 AND NOT list_contains({dictionaries.STOP_KEYWORDS}, w) AND NOT regexp_matches(w, '^[0-9.,]+$')) AS before, list_filter(list_transform(string_split(trim(regexp_replace(lower(normalized_name), '\\\\s+', ' ', 'g')), ' '), lambda w: trim(w, '.,!?;:-"''')), lambda w: strlen(w) >= 3 AND NOT list_contains({dictionaries.STOP_KEYWORDS}, w) AND NOT regexp_matches(w, '^[0-9.,]+$')) AS after FROM normalized),
  c AS (SELECT *, CASE WHEN group_category = 'other' THEN 0.3 WHEN group_category = 'rings' THEN CASE WHEN contains(lower(name), 'ring') THEN 0.95 ELSE 0.6 END ELSE 0.7 END AS category_,
    CASE WHEN normalized_name = '' THEN 0.0 ELSE greatest(0.0, 1.0 - CASE WHEN length(normalized_name) < 3 THEN 0.5 WHEN length(normalized_name) < 10 THEN 0.2 WHEN length(normalized_name) > 100 THEN 0.3 WHEN length(normalized_name) > 50 THEN 0.1 ELSE 0 END
      - CASE WHEN length(regexp_replace(normalized_name, '[^0-9]', '', 'g')) / length(normalized_name) > 0.4 THEN 0.2 ELSE 0 END
      - CASE WHEN length(regexp_replace(normalized_name, '[a-z0-9\\s]', '', 'g')) / length(normalized_name) > 0.05 THEN 0.3 ELSE 0 END - CASE WHEN NOT regexp_matches(normalized_name, '[a-z]') THEN 0.5 ELSE 0 END) END AS clarity,
    len(list_filter(before, lambda s: len(list_filter(after, lambda w: contains(w, s) OR contains(s, w))) > 0)) / nullif(len(before), 0) AS kept FROM k),
  q AS (SELECT id, kpved_code, kpved_confidence, ai_reasoning, processing_level, category_ AS category, clarity, CASE WHEN normalized_name = '' THEN 0.0 WHEN kept IS NULL THEN 0.5 WHEN kept < 0.3 THEN 0.5 WHEN kept < 0.5 THEN 0.7 WHEN kept < 0.7 THEN 0.9 ELSE 1.0 END AS consistency,
    greatest(0.0, 1.0 - CASE WHEN normalized_name = '' THEN 0.5 ELSE 0 END - CASE WHEN group_category = 'other' THEN 0.3 ELSE 0 END - CASE WHEN len(after) = 0 THEN 0.2 ELSE 0 END) AS completeness,
    1.0 AS standardisation, CASE WHEN processing_level = 'ai_enhanced' AND ai_confidence > 0 THEN ai_confidence * 0.1 ELSE 0.0 END AS bonus FROM c)"""


@query(f"""WITH {NORMALIZED}, {_SCORES}, o AS (SELECT *, least(1.0, category * 0.2 + clarity * 0.25 + consistency * 0.2 + completeness * 0.15 + standardisation * 0.2 + bonus)::DOUBLE AS overall FROM q)
  SELECT id, round(category::DOUBLE, 6) AS category, round(clarity::DOUBLE, 6) AS clarity, round(consistency::DOUBLE, 6) AS consistency, round(completeness::DOUBLE, 6) AS completeness, round(standardisation::DOUBLE, 6) AS standardisation,
  round(bonus::DOUBLE, 6) AS bonus, round(overall, 6) AS overall, overall >= 0.9 AS is_benchmark FROM o""")
def quality_score(spark, d):
    """The weighted score with all its parts."""
    q = quality.with_quality(normalized(spark, d), "name", "normalized_name", "group_category", "ai_confidence", "processing_level", "other", {"rings": ["ring"]})
    return q.select("id", *[F.round(f"q.{c}", 6).alias(c) for c in ("category", "clarity", "consistency", "completeness", "standardisation", "bonus", "overall")], "q.is_benchmark")


@query(f"""WITH {NORMALIZED} SELECT id, round(CASE WHEN kpved_code = '' THEN 0 ELSE 0.4 + CASE WHEN kpved_code = '46.90.10' THEN 0.3 ELSE 0 END + kpved_confidence * 0.3 END, 6) AS accuracy,
  round(least(1.0, CASE WHEN strlen(ai_reasoning) > 10 THEN 0.4 ELSE 0 END + CASE WHEN kpved_code <> '' THEN 0.3 ELSE 0 END + CASE processing_level WHEN 'benchmark' THEN 0.3 WHEN 'ai_enhanced' THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS enrichment FROM normalized""")
def extended_parts(spark, d):
    """The parts that the extended score adds."""
    n = normalized(spark, d)
    accuracy = quality.kpved_accuracy(F.col("kpved_code"), F.col("kpved_confidence"))
    return n.select("id", F.round(accuracy, 6).alias("accuracy"), F.round(quality.data_enrichment(F.col("ai_reasoning"), F.col("kpved_code"), F.col("processing_level")), 6).alias("enrichment"))


@query(f"""WITH {NORMALIZED}, {_SCORES} SELECT id, round(least(1.0, category * 0.15 + clarity * 0.2 + consistency * 0.15 + completeness * 0.1 + standardisation * 0.15
  + CASE WHEN kpved_code = '' THEN 0 ELSE 0.4 + CASE WHEN kpved_code = '46.90.10' THEN 0.3 ELSE 0 END + kpved_confidence * 0.3 END * 0.15 + CASE WHEN id % 9 = 0 THEN 0 ELSE 0.05 END
  + least(1.0, CASE WHEN strlen(ai_reasoning) > 10 THEN 0.4 ELSE 0 END + CASE WHEN kpved_code <> '' THEN 0.3 ELSE 0 END + CASE processing_level WHEN 'benchmark' THEN 0.3 WHEN 'ai_enhanced' THEN 0.2 ELSE 0 END) * 0.05 + bonus)::DOUBLE, 6) AS overall FROM q""")
def extended_quality_score(spark, d):
    """The score over eight parts."""
    n = quality.with_quality(normalized(spark, d), "name", "normalized_name", "group_category", "ai_confidence", "processing_level", "other", {"rings": ["ring"]})
    score = quality.extended_score(F.col("q"), quality.kpved_accuracy(F.col("kpved_code"), F.col("kpved_confidence")), F.col("id") % 9 == 0, quality.data_enrichment(F.col("ai_reasoning"), F.col("kpved_code"), F.col("processing_level")))
    return n.select("id", F.round(score, 6).alias("overall"))


@query("""SELECT page_id, CASE WHEN url LIKE '%://%' THEN rtrim(url, '/') END AS target, trim(regexp_replace(regexp_replace(url, '[\\\\/:*?"<>|\\s]', '_', 'g'), '_+', '_', 'g'), '_') AS file FROM pages""")
def page_targets(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", answers.target_url(F.col("url")).alias("target"), answers.file_name(F.col("url")).alias("file"))


@query(f"""WITH {ITEMS} SELECT id, code, CASE WHEN id % 2 = 0 THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM items""")
def model_answers(spark, d):
    """Broken JSON answers of a model, mended and read."""
    text = F.concat(F.lit('```json\n{"selected_code": "'), "code", F.lit('"\n "confidence": '), F.when(F.col("id") % 2 == 0, "null").otherwise(".9"), F.lit('\n "reasoning": "x"}\n```'))
    return items(spark, d).select("id", answers.parse_answer(text).alias("a")).select("id", "a.code", "a.confidence")


_RULES = {
    "require_kpved_code": "kpved_code = ''", "valid_kpved_format": "kpved_code = '4690'", "name_length": "length(normalized_name) < 3 OR length(normalized_name) > 100",
    "kpved_confidence_threshold": "kpved_code <> '' AND kpved_confidence < 0.7", "ai_confidence_threshold": "processing_level = 'ai_enhanced' AND ai_confidence < 0.8",
    "processing_level": "processing_level = 'enhanced'", "ai_reasoning": "processing_level IN ('ai_enhanced', 'benchmark') AND length(ai_reasoning) < 10",
    "require_normalized_name": "normalized_name = ''", "name_format": "normalized_name <> '' AND NOT regexp_matches(normalized_name, '\\pL')",
}
_VIOLATIONS_SQL = " UNION ALL ".join(f"SELECT id, '{r}' AS rule FROM normalized WHERE {c}" for r, c in _RULES.items())


@query(f"WITH {NORMALIZED} {_VIOLATIONS_SQL}")
def violations(spark, d):
    return normalized(spark, d).select("id", F.explode(quality.violations()).alias("v")).select("id", "v.rule")


@query(f"""WITH {NORMALIZED}, v AS ({_VIOLATIONS_SQL}),
  s AS (SELECT CASE rule WHEN 'require_kpved_code' THEN 'high' WHEN 'ai_confidence_threshold' THEN 'low' ELSE 'medium' END AS priority, 'kpved_code' AS k, rule FROM v
        WHERE rule IN ('require_kpved_code', 'valid_kpved_format', 'kpved_confidence_threshold', 'ai_confidence_threshold')
        UNION ALL SELECT 'medium', '', '' FROM normalized WHERE processing_level = 'basic'
        UNION ALL SELECT 'high', '', '' FROM normalized WHERE kpved_code = '' AND processing_level <> 'basic')
  SELECT priority, count(*) AS n FROM s GROUP BY priority""")
def suggestions(spark, d):
    s = normalized(spark, d).select("id", F.explode(quality.suggestions(quality.violations())).alias("s"))
    return s.groupBy(F.col("s.priority").alias("priority")).agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS} SELECT id, CASE WHEN name <> upper(name) THEN '' ELSE 'upper_case_name' END AS warnings, '' AS errors FROM items")
def ingest_validation(spark, d):
    errors, warnings = quality.validate_before_ingest()
    return items(spark, d).select("id", F.array_join(warnings, ",").alias("warnings"), F.array_join(errors, ",").alias("errors"))


# ---------------------------------------------------------------- classification


def _path():
    return F.array("r_name", "n_name", "c_mktsegment", "c_name")


def _paths(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


_PATHS = "p AS (SELECT c_custkey AS id, r_name AS a, n_name AS b, c_mktsegment AS c, c_name AS e FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _folded(spark, d, strategy):
    f = _paths(spark, d).select(F.col("c_custkey").alias("id"), classify.fold_path(_path(), 2, strategy).alias("f"))
    return f.select("id", F.col("f")[0].alias("level1"), F.col("f")[1].alias("level2"))


@query(f"WITH {_PATHS} SELECT id, a AS level1, concat_ws(' / ', b, c, e) AS level2 FROM p")
def fold_top(spark, d):
    return _folded(spark, d, "top")


@query(f"WITH {_PATHS} SELECT id, concat_ws(' / ', a, b, c) AS level1, e AS level2 FROM p")
def fold_bottom(spark, d):
    return _folded(spark, d, "bottom")


@query(f"WITH {_PATHS} SELECT id, a AS level1, concat_ws(' / ', b, c, e) AS level2 FROM p")
def fold_mixed(spark, d):
    return _folded(spark, d, "mixed")


@query(f"WITH {_PATHS} SELECT id, concat_ws(' / ', a, b, c, e) AS level1, e AS level2 FROM p")
def fold_by_strategy(spark, d):
    """The configured bottom strategy."""
    f = _paths(spark, d).select(F.col("c_custkey").alias("id"), classify.fold_category(_path(), "bottom_priority").alias("f"))
    return f.select("id", F.col("f")[0].alias("level1"), F.col("f")[1].alias("level2"))


@query("""SELECT r_name AS code, r_name AS name, 0 AS level, count(n_nationkey) AS children, count(n_nationkey) > 0 AS has_children
  FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def tree_children(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    top = r.select(F.col("r_name").alias("code"), F.col("r_name").alias("name"), F.lit("").alias("parent_code"), F.lit(0).alias("level"))
    below = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("parent_code"), F.lit(1).alias("level"))
    return classify.tree_children(top.unionByName(below))


@query("SELECT n_name AS code, concat_ws('>', r_name, n_name) AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, r_name FROM region")
def tree_paths(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    tree = r.select(F.col("r_name").alias("code"), F.lit("").alias("parent_code")).unionByName(n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("code"), F.col("r_name").alias("parent_code")))
    return classify.tree_paths(tree, 3).select("code", F.array_join("path", ">").alias("path"))


@query(f"""WITH {ITEMS}, s AS (SELECT id, CASE WHEN regexp_matches(lower(name), '\\b(ring|bolt)\\b') THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(name), 'kg') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(lower(name), '\\b\\d+[xх]\\d+') THEN 1.0 ELSE 0 END AS p,
  CASE WHEN contains(lower(name), 'red') THEN 0.5 ELSE 0 END AS v FROM items)
  SELECT id, CASE WHEN p > v THEN 'product' WHEN v > p THEN 'service' ELSE 'unknown' END AS kind,
  round(CASE WHEN p = v THEN 0.5 ELSE greatest(0.6, least(0.95, 0.6 + (greatest(p, v) - least(p, v)) / (greatest(p, v) + 1) * 0.35)) END::DOUBLE, 6) AS confidence FROM s""")
def product_service(spark, d):
    r = classify.product_or_service(F.col("name"), [r"\b(ring|bolt)\b"], [], ["kg"], ["red"], [r"\b\d+[xх]\d+"])
    return items(spark, d).select("id", r.alias("r")).select("id", "r.kind", F.round("r.confidence", 6).alias("confidence"))


@query(f"""WITH {ITEMS}, w AS (SELECT id, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '\\b\\d+[xх]\\d+', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x IN ('ring', 'bolt', 'widget')) AS k FROM items)
  SELECT id, CASE k[1] WHEN 'ring' THEN '28.15.32' WHEN 'bolt' THEN '25.93.11' WHEN 'widget' THEN '26.51.52' END AS code, CASE k[1] WHEN 'ring' THEN 0.9 WHEN 'bolt' THEN 0.98 WHEN 'widget' THEN 0.8 END::DOUBLE AS confidence FROM w""")
def keyword_root(spark, d):
    entries = [("ring", "28.15.32", 0.9), ("bolt", "25.93.11", 0.98), ("widget", "26.51.52", 0.8)]
    return classify.classify_by_keyword(items(spark, d).select("id", "name"), "name", entries, []).select("id", "code", "confidence")


@query(f"WITH {NORMALIZED} SELECT normalized_name AS name, 'M' || length(normalized_name) AS code, count(*) AS n FROM normalized GROUP BY ALL")
def model_classify(spark, d):
    """A pluggable model, asked once per distinct name; here a deterministic stub."""
    told = classify.with_model(normalized(spark, d).select("id", "normalized_name"), "normalized_name", lambda names: [(f"M{len(n)}", 0.9) for n in names])
    return told.groupBy(F.col("normalized_name").alias("name"), "code").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- duplicates


@query(f"""WITH {ITEMS} SELECT trim(lower(code)) AS key, count(*) AS size, min(id) AS first_id FROM items WHERE code <> '' GROUP BY 1 HAVING count(*) >= 2""")
def exact_dups(spark, d):
    return dedup.exact_groups(items(spark, d), "code")


@query(f"""WITH {NORMALIZED}, s AS (SELECT id, normalized_name, ai_confidence * 40.0 + 10.0 + CASE processing_level WHEN 'ai_enhanced' THEN 20.0 WHEN 'benchmark' THEN 30.0 ELSE 0.0 END + least(length(normalized_name) / 2.0, 10.0) AS score FROM normalized)
  SELECT normalized_name AS group_id, arg_max(id, round(score, 9) * 1000000000 - id) AS master_id, count(*) AS size FROM s GROUP BY 1""")
def master_record(spark, d):
    score = F.round(dedup.master_score(F.col("ai_confidence"), F.lit(1), F.col("processing_level"), F.col("normalized_name")), 9)
    return dedup.masters(normalized(spark, d).withColumn("group_id", F.col("normalized_name")), score).select("group_id", "master_id", "size")


@query(f"""WITH {NORMALIZED} SELECT n.normalized_name, n.merged_count + b.more AS merged_count FROM (SELECT normalized_name, 1 AS merged_count FROM normalized WHERE id % 10 = 0 GROUP BY 1) n
  JOIN (SELECT normalized_name, count(*) AS more FROM normalized WHERE id % 10 <> 0 AND ai_confidence >= 0.5 GROUP BY 1) b USING (normalized_name)""")
def batch_filter(spark, d):
    """Stored groups (a tenth of the items) whose count rises when a batch of confident rows (the others) meets them."""
    n = normalized(spark, d)
    stored = n.filter("id % 10 = 0").groupBy("normalized_name").agg(F.lit(1).cast("long").alias("merged_count"))
    _, raised = dedup.drop_known(n.filter("id % 10 <> 0").select("id", "normalized_name", "ai_confidence"), stored, sure=F.col("ai_confidence") >= 0.5)
    return raised.filter("merged_count > 1")


# ---------------------------------------------------------------- reports and versions


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders)
  SELECT o_custkey AS database_id, o_orderkey AS upload_id FROM r WHERE k <= 3""")
def latest_n_uploads(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("database_id"), F.col("o_orderkey").alias("upload_id"), "o_orderdate")
    return snapshots.latest_per(o, ["database_id"], [F.desc("o_orderdate"), F.col("upload_id")], 3).select("database_id", "upload_id")


@query(f"WITH {LINES} SELECT upload_id, count(*) AS items, count(DISTINCT code) AS catalogs FROM lines GROUP BY 1")
def snapshot_compare(spark, d):
    return snapshots.compare_uploads(lines(spark, d), "upload_id", "code")


@query(f"""WITH {LINES}, s AS (SELECT upload_id, count(DISTINCT code) / count(*) AS score FROM lines GROUP BY 1),
  e AS (SELECT round(arg_min(score, upload_id), 6) AS first_score, round(arg_max(score, upload_id), 6) AS last_score FROM s)
  SELECT *, CASE WHEN last_score - first_score > 0.1 THEN 'improving' WHEN last_score - first_score < -0.1 THEN 'degrading' ELSE 'stable' END AS trend FROM e""")
def snapshot_metrics(spark, d):
    t = snapshots.trend(snapshots.upload_scores(lines(spark, d), "upload_id", "code"), "upload_id")
    return t.select(F.round("first_score", 6).alias("first_score"), F.round("last_score", 6).alias("last_score"), "trend")


@query(f"""WITH {LINES}, l AS (SELECT *, coalesce(name, '-') AS shown FROM lines) SELECT code, count(*) AS rows, arg_min(shown, upload_id * 100000000 + reference * 10 + line) AS first_name,
  CASE WHEN count(*) = 1 THEN 'new' WHEN min(shown) <> max(shown) THEN 'modified' ELSE 'stable' END AS status FROM l GROUP BY code""")
def snapshot_evolution(spark, d):
    return snapshots.evolution(lines(spark, d).withColumn("shown", F.coalesce("name", F.lit("-"))), "code", "shown", ["upload_id", "reference", "line"])


@query(f"WITH {NORMALIZED} SELECT normalized_name, arg_min(id, (lower(name), id)) AS master_reference FROM normalized GROUP BY 1")
def master_reference(spark, d):
    return snapshots.master_references(normalized(spark, d), "normalized_name", "name", "id")


@query("""SELECT o_orderkey AS item, arg_max(l_shipinstruct, n) AS current_name, max(n)::INT AS last_stage, count(*) AS stages FROM
  (SELECT l_orderkey AS o_orderkey, concat(l_returnflag, '-', l_linenumber, '-', l_partkey) AS l_shipinstruct, l_linenumber AS n FROM lineitem WHERE l_linenumber <= 3
   QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_shipinstruct) = 1) GROUP BY 1""")
def stage_revert(spark, d):
    """Current names after going back to stage 3. Of several rows of a stage the one of the smallest part counts, of equals the first output in order."""
    li = table(spark, d, "lineitem")
    told = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("l_returnflag", "l_linenumber", "l_partkey")])
    li = li.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").cast("int").alias("stage"), "l_partkey", told.alias("output"))
    one = li.groupBy("item", "stage").agg(F.min_by("output", F.struct(F.isnull("l_partkey"), "l_partkey", "output")).alias("output"))
    return snapshots.stage_state(one, "item", "stage", "output", upto=3)


@query("""SELECT o_custkey AS code, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS reference, max(o_orderdate)::DATE::VARCHAR AS seq FROM orders GROUP BY 1""")
def upsert_last_wins(spark, d):
    """Two batches that overlap in time, the later one first; the row of the highest ``seq`` stays."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("reference"), F.struct(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("at")).alias("seq"))
    first = snapshots.upsert(o.limit(0), o.filter("reference % 2 = 1"), ["code"])
    both = snapshots.upsert(first, o.filter("reference % 2 = 0"), ["code"])
    return both.select("code", "reference", F.col("seq.day").cast("string").alias("seq"))


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey DESC LIMIT 1000")
def retention_top_n(spark, d):
    return snapshots.keep_newest(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 1000)


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def verify_missing(spark, d):
    got = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id")).join(got, "id", "left_anti")


@query("""SELECT r_regionkey, r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS child_count,
  (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS grandchild_count FROM region""")
def clients_with_stats(spark, d):
    return reports.stats_with_children(table(spark, d, "region"), "r_regionkey", table(spark, d, "nation"), "n_regionkey", table(spark, d, "customer"), "n_nationkey", "c_nationkey")


@query("""WITH b AS (SELECT p_partkey AS id, p_name AS original_name, p_type AS normalized_name, p_retailprice AS quality, p_size AS usage FROM part WHERE p_size > 10)
  SELECT name, arg_max(id, (quality, usage, -id)) AS benchmark_id FROM (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_type FROM part) JOIN b ON name = original_name OR name = normalized_name GROUP BY name""")
def benchmark_lookup(spark, d):
    p = table(spark, d, "part")
    b = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("original_name"), F.col("p_type").alias("normalized_name"), F.col("p_retailprice").alias("quality"), F.col("p_size").alias("usage"), (F.col("p_size") > 10).alias("is_approved"))
    n = p.select(F.col("p_name").alias("name")).union(p.select("p_type")).distinct()
    return reports.benchmark_lookup(n, "name", b)


_STEPS = [["o_custkey", "o_orderstatus", "o_orderpriority", "o_clerk"], ["o_custkey", "o_orderpriority", "o_clerk"], ["o_custkey", "o_orderpriority"], ["o_orderpriority", "o_clerk"], ["o_custkey"]]
_CASCADE = " UNION ALL ".join(f"SELECT q.query_id, {k + 1} AS step, o_orderkey, o_orderdate FROM o JOIN q USING ({', '.join(c)}) WHERE o_orderkey <> query_id" for k, c in enumerate(_STEPS))


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_custkey % 50 AS o_clerk, o_orderdate FROM orders), q AS (SELECT o_orderkey AS query_id, * EXCLUDE (o_orderkey, o_orderdate) FROM o WHERE o_orderkey % 50 = 0),
  m AS ({_CASCADE}) SELECT query_id, step, o_orderkey AS match_id FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY step, o_orderdate DESC, o_orderkey) = 1""")
def similar_upload_cascade(spark, d):
    """For each order whose key is divisible by 50 the latest other one that agrees in as much as possible, in five steps."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 50).alias("o_clerk"), "o_orderdate")
    q = o.filter("o_orderkey % 50 = 0").withColumnRenamed("o_orderkey", "query_id").drop("o_orderdate")
    return reports.best_match(q, o, _STEPS, "o_orderkey", [F.desc("o_orderdate"), F.col("o_orderkey")])


@query(f"WITH {NORMALIZED} SELECT group_category, normalized_name, count(*) AS merged_count, round(avg(kpved_confidence), 6) AS avg_confidence, round(max(kpved_confidence), 6) AS max_confidence FROM normalized GROUP BY ALL ORDER BY merged_count DESC, normalized_name, group_category LIMIT 10 OFFSET 5")
def group_page(spark, d):
    g = reports.group_rollup(normalized(spark, d), ["group_category", "normalized_name"], "kpved_confidence")
    g = reports.page(g, [F.desc("merged_count"), F.col("normalized_name"), F.col("group_category")], 5, 10)
    return g.select("group_category", "normalized_name", "merged_count", F.round("avg_confidence", 6).alias("avg_confidence"), F.round("max_confidence", 6).alias("max_confidence"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey = 7 AND lower(c_name) LIKE '%1%'")
def filtered_search(spark, d):
    c = reports.equals(table(spark, d, "customer"), {"c_mktsegment": "MACHINERY", "c_nationkey": 7})
    return c.filter(F.lower("c_name").contains("1")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, name LIMIT 5")
def top_names(spark, d):
    return reports.top_counts(table(spark, d, "part").withColumnRenamed("p_name", "name"), "name", 5)


@query("""SELECT DISTINCT c_custkey AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 30 DAY FROM orders)""")
def recent_clients(spark, d):
    """Semi join with a relative date; the reference date comes from the data, never from the clock."""
    o = table(spark, d, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))
    recent = o.join(F.broadcast(last), F.col("o_orderdate") >= F.col("last") - F.expr("INTERVAL 30 DAYS")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(recent, "c_custkey", "left_semi").select(F.col("c_custkey").alias("id"))
