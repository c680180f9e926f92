"""Scalar functions over Russian names; their SQL spells out the same patterns and word lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.functions import dictionaries as D
from lodewright.functions import names, parsing, patterns, validators
from lodewright.operators import classify, quality

from .adapters import RUSSIAN, normalized_sql, samples, table
from .base import query


def _re2(p: str) -> str:
    return p.replace("(?iu)", "(?i)")


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query(f"WITH {RUSSIAN} SELECT id, {normalized_sql('name')} AS normalized_name FROM samples")
def russian_names(spark, d):
    return samples(spark, d).select("id", names.normalize_name(F.col("name")).alias("normalized_name"))


_HITS = f"hits AS ({' UNION ALL '.join(f"SELECT id, '{p.kind}' AS type, len(regexp_extract_all(name, '{_re2(p.regex)}')) AS n FROM samples" for p in patterns.PATTERNS)})"


@query(f"WITH {RUSSIAN}, {_HITS} SELECT id, type, n FROM hits WHERE n > 0")
def russian_patterns(spark, d):
    """Matches of all thirteen rules by item."""
    m = samples(spark, d).select("id", F.explode(patterns.detect(F.col("name"))).alias("m"))
    return m.groupBy("id", F.col("m.type").alias("type")).agg(F.count("*").alias("n"))


@query(f"""WITH {RUSSIAN}, {_HITS}, c AS (SELECT id, sum(CASE type {' '.join(f"WHEN '{p.kind}' THEN {p.confidence * (1.0 if p.fix else 0.7)}" for p in patterns.PATTERNS)} END * n) AS total, sum(n) AS n,
  coalesce(sum(n) FILTER (type IN ({', '.join(f"'{p.kind}'" for p in patterns.PATTERNS if not p.fix)})), 0) AS open FROM hits GROUP BY 1)
  SELECT id, round(CASE WHEN n = 0 THEN 1.0 ELSE total / n * CASE WHEN open = 0 THEN 0.95 ELSE 0.8 END END::DOUBLE, 6) AS confidence FROM c""")
def pattern_confidence(spark, d):
    return samples(spark, d).select("id", F.round(patterns.pattern_confidence(patterns.detect(F.col("name"))), 6).alias("confidence"))


_BRAND, _MODEL = (next(p for p in patterns.PATTERNS if p.kind == k) for k in ("brand", "model"))


@query(f"""WITH {RUSSIAN} SELECT id, array_to_string(regexp_extract_all(name, '{_re2(_BRAND.regex)}'), '|') AS brands, array_to_string(regexp_extract_all(name, '{_MODEL.regex}'), '|') AS models FROM samples""")
def brands_and_models(spark, d):
    return samples(spark, d).select("id", F.array_join(patterns.brands(F.col("name")), "|").alias("brands"), F.array_join(patterns.models(F.col("name")), "|").alias("models"))


@query(f"""WITH {RUSSIAN}, w AS (SELECT id, string_split(trim(regexp_replace(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS t, string_split(trim(regexp_replace(lower(name), '\\s+', ' ', 'g')), ' ') AS raw FROM samples)
  SELECT id, array_to_string(list_filter(t, lambda x: strlen(x) >= 2 AND NOT list_contains({D.STOP_NAMES}, x)), ' ') AS plain,
  array_to_string(list_filter(t, lambda x: strlen(x) >= 2 AND NOT list_contains({D.STOP_TABLE}, x) AND regexp_matches(x, '\\pL')), ' ') AS of_table,
  array_to_string(list_filter(list_transform(raw, lambda x: trim(x, '.,!?;:-"''')), lambda x: strlen(x) >= 3 AND NOT list_contains({D.STOP_KEYWORDS}, x) AND NOT regexp_matches(x, '^[\\p{{Nd}}.,]+$')), ' ') AS key_words,
  regexp_replace(translate(lower(name), '{D.SOUND_FROM}', '{D.SOUND_TO}'), '[^\\p{{L}}\\p{{Nd}}]', '', 'g') AS sound FROM w JOIN samples USING (id)""")
def russian_tokens(spark, d):
    """The three tokenizers and the phonetic key."""
    n = F.col("name")
    joined = lambda c: F.array_join(c, " ")
    return samples(spark, d).select("id", joined(names.tokens(n)).alias("plain"), joined(names.table_tokens(n)).alias("of_table"), joined(names.key_words(n)).alias("key_words"), names.phonetic_key(n).alias("sound"))


def _spelt(c: str) -> str:
    for k, v in D.LATIN.items():
        c = f"replace({c}, '{k}', '{v}')"
    return c


@query(f"""WITH {RUSSIAN}, s AS (SELECT id, trim(regexp_replace(regexp_replace(translate({_spelt("lower(trim(name))")}, ' -', '__'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_') AS t FROM samples)
  SELECT id, substr(CASE WHEN regexp_matches(t, '^[0-9]') THEN 'cat_' ELSE '' END || CASE WHEN t = '' THEN 'unknown' ELSE t END || '_items', 1, 64) AS table_name FROM s""")
def russian_tables(spark, d):
    return samples(spark, d).select("id", names.table_name(F.col("name")).alias("table_name"))


@query(f"""WITH {RUSSIAN} SELECT id, CASE {' '.join(f"WHEN {_any('lower(name)', ws)} THEN '{c}'" for c, ws in D.CATEGORIES.items())} ELSE '{D.OTHER}' END AS category FROM samples""")
def russian_categories(spark, d):
    """All seventeen categories, in declared order."""
    return samples(spark, d).select("id", names.categorize(F.col("name")).alias("category"))


_SCORE = lambda signs, words: " + ".join([f"CASE WHEN regexp_matches(t, '{s}') THEN 1.5 ELSE 0 END" for s in signs] + [f"CASE WHEN contains(t, '{w}') THEN 0.5 ELSE 0 END" for w in words])


@query(f"""WITH {RUSSIAN}, l AS (SELECT id, lower(name) AS t FROM samples), s AS (SELECT id, {_SCORE(D.PRODUCT_SIGNS, D.PRODUCT_WORDS)} + CASE WHEN {' OR '.join(f"regexp_matches(t, '{x}')" for x in D.PRODUCT_TRAITS)} THEN 1 ELSE 0 END AS p,
  {_SCORE(D.SERVICE_SIGNS, D.SERVICE_WORDS)} AS v FROM l)
  SELECT id, CASE WHEN p > v THEN 'product' WHEN v > p THEN 'service' ELSE 'unknown' END AS kind, round(p::DOUBLE, 6) AS product_score, round(v::DOUBLE, 6) AS service_score FROM s""")
def russian_goods_or_services(spark, d):
    r = samples(spark, d).select("id", classify.product_or_service(F.col("name")).alias("r"))
    return r.select("id", "r.kind", F.round("r.product_score", 6).alias("product_score"), F.round("r.service_score", 6).alias("service_score"))


def _cleaned(c: str) -> str:
    for p in classify.NOISE:
        c = f"regexp_replace({c}, '{p}', ' ', 'g')"
    return f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"


_KNOWN = [w for w, _, _ in classify.KEYWORDS]
_ENTRIES = ", ".join(f"('{w}', '{c}', {v})" for w, c, v in classify.KEYWORDS)


@query(f"""WITH {RUSSIAN}, k(root, code, sure) AS (VALUES {_ENTRIES}), c AS (SELECT id, {_cleaned('name')} AS t FROM samples), w AS (SELECT id, t, string_split(t, ' ') AS words FROM c),
  r AS (SELECT id, t, coalesce({', '.join(f"CASE WHEN contains(t, '{p}') THEN '{k}' END" for p, k in classify.PHRASES)},
    list_reduce(list_prepend('', list_filter(words, lambda x: list_contains({_KNOWN}, x))), lambda a, x: CASE WHEN strlen(x) > strlen(a) THEN x ELSE a END), '') AS found, words FROM w)
  SELECT id, CASE WHEN found <> '' THEN found ELSE words[1] END AS root, code FROM r LEFT JOIN k ON root = CASE WHEN found <> '' THEN found ELSE words[1] END""")
def russian_keywords(spark, d):
    """Root words by the whole dictionary and all phrases, and their codes."""
    return classify.classify_by_keyword(samples(spark, d), "name").select("id", "root", "code")


_PRODUCT = f"""({' OR '.join(f"contains(lower(name), '{w}')" for w in D.PRODUCT_WORDS + classify.TOOL_WORDS)} OR {' OR '.join(f"regexp_matches(lower(name), '{t}')" for t in D.PRODUCT_TRAITS)})"""


@query(f"""WITH {RUSSIAN} SELECT id, {_PRODUCT} AS product, length(name) > 0 AND (strlen(name) > 50 OR len(string_split(trim(regexp_replace(name, '\\s+', ' ', 'g')), ' ')) > 5
  OR length(regexp_replace(name, '[^\\p{{Nd}}]', '', 'g')) / length(name) > 0.3 OR length(regexp_replace(name, '[\\p{{L}}\\p{{Nd}}\\s]', '', 'g')) / length(name) > 0.1 OR {_any('lower(name)', classify.TECHNICAL_PARTS)}) AS needs_model FROM samples""")
def model_gates(spark, d):
    """Which names are those of goods, and which need a model (their category is known here)."""
    return samples(spark, d).select("id", classify.likely_product(F.col("name"), F.lit(""), []).alias("product"), classify.requires_model(F.col("name"), F.lit("known")).alias("needs_model"))


@query(f"""WITH {RUSSIAN}, a AS (SELECT id, name, CASE id % 4 WHEN 0 THEN '71.20.1' WHEN 1 THEN '32.99.5' WHEN 2 THEN '26.12.1' ELSE '25.93.11' END AS code, CASE WHEN id % 5 = 0 THEN NULL ELSE '26.51.52' END AS better,
    {_PRODUCT} AS product FROM samples)
  SELECT id, CASE WHEN product AND code = '71.20.1' AND better IS NOT NULL THEN 'service' WHEN product AND code = '71.20.1' THEN 'doubtful' WHEN code = '32.99.5' AND product AND better IS NOT NULL THEN 'rest'
    WHEN code = '71.20.1' AND better IS NOT NULL AND (contains(lower(name), 'датчик') OR contains(lower(name), 'преобразователь')) THEN 'mistake' ELSE '' END AS mended,
  CASE WHEN product AND code IN ('71.20.1', '32.99.5') AND better IS NOT NULL THEN better ELSE code END AS code, CASE WHEN product AND code IN ('71.20.1', '32.99.5') AND better IS NOT NULL THEN 0.9 WHEN product AND code = '71.20.1' THEN 0.4 ELSE 0.8 END::DOUBLE AS confidence FROM a""")
def mended_codes(spark, d):
    """Answers of a model held against those of the keywords."""
    i = F.col("id")
    code = F.when(i % 4 == 0, "71.20.1").when(i % 4 == 1, "32.99.5").when(i % 4 == 2, "26.12.1").otherwise("25.93.11")
    better = F.when(i % 5 == 0, None).otherwise("26.51.52")
    rows = samples(spark, d).withColumn("product", classify.likely_product(F.col("name"), F.lit(""), []))
    m = rows.select("id", classify.mend(F.col("name"), code, F.lit(""), F.lit(0.8), better, F.lit(""), F.lit(0.9), F.col("product")).alias("m"))
    return m.select("id", "m.mended", "m.code", "m.confidence")


@query("""WITH n AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN lpad((c_custkey * 7919 + 500000000000)::VARCHAR, 12, '0') WHEN 1 THEN lpad((c_custkey * 7919 + 100007)::VARCHAR, 10, '0') ELSE '770-' || (c_custkey * 31) END AS inn,
    lpad((c_custkey * 77)::VARCHAR, CASE WHEN c_custkey % 2 = 0 THEN 9 ELSE 8 END, '7') AS kpp FROM customer),
  b AS (SELECT *, replace(inn, '-', '') AS d FROM n)
  SELECT id, CASE strlen(d) WHEN 10 THEN list_sum(list_transform([2,4,10,3,5,9,4,6,8], lambda w, i: w * d[i]::INT)) % 11 % 10 = d[10]::INT
    WHEN 12 THEN list_sum(list_transform([7,2,4,10,3,5,9,4,6,8], lambda w, i: w * d[i]::INT)) % 11 % 10 = d[11]::INT AND list_sum(list_transform([3,7,2,4,10,3,5,9,4,6,8], lambda w, i: w * d[i]::INT)) % 11 % 10 = d[12]::INT ELSE false END AS valid,
  strlen(kpp) = 9 AS valid_kpp FROM b""")
def taxpayer_numbers(spark, d):
    """Numbers of ten and twelve digits, with hyphens and too short ones, and codes of nine digits and of fewer."""
    c = F.col("c_custkey")
    inn = F.when(c % 3 == 0, F.lpad((c * 7919 + 500000000000).cast("string"), 12, "0")).when(c % 3 == 1, F.lpad((c * 7919 + 100007).cast("string"), 10, "0")).otherwise(F.concat(F.lit("770-"), (c * 31).cast("string")))
    kpp = F.when(c % 2 == 0, F.lpad((c * 77).cast("string"), 9, "7")).otherwise(F.lpad((c * 77).cast("string"), 8, "7"))
    return table(spark, d, "customer").select(c.alias("id"), validators.valid_inn(inn).alias("valid"), validators.valid_kpp(kpp).alias("valid_kpp"))


_ODD_NAME = """CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' || p_name WHEN 2 THEN upper(p_name) WHEN 3 THEN '12 34' WHEN 4 THEN 'x' WHEN 5 THEN repeat(p_name, 40) ELSE p_name || chr(1) END"""
_ODD_CODE = """CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'a b' WHEN 2 THEN repeat('c', 101) ELSE 'k' || p_partkey END"""


@query(f"""WITH o AS (SELECT p_partkey AS id, {_ODD_NAME} AS n, {_ODD_CODE} AS c FROM part)
  SELECT id, array_to_string(list_filter([CASE WHEN trim(n) = '' THEN 'empty_name' END, CASE WHEN strlen(n) > 500 THEN 'name_too_long' END, CASE WHEN trim(n) <> '' AND length(trim(n)) < 2 THEN 'name_too_short' END,
    CASE WHEN contains(n, chr(1)) THEN 'control_characters' END, CASE WHEN contains(c, ' ') THEN 'space_in_code' END, CASE WHEN strlen(c) > 100 THEN 'code_too_long' END], lambda x: x IS NOT NULL), ',') AS errors,
  array_to_string(list_filter([CASE WHEN c = '' THEN 'no_code' END, CASE WHEN n <> trim(n) THEN 'space_around_name' END, CASE WHEN n <> '' AND n = upper(n) AND n <> lower(n) THEN 'upper_case_name' END,
    CASE WHEN n <> '' AND NOT regexp_matches(n, '\\pL') THEN 'no_letters' END], lambda x: x IS NOT NULL), ',') AS warnings FROM o""")
def ingest_problems(spark, d):
    """Names and codes with every error and warning that is looked for."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_ODD_NAME.replace("chr(1)", "char(1)")).alias("name"), F.expr(_ODD_CODE).alias("code"))
    errors, warnings = quality.validate_before_ingest()
    return p.select("id", F.array_join(errors, ",").alias("errors"), F.array_join(warnings, ",").alias("warnings"))


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 6 AS v, p_brand AS b, p_size AS s FROM part)
  SELECT id, CASE WHEN v IN (1, 4) THEN 1 ELSE 0 END + CASE WHEN v = 2 THEN 1 ELSE 0 END + CASE WHEN v = 0 THEN 1 ELSE 0 END AS errors, CASE WHEN v = 2 THEN NULL ELSE s || 'W' END AS power, CASE WHEN v = 4 THEN NULL ELSE b END AS brand FROM p""")
def electronics_by_position(spark, d):
    """A schema with required and checked slots: a missing, an empty and a wrong value are told."""
    v = F.col("p_partkey") % 6
    power = F.when(v == 2, "none").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("W")))
    text = F.when(v == 0, F.array("p_brand", F.lit(""), power, F.lit("220V"))).when(v == 1, F.array("p_brand", F.lit(" "), power, F.lit("12V"), F.lit("red"))).when(v == 4, F.array(F.lit(""), F.lit("m"), power, F.lit("12V"))).otherwise(F.array("p_brand", F.lit("m"), power, F.lit("12V"), F.lit("red")))
    good, bad = parsing.extract_by_position(text, parsing.SCHEMAS["Electronics"])
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), good.alias("a"), bad.alias("e"))
    of = lambda n: F.get(F.filter("a", lambda x: x["name"] == n), F.lit(0))["value"]
    return rows.select("id", F.size("e").alias("errors"), of("power").alias("power"), of("brand").alias("brand"))


@query(f"WITH {RUSSIAN} SELECT id, (lower(name) LIKE '%арт.%' OR lower(name) LIKE '%код:%' OR lower(name) LIKE '%код %') AS suspicious FROM samples")
def suspicious_names(spark, d):
    return samples(spark, d).select("id", quality.suspicious(F.col("name")).alias("suspicious"))


@query(f"""WITH {RUSSIAN}, r AS (SELECT id, lower(name) AS t FROM samples), x AS (SELECT id, regexp_extract(t, '\\d+[xх]\\d+', 0) AS size, t FROM r),
  a AS (SELECT id, substr(t, strpos(t, size) + length(size), 100) AS after FROM x WHERE size <> '')
  SELECT id, nullif(regexp_extract(after, '(?:^|[^\\p{{L}}])((?:белый|черный|white)[а-яa-z]*)', 1), '') AS color, nullif(regexp_extract(after, '((?:оцинкован)[а-яa-z]*)', 1), '') AS coating FROM a""")
def related_attributes(spark, d):
    """Colours and coatings that stand behind a size."""
    rows = samples(spark, d).filter(F.lower("name").rlike(names.DIMENSION)).select("id", names.related_attributes(F.lower("name"), names.DIMENSION, "dimension").alias("a"))
    of = lambda n: F.get(F.filter("a", lambda x: x["name"] == n), F.lit(0))["value"]
    return rows.select("id", of("color").alias("color"), of("coating").alias("coating"))

