"""Queries of whole workflows: snapshots, sessions, gates, reports, state changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodewright.functions import names
from lodewright.operators import classify, pipelines, quality, reports, snapshots
from lodewright.operators.descent import descend

from .adapters import CATEGORIES, ITEMS, METRICS, NORMALIZED, OTHER, categorized_sql, items, metrics, normalized, normalized_sql, table
from .base import query

# ---------------------------------------------------------------- selections


@query(f"WITH {NORMALIZED} SELECT id, normalized_name FROM normalized WHERE kpved_code = '' AND processing_level = 'basic' ORDER BY id LIMIT 25")
def pending_items(spark, d):
    """The first items that wait for a code."""
    n = reports.equals(normalized(spark, d), {"kpved_code": "", "processing_level": "basic"})
    return reports.page(n, [F.col("id")], 0, 25).select("id", "normalized_name")


@query(f"""WITH {ITEMS} SELECT id, name, (SELECT count(*) FROM items WHERE contains(lower(name), 'ring') OR contains(lower(category), 'ring')) AS total FROM items
  WHERE contains(lower(name), 'ring') OR contains(lower(category), 'ring') ORDER BY id LIMIT 10 OFFSET 5""")
def search_page(spark, d):
    """A page of the items of which any of two columns has a text, and how many there are."""
    found = reports.searched(items(spark, d), "RING", ["name", "category"]).select("id", "name")
    return reports.paged(found, [F.col("id")], 5, 10).select("id", "name", "total")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS code FROM lineitem WHERE l_suppkey = 3 AND l_returnflag IN ('A', 'R')""")
def upload_items(spark, d):
    """Items of one upload in two of its catalogs."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("code"), F.col("l_suppkey").alias("upload_id"), F.col("l_returnflag").alias("catalog"))
    return reports.upload_items(rows, 3, ["A", "R"]).select("id", "code")


@query(f"WITH {METRICS} SELECT id, database_id FROM metrics WHERE measured_at >= (SELECT max(measured_at) FROM metrics) - INTERVAL 7 DAY")
def keep_recent(spark, d):
    """Measurements of the last seven days, counted from the last one."""
    m = metrics(spark, d)
    last = m.agg(F.max("measured_at").alias("as_of"))
    return snapshots.keep_recent(m.join(F.broadcast(last)), "measured_at", F.col("as_of"), 7).select("id", "database_id")


@query("SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 20")
def by_priority_text(spark, d):
    """Priorities in the order of their texts."""
    return reports.page(table(spark, d, "orders"), [F.desc("o_orderpriority"), F.col("o_orderkey")], 0, 20).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS used FROM customer ORDER BY used DESC NULLS LAST, id LIMIT 30")
def nulls_last(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("used"))
    return reports.page(c, [F.desc_nulls_last("used"), F.col("id")], 0, 30)


# ---------------------------------------------------------------- reports


@query(f"WITH {NORMALIZED} SELECT group_category, normalized_name, count(*) AS merged_count FROM normalized WHERE trim(kpved_code) = '' GROUP BY ALL")
def unclassified_groups(spark, d):
    n = normalized(spark, d).filter("kpved_code = ''").groupBy("group_category", "normalized_name").agg(F.count("*").alias("n"), F.first("kpved_code").alias("kpved_code"))
    return reports.unclassified(n, ["group_category", "normalized_name"], "kpved_code", "n")


@query(f"WITH {METRICS} SELECT database_id, round(avg(value), 6) AS overall, count(*) AS metrics FROM metrics GROUP BY 1")
def overall_scores(spark, d):
    return reports.overall_scores(metrics(spark, d), "database_id", "value").select("database_id", F.round("overall", 6).alias("overall"), "metrics")


@query(f"""WITH {METRICS}, l AS (SELECT database_id, {', '.join(f"coalesce(arg_max(value, (measured_at, id)) FILTER (category = '{c}'), 0.0) AS {c}" for c in ("view", "click", "purchase"))} FROM metrics GROUP BY 1)
  SELECT database_id, round(view, 6) AS view, round(click, 6) AS click, round(purchase, 6) AS purchase, round(coalesce(list_avg(list_filter([view, click, purchase], lambda x: x > 0)), 0), 6) AS overall FROM l""")
def entity_scores(spark, d):
    """The last value of each kind, and the mean of those above zero."""
    kinds = ["view", "click", "purchase"]
    m = metrics(spark, d).withColumn("at", F.struct("measured_at", "id"))
    e = reports.entity_scores(m, "database_id", "category", "value", "at", kinds)
    return e.select("database_id", *[F.round(c, 6).alias(c) for c in (*kinds, "overall")])


@query("SELECT (SELECT count(*) FROM orders) AS uploads, (SELECT count(*) FROM part) AS items, (SELECT count(*) FROM customer) AS clients")
def dashboard(spark, d):
    return reports.totals({"uploads": table(spark, d, "orders"), "items": table(spark, d, "part"), "clients": table(spark, d, "customer")})


@query(f"WITH {METRICS} SELECT category, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(count(*) * 100.0 / (SELECT count(*) FROM metrics), 6) AS share FROM metrics GROUP BY 1")
def event_counters(spark, d):
    c = reports.counters(metrics(spark, d), "category", "value")
    return c.select("category", "n", F.round("mean", 6).alias("mean"), "least", "most", F.round("share", 6).alias("share"))


@query(f"""WITH {NORMALIZED} SELECT processing_level, count(*) AS items, count(DISTINCT nullif(kpved_code, '')) AS distinct_kpved_code, count(DISTINCT group_category) AS distinct_group_category, count(DISTINCT category) AS distinct_category,
  count(DISTINCT normalized_name) AS distinct_normalized_name, count(DISTINCT code) AS distinct_code, round(avg(ai_confidence), 6) AS avg_confidence FROM normalized GROUP BY ROLLUP (processing_level)""")
def classification_counts(spark, d):
    """Distinct values of five levels, by strategy and in all."""
    levels = ["kpved_code", "group_category", "category", "normalized_name", "code"]
    c = reports.classification_counts(normalized(spark, d), levels, "ai_confidence", "processing_level")
    return c.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(f"WITH {ITEMS} SELECT category, count(*) AS n, min(price) AS least, max(price) AS most, round(avg(price), 6) AS mean FROM items GROUP BY 1 ORDER BY n DESC, category LIMIT 10")
def largest_categories(spark, d):
    """The ten largest categories."""
    g = items(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.min("price").alias("least"), F.max("price").alias("most"), F.round(F.avg("price"), 6).alias("mean"))
    return reports.page(g, [F.desc("n"), F.col("category")], 0, 10)


@query(f"""WITH {ITEMS}, t AS (SELECT len(string_split(trim(regexp_replace(name, '\\s+', ' ', 'g')), ' ')) AS tokens FROM items) SELECT tokens, count(*) AS items, round(count(*) * 100.0 / (SELECT count(*) FROM t), 6) AS share FROM t GROUP BY 1""")
def token_lengths(spark, d):
    """Items by the number of their words."""
    c = reports.counters(items(spark, d).withColumn("tokens", names.word_count(F.col("name"))).withColumn("one", F.lit(1)), "tokens", "one")
    return c.select("tokens", F.col("n").alias("items"), F.round("share", 6).alias("share"))


@query("""WITH g AS (SELECT p_brand AS group_id, unnest(list(p_partkey ORDER BY p_partkey)) AS id FROM part GROUP BY 1)
  SELECT group_id, id, coalesce(s_name, c_name, p_name) AS name, CASE WHEN s_name IS NOT NULL THEN 0 WHEN c_name IS NOT NULL THEN 1 ELSE 2 END AS "table" FROM g LEFT JOIN supplier ON s_suppkey = id LEFT JOIN customer ON c_custkey = id LEFT JOIN part ON p_partkey = id""")
def group_members(spark, d):
    """Members of groups, told by the first of three tables that has them."""
    members = table(spark, d, "part").select(F.col("p_brand").alias("group_id"), F.col("p_partkey").alias("id"))
    told = [table(spark, d, t).select(F.col(k).alias("id"), F.col(n).alias("name"), F.lit("").alias("code")) for t, k, n in (("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"))]
    return reports.enriched(members, told).select("group_id", "id", "name", "table")


@query("""WITH m AS (SELECT c_nationkey AS project, n_name AS name, sum(round(o_totalprice * 100)::BIGINT)::BIGINT // count(*) AS score, count(*) AS uploads FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
  SELECT project, name, score, uploads, row_number() OVER (ORDER BY score DESC, project) AS place FROM m""")
def project_comparison(spark, d):
    """Projects by their mean score, in cents."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    scored = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("project")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count("*").alias("uploads"))
    scored = scored.select("project", F.expr("cents div uploads").alias("score"), "uploads")
    return pipelines.compare_projects(scored.join(n.select(F.col("n_nationkey").alias("project"), F.col("n_name").alias("name")), "project"), "project", "score")


@query(f"""WITH {METRICS} SELECT id, CASE WHEN database_id % 3 = 0 THEN 'RESOLVED' WHEN id % 4 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS status, CASE WHEN database_id % 3 = 0 AND id % 4 <> 0 THEN 'user' END AS resolved_by
  FROM metrics WHERE severity IN ('CRITICAL', 'HIGH')""")
def resolve_issues(spark, d):
    """Serious issues, of which those of some databases are resolved; those that were before keep who did it."""
    m = metrics(spark, d).filter(F.col("severity").isin("CRITICAL", "HIGH"))
    open_ = m.select("id", "database_id", F.when(F.col("id") % 4 == 0, "RESOLVED").otherwise("OPEN").alias("status"), F.lit(None).cast("string").alias("resolved_by"), F.lit(None).cast("date").alias("resolved_at"))
    done = m.filter("database_id % 3 = 0").select("id")
    return reports.set_status(open_, "id", done, "RESOLVED", F.lit("2024-01-01").cast("date"), "user").select("id", "status", "resolved_by")


@query(f"WITH {ITEMS} SELECT '<tr><td>' || id || '</td><td>' || replace(replace(name, '&', '&amp;'), '<', '&lt;') || '</td></tr>' AS line FROM items")
def html_rows(spark, d):
    """The rows of a report in HTML."""
    lines = reports.html_report(items(spark, d), ["id", "name"], "items")
    return lines.filter("line like '<tr>%'")


# ---------------------------------------------------------------- versions and sessions


@query("""WITH s AS (SELECT o_custkey AS snapshot_id, o_orderkey AS upload_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS upload_order FROM orders)
  SELECT snapshot_id, upload_id, upload_order, round(sum(l_quantity), 2) AS items FROM s JOIN lineitem ON l_orderkey = upload_id GROUP BY ALL""")
def snapshot_members(spark, d):
    """Uploads of snapshots in their order, with what they hold."""
    o = snapshots.latest_per(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 1 << 30)
    order = F.expr("row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)")
    s = o.select(F.col("o_custkey").alias("snapshot_id"), F.col("o_orderkey").alias("upload_id"), order.cast("long").alias("upload_order"))
    held = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("upload_id")).agg(F.round(F.sum("l_quantity"), 2).alias("items"))
    return snapshots.members_of(s, held).select("snapshot_id", "upload_id", "upload_order", "items")


@query(f"""WITH {NORMALIZED}, a AS (SELECT id, name AS v FROM normalized WHERE id % 5 <> 0), b AS (SELECT id, CASE WHEN id % 3 = 0 THEN normalized_name ELSE name END AS v FROM normalized WHERE id % 7 <> 0)
  SELECT count(*) FILTER (a.id IS NULL) AS added, count(*) FILTER (a.v <> b.v) AS updated, count(*) FILTER (b.id IS NULL) AS removed, count(*) FILTER (a.v = b.v) AS unchanged FROM a FULL JOIN b ON a.id = b.id""")
def snapshot_changes(spark, d):
    """What changed between two versions of a catalog."""
    n = normalized(spark, d)
    before, after = n.filter("id % 5 <> 0").select("id", F.col("name").alias("v")), n.filter("id % 7 <> 0").select("id", F.when(F.col("id") % 3 == 0, F.col("normalized_name")).otherwise(F.col("name")).alias("v"))
    return snapshots.change_counts(before, after, "id", "v")


@query(f"""WITH {ITEMS}, s AS (SELECT id AS item, name AS original, {normalized_sql("name")} AS two FROM items)
  SELECT item, original, two AS final, 3 AS stages, original <> two AS changed FROM s""")
def normalization_session(spark, d):
    """A session of three stages, of which the last is reverted and made again, and completed."""
    s = snapshots.start_session(items(spark, d), "id", "name")
    s = snapshots.apply_stage(s, "normalize", names.normalize_name)
    tried = snapshots.revert(snapshots.apply_stage(s, "upper", F.upper), 1)
    return snapshots.complete_session(snapshots.apply_stage(tried, "again", F.trim))


@query("""WITH m AS (SELECT user_id AS database_id, ts::DATE AS day, avg(value) AS score FROM events GROUP BY ALL) SELECT database_id, day::VARCHAR AS day, round(score, 6) AS score FROM m""")
def trend_upsert(spark, d):
    """A row per database and day; the second run of a day takes the place of the first."""
    e = table(spark, d, "events").select(F.col("user_id").alias("database_id"), F.to_date("ts").alias("day"), "value")
    scores = lambda part, n: part.groupBy("database_id", "day").agg(F.avg("value").alias("score")).withColumn("seq", F.lit(n))
    both = snapshots.upsert(scores(e.filter("value > 5"), 1), scores(e, 2), ["database_id", "day"])
    return both.select("database_id", F.col("day").cast("string").alias("day"), F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- classification


@query("""SELECT c_custkey AS id, r_name AS category_level1, n_name AS category_level2, concat_ws(' / ', c_mktsegment, c_name) AS category_level3 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def written_levels(spark, d):
    """Paths written to items as levels."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).withColumn("id", F.col("c_custkey"))
    return classify.with_levels(rows, F.array("r_name", "n_name", "c_mktsegment", "c_name"), 3).select("id", "category_level1", "category_level2", "category_level3")


@query("""WITH p AS (SELECT c_custkey AS id, r_name AS a FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
  SELECT id, a AS category_level1, (SELECT count(*) FROM p) AS total FROM p ORDER BY id LIMIT 20 OFFSET 3""")
def items_by_levels(spark, d):
    """A page of the items of a level, and how many there are."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).withColumn("id", F.col("c_custkey"))
    told = reports.equals(classify.with_levels(rows, F.array("r_name", "n_name"), 2), {"category_level1": "ASIA"}).select("id", "category_level1")
    return reports.paged(told, [F.col("id")], 3, 20).select("id", "category_level1", "total")


@query(f"""WITH {NORMALIZED}, w AS (SELECT *, CASE WHEN contains(lower(name), 'ring') THEN '28.15.32' WHEN contains(lower(name), 'bolt') THEN '25.93.11' END AS found FROM normalized)
  SELECT id, CASE WHEN kpved_code = '' AND regexp_matches(lower(name), '\\b(ring|bolt)\\b') THEN CASE WHEN regexp_matches(lower(name), '\\bring\\b') THEN '28.15.32' ELSE '25.93.11' END ELSE kpved_code END AS kpved_code,
  kpved_code = '' AND regexp_matches(lower(name), '\\b(ring|bolt)\\b') AS reclassified FROM w""")
def reclassified(spark, d):
    """Items without a code, classified anew by keywords."""
    n = normalized(spark, d)
    return classify.reclassify(n, "name", entries=[("ring", "28.15.32", 0.9), ("bolt", "25.93.11", 0.98)], phrases=[]).select("id", "kpved_code", "reclassified")


@query(f"WITH {NORMALIZED} SELECT id, CASE WHEN kpved_confidence < 0.3 THEN 'incorrect' WHEN kpved_confidence >= 0.9 THEN 'correct' ELSE 'open' END AS validation_status FROM normalized")
def marked_classification(spark, d):
    """Codes marked right or wrong by their confidence."""
    n = normalized(spark, d).withColumn("validation_status", F.lit("open"))
    wrong = classify.reset_classification(n, F.col("kpved_confidence") < 0.3, "incorrect")
    return classify.reset_classification(wrong, F.col("kpved_confidence") >= 0.9, "correct").select("id", "validation_status")


def _tree(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    top = r.select(F.col("r_name").alias("code"), F.col("r_name").alias("name"), F.lit("").alias("parent_code"), F.lit(0).alias("level"))
    return top.unionByName(n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("parent_code"), F.lit(1).alias("level")))


@query("""WITH p AS (SELECT c_custkey AS id, concat_ws('>', r_name, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE 'NOWHERE' END) AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT id, path FROM p WHERE path IN (SELECT concat_ws('>', r_name, n_name) FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def existing_paths(spark, d):
    """Answers whose path is in the tree."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    told = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("c_custkey").alias("id"), F.concat_ws(">", "r_name", F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise("NOWHERE")).alias("path"))
    return classify.existing_paths(told, classify.tree_paths(_tree(spark, d), 3).select(F.array_join("path", ">").alias("path")))


@query("SELECT n_name AS code FROM nation WHERE contains(lower(n_name), 'a') UNION SELECT r_name FROM region WHERE contains(lower(r_name), 'a')")
def found_codes(spark, d):
    return classify.find_codes(_tree(spark, d), "A").select("code")


@query("""WITH n AS (SELECT n_name AS name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT name, CASE WHEN length(name) % 2 = 0 THEN name WHEN length(name) % 3 = 0 THEN '' ELSE r_name END AS code,
  CASE WHEN length(name) % 2 = 0 THEN 2 WHEN length(name) % 3 = 0 THEN 0 ELSE 1 END AS steps FROM n""")
def descent(spark, d):
    """A model led down a tree of codes; it stops where it is not sure (a stub that knows the regions)."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")

    def model(asked):
        told = [(name.split("/"), code) for name, code in asked]
        return [(top if not code else name, 0.9 if (code and len(name) % 2 == 0) or (not code and (len(name) % 2 == 0 or len(name) % 3)) else 0.5) for (top, name), code in told]

    named = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat("r_name", F.lit("/"), "n_name").alias("name"))
    return descend(named, _tree(spark, d), model).select(F.substring_index("name", "/", -1).alias("name"), "code", "steps")


@query("""WITH p AS (SELECT p_partkey AS id, p_brand AS a, p_type AS b, p_size AS c, p_partkey % 5 AS k FROM part) SELECT id, CASE k WHEN 0 THEN '' WHEN 1 THEN a WHEN 2 THEN concat_ws('/', a, b) ELSE concat_ws('/', a, b, c) END AS code,
  CASE WHEN k < 3 THEN k ELSE 3 END AS steps, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 ELSE 0.85 END::DOUBLE AS confidence FROM p""")
def item_descent(spark, d):
    """All parts led down a tree of brand, type and size; the stub reads the names and is unsure where a part's number tells so."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_size")
    steps = [p.select(F.concat_ws("/", *c).alias("code"), F.concat_ws("/", *c[:-1]).alias("parent_code")).distinct() for c in (["p_brand"], ["p_brand", "p_type"], ["p_brand", "p_type", "p_size"])]

    def model(asked):
        out = []
        for name, code in asked:
            number, *path = name.split("|")
            at = len(code.split("/")) if code else 0
            out.append(("/".join(path[: at + 1]), 0.95 - 0.05 * at if int(number) % 5 > at else 0.3))
        return out

    named = p.select("id", F.concat_ws("|", "id", "p_brand", "p_type", "p_size").alias("name"))
    told = descend(named, steps[0].unionByName(steps[1]).unionByName(steps[2]), model)
    return named.join(told, "name").select("id", "code", "steps", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {ITEMS}, b AS (SELECT lower(trim(name)) AS k, arg_max(id, (price, -id)) AS benchmark_id, arg_max(category, (price, -id)) AS category FROM items WHERE id % 4 = 0 GROUP BY 1)
  SELECT i.id, CASE WHEN b.k IS NULL THEN {categorized_sql('i.name')} ELSE b.category END AS category, CASE WHEN b.k IS NULL THEN {normalized_sql('i.name')} ELSE 'bench ' || b.benchmark_id END AS normalized_name, b.k IS NOT NULL AS by_benchmark
  FROM items i LEFT JOIN b ON lower(trim(i.name)) = b.k""")
def benchmark_first(spark, d):
    """Names that a benchmark has take its words; the others are normalised by rule."""
    i = items(spark, d)
    bench = i.filter("id % 4 = 0").select(F.col("name").alias("original_name"), F.concat(F.lit("bench "), "id").alias("normalized_name"), "category", F.col("price").alias("quality"), (-F.col("id")).alias("usage"))
    out = pipelines.benchmark_first(i.select("id", "name"), bench, lambda c: names.categorize(c, CATEGORIES, OTHER), names.normalize_name)
    return out.select("id", "category", "normalized_name", "by_benchmark")


@query(f"""WITH {NORMALIZED}, v AS (SELECT id, unnest(list_filter(['require_kpved_code', 'processing_level'], lambda r: (r = 'require_kpved_code' AND kpved_code = '') OR (r = 'processing_level' AND processing_level = 'enhanced'))) AS rule FROM normalized)
  SELECT rule, count(*) AS n, count(DISTINCT id) AS items FROM v GROUP BY 1""")
def table_violations(spark, d):
    """Violations of two rules over a table with other column names."""
    other = normalized(spark, d).select(F.col("id").alias("nr"), F.col("normalized_name").alias("title"), F.col("kpved_code").alias("okpd"), F.col("processing_level").alias("state"))
    v = pipelines.table_violations(other, "nr", {"normalized_name": "title", "kpved_code": "okpd", "processing_level": "state"}, [r for r in quality.default_rules() if r.name in ("require_kpved_code", "processing_level")])
    return v.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("nr").alias("items"))


@query(f"""WITH {NORMALIZED}, s AS (SELECT id, CASE WHEN kpved_code = '' THEN 'high' ELSE 'medium' END AS priority, CASE WHEN kpved_code = '' THEN 0.8 ELSE 0.6 END AS c, CASE WHEN kpved_code = '' THEN 0.15 * 1.3 ELSE 0.03 END AS b FROM normalized WHERE kpved_code IN ('', '4690'))
  SELECT id, round((CASE priority WHEN 'high' THEN 3 ELSE 2 END + c)::DOUBLE, 6) AS rank, round(least(b * c, 1 - 0.9)::DOUBLE, 6) AS impact FROM s""")
def ranked_suggestions(spark, d):
    """Rank and impact of what can be done about missing and wrong codes."""
    n = normalized(spark, d).filter("kpved_code in ('', '4690')")
    missing = F.col("kpved_code") == ""
    priority, kind, sure = F.when(missing, "high").otherwise("medium"), F.when(missing, "reprocess").otherwise("correct_format"), F.when(missing, 0.8).otherwise(0.6)
    return n.select("id", F.round(quality.suggestion_rank(priority, sure), 6).alias("rank"), F.round(quality.suggestion_impact(kind, priority, sure, F.lit(0.9)), 6).alias("impact"))
