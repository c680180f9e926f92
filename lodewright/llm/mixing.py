"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the output over its share of
the input. Each document is emitted as often as a Poisson variable with that
mean says; the variable comes from inverting the distribution at a uniform
number hashed from seed and document, so any rerun gives the same copies. The
copies are then dealt over all partitions in the order of another hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P, partitions, staged, table

#: Seed of all hashes.
SEED = 17
#: Without weights a source's share is proportional to its documents to this power.
TEMPERATURE = 0.5
#: A rate above this is a sum of several Poisson variables, as exp(-rate) would underflow.
PART = 256.0
#: Rates of up to so many sources are broadcast; beyond it they are joined by source, large sources in splits.
BROADCAST_SOURCES = 10_000
#: exp as Java and C++ round it may differ in the last place; rates are cut to so many places first.
PLACES = 9


def _uniform(*parts: Column) -> Column:
    """In [0, 1), from 52 bits of an MD5 sum."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def shuffle_key(*parts: Column) -> Column:
    """60 bits of an MD5 sum, as a long."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float, source: str) -> DataFrame:
    """(src, n, rate, parts, cdf): documents of each source, their mean copies, and
    the cumulative distribution of a Poisson variable with mean rate / parts.

    ``weights`` are relative; a source that they lack gets no copies.
    """
    counts = docs.groupBy(F.col(f"`{source}`").alias("src")).agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow("n", F.lit(TEMPERATURE)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()) or [("", 0.0)], "src string, w double")
        weighed = counts.join(F.broadcast(given), "src", "left").fillna(0.0, ["w"])
    totals = weighed.agg(F.sum("n"), F.sum("w")).first()
    scale = epochs * (totals[0] or 0.0) / totals[1] if totals[1] else 0.0
    rate = F.round(F.col("w") * scale / F.col("n"), PLACES)
    mean = F.col("rate") / F.col("parts")
    out = weighed.select("src", "n", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    out = out.withColumn("r", mean).withColumn("last", F.ceil(F.col("r") + 12 * F.sqrt("r") + 30).cast("int"))
    cdf = F.expr(
        "aggregate(sequence(1, last), named_struct('t', exp(-r), 'c', exp(-r), 'l', array(exp(-r))),"
        " (a, k) -> named_struct('t', a.t * r / k, 'c', a.c + a.t * r / k, 'l', array_append(a.l, a.c + a.t * r / k)), a -> a.l)"
    )
    return out.select("src", "n", "rate", "parts", cdf.alias("cdf"))


def _joined(docs: DataFrame, rates: DataFrame, source: Column, key: Column, most: int) -> DataFrame:
    """``docs`` with their source's ``rates`` (src, n, ...), broadcast up to ``most`` sources."""
    spark = docs.sparkSession
    src, salt = F.col(f"{P}src"), f"{P}salt"
    held = rates.drop("n").limit(most + 1).collect()
    if len(held) <= most:
        return docs.join(F.broadcast(spark.createDataFrame(held, rates.drop("n").schema)), source.eqNullSafe(src), "inner").drop(src)
    p = partitions(spark)
    total = rates.agg(F.sum("n")).first()[0]
    # at most 4 * p sources are larger than that
    large = rates.filter(F.col("n") > total / (4 * p)).select(src, F.ceil(F.col("n") * 4 * p / total).cast("int").alias(f"{P}of"))
    large = F.broadcast(spark.createDataFrame(large.collect(), large.schema))
    salted = docs.join(large, source.eqNullSafe(src), "left").drop(src).withColumn(salt, F.pmod(F.xxhash64(key), F.coalesce(f"{P}of", F.lit(1))).cast("int")).drop(f"{P}of")
    of = large.withColumnRenamed(f"{P}src", f"{P}big")
    copies = rates.drop("n").join(of, src.eqNullSafe(F.col(f"{P}big")), "left").withColumn(f"{P}at", F.explode(F.sequence(F.lit(0), F.coalesce(f"{P}of", F.lit(1)) - 1))).drop(f"{P}of", f"{P}big")
    return salted.join(copies, source.eqNullSafe(src) & (F.col(salt) == F.col(f"{P}at")), "inner").drop(f"{P}src", f"{P}at", salt)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, source: str = "source", ident: str = "doc_id", seed: int = SEED, most: int = BROADCAST_SOURCES) -> DataFrame:
    """Every copy of every document: the columns of ``docs`` plus ``rate``,
    ``copies``, ``copy`` (from 0) and ``shuffle_key``, in global order of
    ``shuffle_key``: partitions hold rising ranges of it and are sorted.

    The expected number of rows is ``epochs`` times that of ``docs``. A null
    source is a source like the others. Rows of null id draw each for itself:
    they are written once with a number of their own, which stands for the id.
    Repeated rows of one id draw the same number of copies, each its own. An
    empty table gives no rows. Of input columns named like a new one the new
    one wins.
    """
    spark = docs.sparkSession
    new = ("rate", "copies", "copy", "shuffle_key")
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    rates = source_rates(docs, weights, epochs, source).select(F.col("src").alias(f"{P}src"), "n", "rate", F.col("parts").alias(f"{P}parts"), F.col("cdf").alias(f"{P}cdf"))
    given, key = F.col(f"`{ident}`"), F.col(f"{P}key")
    numbered = staged(docs.filter(given.isNull()).withColumn(f"{P}key", F.concat(F.lit("null "), F.monotonically_increasing_id())), "null-ids")
    docs = docs.filter(given.isNotNull()).withColumn(f"{P}key", given.cast("string")).unionByName(numbered)
    joined = _joined(docs, rates, F.col(f"`{source}`"), key, most)
    drawn = F.transform(F.sequence(F.lit(1), F.col(f"{P}parts")), lambda p: F.size(F.filter(F.col(f"{P}cdf"), lambda c: c <= _uniform(F.lit(seed), key, p))))
    # the draw of the usual single part stays outside a lambda, so that its hash is taken once
    one = joined.withColumn(f"{P}u", _uniform(F.lit(seed), key, F.lit(1)))
    copies = F.when(F.col(f"{P}parts") == 1, F.size(F.filter(F.col(f"{P}cdf"), lambda c: c <= F.col(f"{P}u")))).otherwise(F.aggregate(drawn, F.lit(0), lambda a, b: a + b))
    counted = one.withColumn("copies", copies.cast("int")).filter("copies > 0").drop(f"{P}parts", f"{P}cdf", f"{P}u")
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    keyed = each.withColumn("shuffle_key", shuffle_key(F.lit(seed), key, F.lit("copy"), F.col("copy"))).drop(f"{P}key")
    n = partitions(spark)
    width = math.ceil((1 << 60) / n)
    dealt = keyed.repartitionById(n, F.expr(f"cast(shuffle_key div {width} as int)"))
    return dealt.sortWithinPartitions("shuffle_key", f"`{ident}`", "copy")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, shares of the sources proportional to the square root of their documents."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.round("rate", 6).alias("rate"), "copies", "copy", "shuffle_key")


OP5_SQL = """
WITH c AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) / sum(sqrt(n)) AS scale FROM c),
r AS (SELECT source, round(sqrt(n) * scale / n, 9) AS rate FROM c, t),
f AS (SELECT source, rate, k, sum(exp(-rate) * rate ** k / factorial(k::INT)) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM r, (SELECT unnest(range(30)) AS k)),
a AS (SELECT source, any_value(rate) AS rate, list(cdf) AS cdf FROM f GROUP BY source),
d AS (SELECT doc_id, d.source, rate, cdf,
        ('0x' || substr(md5('17:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0 AS u
      FROM documents d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
n AS (SELECT doc_id, source, rate, len(list_filter(cdf, lambda x: x <= u))::INT AS copies FROM d)
SELECT doc_id, source, round(rate, 6) AS rate, copies, copy::INT AS copy,
       ('0x' || substr(md5('17:' || doc_id || ':copy:' || copy), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(copies)) AS copy FROM n)
"""
