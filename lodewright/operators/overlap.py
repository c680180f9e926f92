"""Groups of items by common words, their links and scores, without a row per pair.

Two sets of words have ``least`` words in common if they share a subset of so
many, so items are linked with the first one that has the same subset. How
many pairs of a group have exactly j words in common follows from how many
items have each subset of words, by inclusion and exclusion. Items of very many
shared words would have too many subsets; their pairs are counted one by one.
Words and subsets are many times the items whose size Spark knows, so joins of
them say themselves that they are by shuffle.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import written

#: Items of more words that others have too are compared pair by pair: others have at most 2 ** WORDS subsets.
WORDS = 10


def shared_sets(items: DataFrame, tokens: Column) -> DataFrame:
    """(id, words, size) of items (id): the words that two items or more have, in
    order, and how many words the item has in all; items without words are left out."""
    sets = written(items.select("id", F.array_distinct(tokens).alias("set")).filter(F.size("set") > 0), "sets")
    each = sets.select("id", F.explode("set").alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").select("word")
    kept = each.join(often.hint("merge"), "word").groupBy("id").agg(F.array_sort(F.collect_list("word")).alias("words"))
    told = sets.select("id", F.size("set").alias("size")).join(kept, "id", "left")
    return told.select("id", F.coalesce("words", F.array().cast("array<string>")).alias("words"), "size")


def classes(shared: DataFrame, *by: str) -> DataFrame:
    """Rows of ``shared_sets`` with equal words and size (and ``by``) as one, with the smallest id and their number ``m``."""
    return shared.groupBy(*by, "words", "size").agg(F.min("id").alias("id"), F.count("*").alias("m"))


def subsets(words: Column, least: int, most: int, kind: str = "string") -> Column:
    """All subsets of ``least`` to ``most`` words (of the type ``kind``), each in the order of the array."""
    start = F.array(F.array().cast(f"array<{kind}>"))
    grown = F.aggregate(words, start, lambda a, w: F.concat(a, F.transform(F.filter(a, lambda s: F.size(s) < most), lambda s: F.array_append(s, w))))
    return F.filter(grown, lambda s: F.size(s) >= least)


def _long_pairs(rows: DataFrame, *by: str) -> DataFrame:
    """(by, a, b, j, a_size, b_size, pairs): the pairs of classes of which one has
    too many words for subsets, by common words; each once."""
    long = rows.filter(F.size("words") > WORDS)
    one = long.select(*by, F.col("id").alias("a"), F.col("size").alias("a_size"), F.col("m").alias("a_m"), F.explode("words").alias("word"))
    other = rows.select(*by, F.col("id").alias("b"), F.col("size").alias("b_size"), F.col("m").alias("b_m"), (F.size("words") > WORDS).alias("b_long"), F.explode("words").alias("word"))
    met = one.join(other.hint("merge"), [*by, "word"]).filter("a <> b and (not b_long or a < b)")
    between = met.groupBy(*by, "a", "b", "a_size", "b_size", "a_m", "b_m").agg(F.count("*").alias("j")).select(*by, "a", "b", "j", "a_size", "b_size", (F.col("a_m") * F.col("b_m")).alias("pairs"))
    inside = long.filter("m > 1").select(*by, F.col("id").alias("a"), F.col("id").alias("b"), F.size("words").cast("long").alias("j"), F.col("size").alias("a_size"), F.col("size").alias("b_size"), F.expr("m * (m - 1) div 2").alias("pairs"))
    return between.unionByName(inside)


def star_links(shared: DataFrame, least: int) -> DataFrame:
    """(a, b): each item with the first one of its class, and that one with the
    first that has the same ``least`` words. They reach what all pairs with so
    many common words reach."""
    rows = written(classes(shared.filter(F.size("words") >= least)), "classes")
    first = rows.select("words", "size", F.col("id").alias("a"))
    same = shared.join(first.hint("merge"), ["words", "size"]).filter("id <> a").select("a", F.col("id").alias("b"))
    each = rows.filter(F.size("words") <= WORDS) if least > 1 else rows
    keyed = each.select("id", F.explode(subsets(F.col("words"), least, least)).alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").select("key", "a")
    links = keyed.join(hubs.hint("merge"), "key").filter("id <> a").select("a", F.col("id").alias("b"))
    out = same.unionByName(links)
    if least > 1:
        out = out.unionByName(_long_pairs(rows).filter(F.col("j") >= least).filter("a <> b").select("a", "b"))
    return out.distinct()


def common_counts(grouped: DataFrame) -> DataFrame:
    """(group_id, j, a_size, b_size, pairs): how many pairs of items of a group
    (group_id, id, words, size) have exactly j > 0 words in common, by the sizes of their sets."""
    rows = written(classes(grouped, "group_id"), "classes")
    keyed = rows.filter(F.size("words") <= WORDS).select("group_id", "size", "m", F.explode(subsets(F.col("words"), 1, WORDS)).alias("key"))
    having = keyed.groupBy("group_id", "key", "size").agg(F.sum("m").alias("n"))
    by_key = having.groupBy("group_id", "key").agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("sizes"))  # a row for each size of a set
    two = by_key.select("group_id", F.size("key").alias("i"), F.posexplode("sizes").alias("at", "x"), "sizes")
    two = two.select("group_id", "i", "x", F.explode(F.slice("sizes", F.col("at") + 1, F.size("sizes"))).alias("y"))
    n = F.when(F.col("x.size") == F.col("y.size"), F.expr("x.n * (x.n - 1) div 2")).otherwise(F.col("x.n") * F.col("y.n")).cast("decimal(38,0)")
    held = two.groupBy("group_id", "i", F.col("x.size").alias("a_size"), F.col("y.size").alias("b_size")).agg(F.sum(n).alias("s"))
    # pairs with exactly j: those that hold subsets of i >= j words, with the signs and weights of inclusion and exclusion
    signed = held.filter("s > 0").select("group_id", "a_size", "b_size", "i", "s", F.explode(F.sequence(F.lit(1), F.col("i"))).alias("j"))
    binomial = F.create_map(*[F.lit(x) for i in range(1, WORDS + 1) for j in range(1, i + 1) for x in (i * (WORDS + 1) + j, (-1) ** (i - j) * comb(i, j))])
    exact = signed.groupBy("group_id", F.col("j").cast("long").alias("j"), "a_size", "b_size").agg(F.sum(F.col("s") * binomial[F.col("i") * (WORDS + 1) + F.col("j")]).cast("long").alias("pairs")).filter("pairs > 0")
    long = _long_pairs(rows, "group_id").select("group_id", "j", F.least("a_size", "b_size").alias("a_size"), F.greatest("a_size", "b_size").alias("b_size"), "pairs")
    return exact.unionByName(long).groupBy("group_id", "j", "a_size", "b_size").agg(F.sum("pairs").alias("pairs"))


def word_links(grouped: DataFrame, least: int) -> DataFrame:
    """(group_id, links, score): pairs of a group with ``least`` common words, and the sum of their Jaccard similarities."""
    like = F.col("j") / (F.col("a_size") + F.col("b_size") - F.col("j"))
    return common_counts(grouped).filter(F.col("j") >= least).groupBy("group_id").agg(F.sum("pairs").alias("links"), F.sum(F.col("pairs") * like).alias("score"))


def overlap_groups(items: DataFrame, tokens: Column, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """((group_id, id), (group_id, size, links, score, common)) of items (id).

    Groups are what links of ``least`` common words reach. ``links`` counts
    them, ``score`` is the mean Jaccard similarity of all pairs of the group,
    ``common`` the words that all its items have, in order. Items with one and
    the same id are one each, ids should be unique; items without words, or
    without a link, are in no group.
    """
    from .dedup import components

    shared = written(shared_sets(items, tokens), "shared")
    groups = written(components(star_links(shared, least)), "groups").select("group_id", "id")
    grouped = written(groups.join(shared, "id"), "grouped")
    counts = written(common_counts(grouped), "counts")
    like = F.col("j") / (F.col("a_size") + F.col("b_size") - F.col("j"))
    sizes = grouped.groupBy("group_id").agg(F.count("*").alias("size"))
    told = counts.groupBy("group_id").agg(F.sum(F.when(F.col("j") >= least, F.col("pairs"))).alias("links"), F.sum(F.col("pairs") * like).alias("sum"))
    words = grouped.select("group_id", F.explode("words").alias("word")).groupBy("group_id", "word").agg(F.count("*").alias("n"))
    common = words.join(sizes, "group_id").filter("n = size").groupBy("group_id").agg(F.array_sort(F.collect_list("word")).alias("common"))
    score = F.col("sum") / (F.col("size") * (F.col("size") - 1) / 2)
    out = sizes.join(told, "group_id").join(common, "group_id", "left")
    return groups, out.select("group_id", "size", "links", score.alias("score"), F.coalesce("common", F.array().cast("array<string>")).alias("common"))
