"""Classification: keywords, goods or services, code trees, category paths, models plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.functions import dictionaries as D
from lodewright.functions.text import any_contains, ascii_edges, squeeze

# Root word, code and confidence of known goods.
KEYWORDS = [
    ("болт", "25.93.11", 0.98),
    ("винт", "25.93.11", 0.98),
    ("гайка", "25.93.11", 0.98),
    ("шайба", "25.93.11", 0.98),
    ("саморез", "25.93.11", 0.97),
    ("заклепка", "25.93.11", 0.96),
    ("ключ", "25.73.11", 0.95),
    ("сверло", "25.99.12", 0.97),
    ("фреза", "25.99.12", 0.96),
    ("коронка", "25.99.12", 0.95),
    ("подшипник", "28.15.32", 0.99),
    ("панель", "23.69.19", 0.9),
    ("уголок", "24.10.73", 0.96),
    ("арматура", "24.10.11", 0.94),
    ("автомат", "27.11.21", 0.94),
    ("кабель", "27.32.11", 0.98),
    ("контрольный", "27.32.11", 0.95),
    ("муфта", "28.14.11", 0.95),
    ("тройник", "28.14.11", 0.96),
    ("пневмоцилиндр", "28.13.11", 0.98),
    ("редуктор", "28.15.11", 0.97),
    ("фильтр", "28.29.11", 0.95),
    ("сальник", "28.29.12", 0.96),
    ("лоток", "25.99.19", 0.9),
    ("фасонные", "25.11.11", 0.95),
    ("isopan", "25.11.11", 0.95),
    ("изопан", "25.11.11", 0.95),
    ("элемент", "25.11.11", 0.9),
    ("isowall", "25.11.11", 0.98),
    ("сэндвич", "25.11.11", 0.98),
    ("sandwich", "25.11.11", 0.98),
    ("преобразователь", "26.51.52", 0.98),
    ("датчик", "26.51.52", 0.98),
]
# Phrases that decide before single words, in order.
PHRASES = [
    ("сэндвич панель", "сэндвич"), ("сэндвич-панель", "сэндвич"), ("sandwich panel", "sandwich"), ("панель сэндвич", "сэндвич"),
    ("фасонные элементы", "фасонные"), ("преобразователь давления", "преобразователь"), ("датчик давления", "датчик"),
    ("контрольный кабель", "контрольный"), ("кабель контрольный", "кабель"),
]
SANDWICH = ["сэндвич", "isowall", "sandwich", "isopan", "изопан", "isofire"]
# Noise that is taken out before the root word is looked for.
NOISE = [
    r"\b(арт\.?|art\.?|№)\s*[a-zA-Z0-9.-]+\b", r"\b\d+[xх]\d+", r"\b\d+[.,]\d+\b", r"\b\d*[.,]?\d+\s*(мм|см|м|kg|кг|g|г)\b",
    r"[^a-zA-Zа-яА-Я0-9\s]", r"\b(din|iso|ral)\s*[a-zA-Z0-9]*\b", r"\b(не использовать|not use)\b",
]


def clean_name(name: Column) -> Column:
    return F.lower(squeeze(reduce(lambda c, p: F.regexp_replace(c, ascii_edges(p), " "), NOISE, name)))


def root_word(clean: Column, words: list[str], phrases: list[tuple[str, str]] = PHRASES) -> Column:
    """The word that names the thing, of a name as ``clean_name`` leaves it: of a
    phrase, else the longest known word (in bytes; the first of equals), else the
    first word."""
    each = F.split(clean, " ")
    known = F.filter(each, lambda w: w.isin(words))
    longest = F.aggregate(known, F.lit(""), lambda a, w: F.when(F.octet_length(w) > F.octet_length(a), w).otherwise(a))
    phrase = F.coalesce(*[F.when(clean.contains(p), F.lit(k)) for p, k in phrases if k in words], F.lit(""))
    return F.when(phrase != "", phrase).when(longest != "", longest).otherwise(F.get(each, F.lit(0)))


def product_kind(clean: Column) -> Column:
    """The kind of thing, of a name as ``clean_name`` leaves it."""
    has = lambda *ws: any_contains(clean, list(ws))
    return (
        F.when(has(*SANDWICH), "sandwich_panel")
        .when(has("фасонные") | has("элемент") & has("панель", "строитель", "конструкц"), "construction")
        .when(has("преобразователь", "датчик") & has("давлен", "температур", "уровен", "расход"), "sensor")
        .when(has("кабель", "провод"), "cable")
        .when(has("болт", "винт", "гайка", "саморез"), "fastener")
        .when(has("ключ", "сверло", "фреза", "инструмент"), "tool")
        .when(has("панель", "профиль"), "construction")
        .otherwise("unknown")
    )


def classify_by_keyword(items: DataFrame, name: str = "normalized_name", entries: list[tuple[str, str, float]] | None = None, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """``items`` plus root, kind, code and confidence; null code where no keyword fits.

    The dictionary is a fixed list of some dozens, so it is broadcast.
    """
    entries = entries or KEYWORDS
    words = F.broadcast(items.sparkSession.createDataFrame(entries, "root string, code string, confidence double"))
    # each distinct name is cleaned once, and a few names are dealt over all tasks, as they are much work for their
    # bytes; long expressions stay in projections of their own
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = items.select(F.col(name).alias("_name")).distinct().repartition(tasks, "_name").withColumn("_clean", clean_name(F.col("_name")))
    told = once.select("_name", root_word(F.col("_clean"), [e[0] for e in entries], phrases).alias("root"), product_kind(F.col("_clean")).alias("kind"))
    joined = told.join(words, "root", "left")
    panel = (F.col("kind") == "sandwich_panel") & F.col("root").isin("панель", "isowall", "сэндвич", "sandwich", "isopan")
    sure = (
        F.when(F.col("code").isNull(), None)
        .when(panel, 0.98)
        .when((F.col("kind") == "construction") & F.col("root").isin("фасонные", "элемент", "панель"), 0.95)
        .when((F.col("kind") == "sensor") & F.col("root").isin("преобразователь", "датчик"), 0.98)
        .when((F.col("kind") == "cable") & F.col("root").isin("кабель", "контрольный"), 0.98)
        .otherwise(F.col("confidence"))
    )
    found = joined.withColumn("confidence", sure).withColumn("code", F.when(panel & (F.col("root") == "панель"), "25.11.11").otherwise(F.col("code")))
    return items.join(found, F.col(name).eqNullSafe(F.col("_name")), "left").drop("_name")


def learned_keywords(results: DataFrame, least: float = 0.8) -> DataFrame:
    """New dictionary rows from confident results (root, code, confidence): the most frequent code of each root."""
    good = results.filter(F.col("confidence") >= least).groupBy("root", "code").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
    return good.groupBy("root").agg(F.max_by("code", F.struct("n", "code")).alias("code"), F.max_by("confidence", F.struct("n", "code")).alias("confidence"), F.sum("n").alias("uses"))


def product_or_service(text: Column, product_signs: list[str] = D.PRODUCT_SIGNS, service_signs: list[str] = D.SERVICE_SIGNS, product_words: list[str] = D.PRODUCT_WORDS, service_words: list[str] = D.SERVICE_WORDS, traits: list[str] = D.PRODUCT_TRAITS) -> Column:
    """Struct of kind (product, service, unknown), confidence and both scores: 1.5
    for a sign, 0.5 for a word, 1 for any technical trait."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def score(signs: list[str], words: list[str]) -> Column:
        hits = [F.when(low.rlike(ascii_edges(s)), 1.5).otherwise(0.0) for s in signs] + [F.when(low.contains(w), 0.5).otherwise(0.0) for w in words]
        return reduce(lambda a, b: a + b, hits, F.lit(0.0))

    trait = reduce(lambda a, b: a | b, (low.rlike(ascii_edges(t)) for t in traits), F.lit(False))
    goods, service = score(product_signs, product_words) + F.when(trait, 1.0).otherwise(0.0), score(service_signs, service_words)
    best, other = F.greatest(goods, service), F.least(goods, service)
    sure = F.greatest(F.lit(0.6), F.least(F.lit(0.95), 0.6 + (best - other) / (best + 1) * 0.35))
    kind = F.when(goods > service, "product").when(service > goods, "service").otherwise("unknown")
    return F.struct(kind.alias("kind"), F.when(goods == service, 0.5).otherwise(sure).alias("confidence"), goods.alias("product_score"), service.alias("service_score"))


# ---------------------------------------------------------------- category paths

SEPARATOR = " / "


def fold_path(path: Column, depth: int = 2, strategy: str = "top") -> Column:
    """A longer path folded to ``depth`` levels. ``top`` keeps the first levels
    and joins the rest, ``bottom`` keeps the last and joins the first, ``mixed``
    keeps the first and joins the rest into the last (levels between are empty)."""
    n = F.size(path)
    if strategy.startswith("bottom"):
        folded = F.concat(F.array(F.array_join(F.slice(path, 1, n - depth + 1), SEPARATOR)), F.slice(path, n - depth + 2, depth - 1) if depth > 1 else F.array().cast("array<string>"))
    elif strategy.startswith("mixed"):
        rest = F.array_join(F.slice(path, 2, n), SEPARATOR)
        folded = F.concat(F.slice(path, 1, 1), F.array_repeat(F.lit(""), depth - 2), F.array(rest)) if depth > 1 else F.array(F.array_join(path, SEPARATOR))
    else:
        folded = F.concat(F.slice(path, 1, depth - 1), F.array(F.array_join(F.slice(path, depth, n), SEPARATOR)))
    return F.when(n <= depth, path).otherwise(folded)


@dataclass(frozen=True)
class FoldRule:
    """Levels ``source`` (those that exist) joined into level ``target``."""

    source: list[int]
    target: int
    separator: str = SEPARATOR


@dataclass(frozen=True)
class FoldStrategy:
    """Levels by priority (0: first, -1: last, -2: last but one), then rules that replace some."""

    name: str
    depth: int
    priority: list[str]
    rules: list[FoldRule] = field(default_factory=list)

    def fold(self, path: Column) -> Column:
        n = F.size(path)
        at = {"0": F.lit(0), "-1": n - 1, "-2": F.when(n > 1, n - 2).otherwise(0)}
        levels = [F.get(path, at[p]) if (p := self.priority[i] if i < len(self.priority) else "") in at else F.lit("") for i in range(self.depth)]
        for r in self.rules:
            if 0 <= r.target < self.depth:
                levels[r.target] = F.array_join(F.array_compact(F.array(*[F.get(path, F.lit(s)) for s in r.source])), r.separator)
        filled = [F.when(F.coalesce(c, F.lit("")) == "", F.coalesce(F.get(path, F.lit(i)), F.lit(""))).otherwise(c) for i, c in enumerate(levels)]
        return F.when(n <= self.depth, path).otherwise(F.array(*filled))


#: Strategies by name; more can be added.
STRATEGIES = {
    "top_priority": FoldStrategy("top_priority", 2, ["0", "-1"], [FoldRule([2, 3, 4], 1)]),
    "bottom_priority": FoldStrategy("bottom_priority", 2, ["0", "-1"], [FoldRule([0, 1, 2, 3], 0)]),
    "mixed_priority": FoldStrategy("mixed_priority", 2, ["0", "-1"]),
}


def fold_category(path: Column, strategy: str) -> Column:
    """By a named strategy; an unknown one folds to two levels from the top."""
    return STRATEGIES[strategy].fold(path) if strategy in STRATEGIES else fold_path(path, 2, "top")


# ---------------------------------------------------------------- code trees


def tree_level(code: Column) -> Column:
    """0 for a section letter, 1 for two digits, one more for each dot."""
    return F.when(code.rlike("^[A-Z]$"), 0).when(F.length(code) == 2, 1).otherwise(1 + F.length(code) - F.length(F.replace(code, F.lit("."), F.lit("")))).cast("int")


def tree_parent(code: Column, section: Column) -> Column:
    """``section`` for a class; else the code without its last digit group, or without that group's last digit if it has two."""
    head = F.regexp_extract(code, r"^(.*)\.[^.]*$", 1)
    last = F.substring_index(code, ".", -1)
    below = F.when(F.length(last) == 2, F.concat(head, F.lit("."), F.substring(last, 1, 1))).otherwise(head)
    return F.when(code.rlike("^[A-Z]$"), "").when(F.length(code) == 2, F.coalesce(section, F.lit(""))).when(~code.contains("."), "").otherwise(below)


def tree_children(tree: DataFrame, parent: str | None = None) -> DataFrame:
    """Nodes (code, name, level) below ``parent`` (None: the top level) with ``has_children`` and the number of children."""
    counts = tree.filter("parent_code <> ''").groupBy(F.col("parent_code").alias("code")).agg(F.count("*").alias("children"))
    picked = tree.filter(F.col("level") == 0) if parent is None else tree.filter(F.col("parent_code") == parent)
    joined = picked.join(counts, "code", "left")
    return joined.select("code", "name", "level", F.coalesce("children", F.lit(0)).alias("children"), F.col("children").isNotNull().alias("has_children"))


def tree_paths(tree: DataFrame, depth: int = 6) -> DataFrame:
    """(code, path): codes from the top down to each node, by ``depth`` joins at most."""
    paths = tree.select("code", F.col("parent_code").alias("up"), F.array("code").alias("path"))
    parents = tree.select(F.col("code").alias("up"), F.col("parent_code").alias("next"))
    for _ in range(depth - 1):
        paths = paths.join(parents, "up", "left").select("code", F.coalesce("next", F.lit("")).alias("up"), F.when(F.col("next").isNull(), F.col("path")).otherwise(F.array_prepend("path", F.col("up"))).alias("path"))
    return paths.select("code", "path")


def with_model(items: DataFrame, name: str, model: Callable[[list[str]], list[tuple[str, float]]], batch: int = 64) -> DataFrame:
    """``items`` plus code and confidence by a model over distinct names, each asked once, in batches.

    ``model`` takes names and gives (code, confidence) for each; it may call a
    service, with its own retries and limits.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            asked = f["_name"].tolist()
            got = [x for i in range(0, len(asked), batch) for x in model(asked[i : i + batch])]
            yield pd.DataFrame({"_name": asked, "code": [g[0] for g in got], "confidence": [float(g[1]) for g in got]})

    once = items.select(F.col(name).alias("_name")).filter("_name is not null").distinct()
    told = once.mapInPandas(run, "_name string, code string, confidence double")
    return items.join(told, F.col(name) == F.col("_name"), "left").drop("_name")


def reset_classification(items: DataFrame, where: Column, status: str | None = None) -> DataFrame:
    """Codes of the rows ``where`` emptied; with ``status`` they are only marked with it."""
    if status is not None:
        return items.withColumn("validation_status", F.when(where, status).otherwise(F.col("validation_status")))
    empty = {"kpved_code": F.lit(""), "kpved_name": F.lit(""), "kpved_confidence": F.lit(0.0)}
    return items.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in empty.items()})


# ---------------------------------------------------------------- gates, mending, levels

#: Name parts that show goods besides those of ``PRODUCT_WORDS``.
TOOL_WORDS = ["ключ", "сверло", "фреза", "коронка", "инструмент"]
#: Units, sizes and codes that make a name technical, as parts of the lowered name.
TECHNICAL_PARTS = ["мм", "см", "м", "л", "кг", "г", "вт", "в", "а", "мл", "км", "т", "x", "х", "арт", "код"]
#: Codes of services among the codes of goods, and parts of names that show services.
SERVICE_CODES = ["71.20.1", "71.20.11", "71.20.12", "71.20.13", "71.20.14", "71.20.19", "96.09.1", "96.09.11", "96.09.12", "96.09.13", "96.09.19"]
SERVICE_NAMES = ["услуг", "работ", "обслуживание", "монтаж", "установка", "ремонт", "проектирование", "консультация", "испытание", "анализ", "исследование"]
#: The code of things that fit nowhere, and mistakes: part of the name, wrong code, part of its title, right code, part of its title.
REST_CODE = "32.99.5"
MISTAKES = [
    (["кабель"], "26.12.1", "плат", "27.32.11", "кабел"),
    (["датчик", "преобразователь"], "71.20.1", "испытан", "26.51.52", "прибор"),
    (["фасонные"], "96.09.1", "услуг", "25.11.11", "конструкц"),
]


def likely_product(name: Column, root: Column, known: list[str]) -> Column:
    """Whether a name is one of goods: its root word is known, or it has a telling part or a technical trait."""
    low = F.lower(F.coalesce(name, F.lit("")))
    trait = reduce(lambda a, b: a | b, (low.rlike(ascii_edges(t)) for t in D.PRODUCT_TRAITS))
    return F.coalesce(root.isin(known), F.lit(False)) | any_contains(low, D.PRODUCT_WORDS + TOOL_WORDS) | trait


def requires_model(name: Column, category: Column, other: str = D.OTHER) -> Column:
    """Whether rules are not enough for a name: an open category, many bytes or words, many digits or signs, technical parts."""
    text = F.coalesce(name, F.lit(""))
    n = F.length(text)
    share = lambda p: F.length(F.regexp_replace(text, p, "")) / n
    odd = F.when(n > 0, (share(r"\P{Nd}") > 0.3) | (share(r"[\p{L}\p{Nd}\s]") > 0.1)).otherwise(False)
    words = F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(squeeze(text), " ")))
    return F.coalesce(category == other, F.lit(False)) | (F.octet_length(text) > 50) | (words > 5) | odd | any_contains(F.lower(text), TECHNICAL_PARTS)


def is_service_code(code: Column, title: Column | None = None) -> Column:
    """Whether a code is one of services: class 33 to 99, a listed code or one below it, or a title that tells so."""
    section = F.regexp_extract(code, r"^(\d{2,9})", 1).try_cast("int")
    listed = code.isin(SERVICE_CODES) | reduce(lambda a, b: a | b, (code.startswith(c + ".") for c in SERVICE_CODES))
    told = any_contains(F.lower(F.coalesce(title, F.lit(""))), SERVICE_NAMES) if title is not None else F.lit(False)
    return F.coalesce((F.length(code) >= 2) & (F.coalesce(section.between(33, 99), F.lit(False)) | listed | told), F.lit(False))


def mend(name: Column, code: Column, title: Column, confidence: Column, word_code: Column, word_title: Column, word_confidence: Column, product: Column) -> Column:
    """Struct of code, title, confidence and what was done, after a model's
    answer was held against that of the keywords (null code: none). The checks
    run in order: goods under a code of services, goods under the code of the
    rest, then known mistakes."""
    low = F.lower(F.coalesce(name, F.lit("")))
    own = F.coalesce(title, F.lit(""))
    other = F.coalesce(word_title, F.lit(""))
    known = word_code.isNotNull()
    taken = lambda why: F.struct(word_code.alias("code"), word_title.alias("title"), word_confidence.alias("confidence"), F.lit(why).alias("mended"))
    service = product & is_service_code(code, title)
    out = F.when(service & known & ~is_service_code(word_code, word_title), taken("service"))
    out = out.when(service, F.struct(code.alias("code"), title.alias("title"), (confidence * 0.5).alias("confidence"), F.lit("doubtful").alias("mended")))
    out = out.when(((code == REST_CODE) | own.contains("прочие")) & product & known & (word_code != REST_CODE) & ~other.contains("прочие"), taken("rest"))
    for parts, wrong, wrong_title, right, right_title in MISTAKES:
        out = out.when(any_contains(low, parts) & ((code == wrong) | own.contains(wrong_title)) & known & ((word_code == right) | other.contains(right_title)), taken("mistake"))
    return out.otherwise(F.struct(code.alias("code"), title.alias("title"), confidence.alias("confidence"), F.lit("").alias("mended")))


def existing_paths(paths: DataFrame, tree_paths: DataFrame, key: str = "path") -> DataFrame:
    """The rows whose path is in the tree."""
    return paths.join(tree_paths.select(key).distinct(), key, "left_semi")


def find_codes(tree: DataFrame, text: str) -> DataFrame:
    """Nodes whose code starts with the text or whose name contains it, in any case."""
    low = text.lower()
    return tree.filter(F.lower("code").startswith(low) | F.lower("name").contains(low))


def with_levels(items: DataFrame, path: Column, depth: int = 5, strategy: str = "top") -> DataFrame:
    """``items`` with category_level1 to ``depth`` from a path folded by the strategy; missing levels are empty."""
    folded = fold_path(path, depth, strategy)
    told = items.withColumn("_folded", folded)
    return told.withColumns({f"category_level{i + 1}": F.coalesce(F.get("_folded", F.lit(i)), F.lit("")) for i in range(depth)}).drop("_folded")


def reclassify(items: DataFrame, name: str = "normalized_name", where: Column | None = None, entries: list[tuple[str, str, float]] | None = None, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """A new version of ``items`` (kpved_code, kpved_confidence): rows ``where``
    (default: without a code) get the keywords' answer where there is one, others
    keep their code; ``reclassified`` tells which. A null condition is none, and
    all other columns stay, whatever their names."""
    where = F.coalesce(F.col("kpved_code"), F.lit("")) == "" if where is None else where
    marked = items.withColumn("_where", F.coalesce(where, F.lit(False)))
    once = items.select(F.col(name).alias("_asked")).distinct()
    answers = classify_by_keyword(once, "_asked", entries, phrases).select("_asked", F.col("code").alias("_found"), F.col("confidence").alias("_sure"))
    told = marked.join(answers, F.col(name).eqNullSafe(F.col("_asked")), "left")
    new = F.col("_where") & F.col("_found").isNotNull()
    own = [F.when(new, F.col(f)).otherwise(F.col(c)).alias(c) if (f := {"kpved_code": "_found", "kpved_confidence": "_sure"}.get(c)) else F.col(c) for c in items.columns if c != "reclassified"]
    return told.select(*own, new.alias("reclassified"))
