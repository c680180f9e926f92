"""Item names: normalisation, attributes, tokens, sounds, transliteration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dictionaries as D
from .text import ascii_edges, squeeze

ARTICLE = r"^[a-zа-я]{2,}\d+[a-zа-я]*\d+\s*"
TECHNICAL = r"\b[A-Z]{2}-\d+\b"
DIMENSION = r"\d+[xх]\d+"
#: What is removed from a lowered name, in this order.
REMOVED = [ARTICLE, TECHNICAL, DIMENSION, rf"\d+\.?\d*(?:{D.UNITS_GLUED})", rf"\d+\.?\d*\s*(?:{D.UNITS_SPACED})", r"\b\d+\b"]
TAIL = r"[^\w\sа-яА-Я]+$"
EDGES = " ,.-+"


def normalize_name(name: Column) -> Column:
    """The name in lower case without codes, sizes, quantities and numbers.

    Codes are searched after lowering, so an upper-case code loses its number
    only; null stays null.
    """
    bare = reduce(lambda c, p: F.regexp_replace(c, ascii_edges(p), ""), REMOVED, F.lower(name))
    return F.btrim(F.regexp_replace(squeeze(bare), TAIL, ""), F.lit(EDGES))


def unit_meaning(unit: Column) -> Column:
    """What a unit measures; ``value`` if unknown."""
    low = F.lower(unit)
    return reduce(lambda c, kv: F.when(low.isin(kv[1]), kv[0]).otherwise(c), reversed(list(D.UNIT_MEANING.items())), F.lit("value"))


def _attribute(kind: str, name: Column, value: Column, unit: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), name.alias("name"), value.alias("value"), unit.alias("unit"), text.alias("original_text"), F.lit(1.0).alias("confidence"))


def extract_attributes(name: Column) -> Column:
    """Array of (type, name, value, unit, original_text, confidence): article and
    technical codes, width and height, and numbers with units; each once."""
    low = F.lower(F.coalesce(name, F.lit("")))
    none = F.lit("")
    article = F.filter(F.array(F.trim(F.regexp_extract(low, ARTICLE, 0))), lambda x: x != "")
    articles = F.transform(article, lambda x: _attribute("article_code", F.lit("article"), x, none, x))
    codes = F.transform(F.regexp_extract_all(low, F.lit(ascii_edges(TECHNICAL)), F.lit(0)), lambda x: _attribute("technical_code", F.lit("code"), x, none, x))
    sizes = F.regexp_extract_all(low, F.lit(DIMENSION), F.lit(0))
    widths = F.transform(sizes, lambda x: _attribute("dimension", F.lit("width"), F.regexp_extract(x, r"^(\d+)", 1), none, x))
    heights = F.transform(sizes, lambda x: _attribute("dimension", F.lit("height"), F.regexp_extract(x, r"(\d+)$", 1), none, x))
    rest = F.regexp_replace(F.regexp_replace(low, ARTICLE, ""), DIMENSION, "")
    amount = rf"(\d+\.?\d*)\s*({D.UNITS_SPACED})"
    amounts = F.transform(
        F.regexp_extract_all(rest, F.lit(amount), F.lit(0)),
        lambda x: _attribute("numeric_value", unit_meaning(F.regexp_extract(x, amount, 2)), F.regexp_extract(x, amount, 1), F.regexp_extract(x, amount, 2), x),
    )
    return F.array_distinct(F.concat(articles, codes, widths, heights, amounts))


# What is looked for behind a size, a number or a code, by name, with its confidence.
MATERIALS = "сталь металл пластик дерево стекло алюминий бетон кирпич steel metal plastic wood glass aluminum concrete brick".split()
COLORS = "белый черный серый красный синий зеленый желтый коричневый бежевый white black gray grey red blue green yellow brown beige".split()
COATINGS = "оцинкован покрашен полирован матовый глянцевый galvanized painted polished matte glossy".split()
TYPES = "панель лист профиль труба уголок швеллер panel sheet profile pipe angle channel".split()
RELATED = {
    "dimension": [("material", MATERIALS, 0.8), ("color", COLORS, 0.75), ("coating", COATINGS, 0.75)],
    "article_code": [("type", TYPES, 0.8)],
    "technical_code": [],
}
THICKNESS = r"(\d+\.?\d*)\s*(mm|см|мм|cm|m|м)(?![\p{L}\p{Nd}])"


def related_attributes(low: Column, pattern: str, kind: str, reach: int = 100) -> Column:
    """Array of (type, name, value, unit, confidence) found within ``reach``
    characters behind the first match of ``pattern`` in a lowered name: behind a
    size a thickness and words for material, colour and coating, behind an
    article a size, a quantity and the type of thing, behind a technical code up
    to three quantities. Of each list of words the first that is there counts;
    word ends are those of letters in any script."""
    text = F.coalesce(low, F.lit(""))
    match = F.regexp_extract(text, pattern, 0)
    after = F.when(match != "", F.substring(text, F.instr(text, match) + F.length(match), F.lit(reach))).otherwise("")
    one = lambda t, n, v, u, c: F.struct(F.lit(t).alias("type"), n.alias("name"), v.alias("value"), u.alias("unit"), F.lit(c).alias("confidence"))
    none = F.lit("")
    found = []
    if kind == "dimension":
        value = F.regexp_extract(after, THICKNESS, 1)
        found.append(F.when(value != "", one("numeric_value", F.lit("thickness"), value, F.regexp_extract(after, THICKNESS, 2), 0.9)))
    glued = rf"(\d+\.?\d*)({D.UNITS_GLUED})"
    if kind == "article_code":
        size = F.regexp_extract(after, DIMENSION, 0)
        found += [F.when(size != "", one("dimension", F.lit(n), F.regexp_extract(size, p, 1), none, 0.85)) for n, p in (("width", r"^(\d+)"), ("height", r"(\d+)$"))]
        quantity = F.regexp_extract(after, glued, 0)
        found.append(F.when(quantity != "", one("numeric_value", unit_meaning(F.regexp_extract(quantity, glued, 2)), F.regexp_extract(quantity, glued, 1), F.regexp_extract(quantity, glued, 2), 0.85)))
    for name, words, sure in RELATED[kind]:
        first = F.coalesce(*[F.nullif(F.regexp_extract(after, rf"(?<!\p{{L}})({w}[а-яa-z]*)(?!\p{{L}})", 1), none) for w in words])
        found.append(F.when(first.isNotNull(), one("text_value", F.lit(name), first, none, sure)))
    made = F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<type:string,name:string,value:string,unit:string,confidence:double>>")
    if kind == "technical_code":
        few = F.slice(F.regexp_extract_all(after, F.lit(glued), F.lit(0)), 1, 3)
        made = F.transform(few, lambda x: one("numeric_value", unit_meaning(F.regexp_extract(x, glued, 2)), F.regexp_extract(x, glued, 1), F.regexp_extract(x, glued, 2), 0.8))
    return made


def _words(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]+", " ")
    return F.split(squeeze(bare), " ")


def tokens(text: Column, keep_stop_words: bool = False, stop: list[str] = D.STOP_NAMES) -> Column:
    """Words of letters and digits of two bytes or more."""
    return F.filter(_words(text), lambda w: (F.octet_length(w) >= 2) & (F.lit(keep_stop_words) | ~w.isin(stop)))


def table_tokens(text: Column, stop: list[str] = D.STOP_TABLE) -> Column:
    """As ``tokens`` with its own stop words; a word needs a letter."""
    return F.filter(_words(text), lambda w: (F.octet_length(w) >= 2) & ~w.isin(stop) & w.rlike(r"\p{L}"))


def key_words(text: Column, stop: list[str] = D.STOP_KEYWORDS) -> Column:
    """Words without punctuation around them: three bytes or more, no stop words, no numbers."""
    words = F.transform(F.split(squeeze(F.lower(F.coalesce(text, F.lit("")))), " "), lambda w: F.btrim(w, F.lit(".,!?;:-\"'")))
    return F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~w.isin(stop) & ~w.rlike(r"^[\p{Nd}.,]+$"))


def phonetic_key(text: Column) -> Column:
    """Letters and digits with like sounds folded."""
    return F.regexp_replace(F.translate(F.lower(text), D.SOUND_FROM, D.SOUND_TO), r"[^\p{L}\p{Nd}]", "")


def similarity(a: Column, b: Column, unit: str = "bytes") -> Column:
    """1 - edit distance / longer length. Distances count characters; lengths count
    bytes, as the catalog's thresholds expect, or ``chars``. Two empty names are alike."""
    size = F.octet_length if unit == "bytes" else F.length
    longest = F.greatest(size(a), size(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def categorize(name: Column, categories: dict[str, list[str]] = D.CATEGORIES, other: str = D.OTHER) -> Column:
    """The first category, in declared order, of which the name contains a keyword."""
    low = F.lower(F.coalesce(name, F.lit("")))
    found = F.lit(other)
    for category, words in reversed(categories.items()):
        hit = reduce(lambda a, b: a | b, (low.contains(w) for w in words))
        found = F.when(hit, F.lit(category)).otherwise(found)
    return found


def table_name(catalog: Column) -> Column:
    """A catalog's name as a table name: Latin, lower case, ``_items`` behind, at most 64 bytes."""
    low = F.lower(F.trim(F.coalesce(catalog, F.lit(""))))
    single = {k: v for k, v in D.LATIN.items() if len(v) == 1}
    spelt = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ((k, v) for k, v in D.LATIN.items() if len(v) != 1), low)
    spelt = F.translate(spelt, "".join(single), "".join(single.values()))
    bare = F.regexp_replace(F.translate(spelt, " -", "__"), "[^a-z0-9_]", "")
    bare = F.btrim(F.regexp_replace(bare, "_+", "_"), F.lit("_"))
    full = F.concat(F.when(bare == "", "unknown").otherwise(bare), F.lit("_items"))
    return F.substring(F.when(full.rlike("^[0-9]"), F.concat(F.lit("cat_"), full)).otherwise(full), 1, 64)


def trim_words(name: Column, n: int) -> Column:
    """Whole words of the name, as long as each fits into ``n`` characters with a
    space before it; if the first doesn't, the first ``n`` characters."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def add(a: Column, w: Column) -> Column:
        full = a["full"] | (F.length(a["text"]) + 1 + F.length(w) > n)
        longer = F.when(a["text"] == "", w).otherwise(F.concat(a["text"], F.lit(" "), w))
        return F.struct(F.when(full, a["text"]).otherwise(longer).alias("text"), full.alias("full"))

    held = F.aggregate(F.split(squeeze(name), " "), start, add)["text"]
    return F.when(F.length(name) <= n, name).otherwise(F.when(held == "", F.substring(name, 1, n)).otherwise(held))


def word_count(name: Column) -> Column:
    """Words between spaces; 0 for a blank name."""
    text = squeeze(F.coalesce(name, F.lit("")))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))
