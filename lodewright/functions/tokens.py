"""Tokens of names by expressions alone: brackets, quotes, separators, depth and place; what is built on them.

A token is (type, value, depth, position, length) with place and length in
bytes of UTF-8. Inside double quotes everything is text, and a backslash takes
the next character as it is. An opening bracket has the depth inside of it, a
closing one that outside, which falls below zero where brackets don't match.
The values in a row are the name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dictionaries as D
from .names import DIMENSION, unit_meaning

# Types of tokens.
TEXT, NUMBER, OPEN, CLOSE, DELIMITER, QUOTE, SPACE = "text", "number", "bracket_open", "bracket_close", "delimiter", "quote", "whitespace"

_SPACE = r"[ \t\n\x0B\f\r\x{85}\p{Z}]"
#: A quoted run with its quotes, a bracket, a separator, a space, or a run of anything else: these cover a name.
_LEXEME = rf'"(?s:\\.|[^"\\])*\\?"?|[(\[{{)\]}},;]|{_SPACE}|(?:(?!{_SPACE})[^"(\[{{)\]}},;])+'
_NUMBER = r"^\p{Nd}[\p{Nd}.,]*$"
#: Numbers of a list that are added up at once.
BLOCK = 32


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` computed once, however often ``of`` reads it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def sums_before(numbers: Column) -> Column:
    """For each number of an array the sum of those before it; in blocks, so that a long array doesn't cost its square."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def added(blocks: Column) -> Column:
        def spread(sums: Column) -> Column:
            return F.flatten(F.transform(blocks, lambda b, i: let(total(F.slice(sums, 1, i)), lambda start: F.transform(b, lambda _, j: start + total(F.slice(b, 1, j))))))

        return let(F.transform(blocks, total), spread)

    starts = F.when(F.size(numbers) > 0, F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return let(numbers.cast("array<bigint>"), lambda n: let(F.transform(starts, lambda k: F.slice(n, k * BLOCK + 1, F.lit(BLOCK))), added))


def _token(kind: Column | str, value: Column, depth: Column, position: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("type"), value.alias("value"), depth.cast("int").alias("depth"), position.cast("int").alias("position"), F.octet_length(value).alias("length"))


def tokenize(text: Column) -> Column:
    """The tokens of a text; null and empty ones have none."""

    def made(lexemes: Column) -> Column:
        step = F.transform(lexemes, lambda x: F.when(x.rlike(r"^[(\[{]"), 1).when(x.rlike(r"^[)\]}]"), -1).otherwise(0))
        places = F.transform(lexemes, F.octet_length)
        return let(F.struct(step.alias("step"), sums_before(step).alias("depth"), sums_before(places).alias("at")), lambda s: F.flatten(F.transform(lexemes, lambda x, i: one(x, F.get(s["step"], i), F.get(s["depth"], i), F.get(s["at"], i)))))

    def one(x: Column, step: Column, depth: Column, at: Column) -> Column:
        run = lambda v: F.when(v.rlike(_NUMBER), NUMBER).otherwise(TEXT)
        closed = x.rlike(r'^"(?s:\\.|[^"\\])*"$')
        inner = F.substring(x, F.lit(2), F.length(x) - 1 - F.when(closed, 1).otherwise(0))
        quote = F.lit('"')
        quoted = F.concat(
            F.array(_token(QUOTE, quote, depth, at)),
            F.when(inner != "", F.array(_token(run(inner), inner, depth, at + 1))).otherwise(F.array().cast("array<struct<type:string,value:string,depth:int,position:int,length:int>>")),
            F.when(closed, F.array(_token(QUOTE, quote, depth, at + F.octet_length(x) - 1))).otherwise(F.array().cast("array<struct<type:string,value:string,depth:int,position:int,length:int>>")),
        )
        kind = F.when(step == 1, OPEN).when(step == -1, CLOSE).when(x.isin(",", ";"), DELIMITER).when(x.rlike(f"^{_SPACE}$"), SPACE).otherwise(run(x))
        return F.when(x.startswith('"'), quoted).otherwise(F.array(_token(kind, x, depth + step, at)))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_LEXEME), F.lit(0)), made)


def _between(tokens: Column, is_cut: Callable[[Column], Column]) -> Column:
    """The tokens between those that cut, as arrays; none is empty."""
    marks = F.transform(tokens, lambda t, i: F.when(is_cut(t), i))
    bounds = F.concat(F.array(F.lit(-1)), F.array_compact(marks), F.array(F.size(tokens)))
    parts = let(bounds, lambda b: F.transform(F.sequence(F.lit(1), F.size(b) - 1), lambda k: F.slice(tokens, F.get(b, k - 1) + 2, F.get(b, k) - F.get(b, k - 1) - 1)))
    return F.filter(parts, lambda p: F.size(p) > 0)


def _joined(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["value"]), "")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def split_at(tokens: Column, *delimiters: str) -> Column:
    """The texts between separators of depth 0 (of ``,`` and ``;`` those given), trimmed; what has no character is left out."""
    cut = lambda t: (t["type"] == DELIMITER) & (t["depth"] == 0) & t["value"].isin(list(delimiters))
    return F.transform(_between(tokens, cut), lambda p: _trimmed(_joined(p)))


def nested(tokens: Column) -> Column:
    """Array of (depth, text): what stands between brackets and separators, without quotes, in the order of the name."""
    words = lambda p: F.filter(p, lambda t: t["type"].isin(TEXT, NUMBER, SPACE))
    pieces = F.transform(_between(tokens, lambda t: t["type"].isin(OPEN, CLOSE, DELIMITER)), words)
    told = F.transform(pieces, lambda p: F.struct(F.array_max(F.transform(F.filter(p, lambda t: t["type"] != SPACE), lambda t: t["depth"])).alias("depth"), _trimmed(_joined(p)).alias("text")))
    return F.filter(told, lambda p: p["text"] != "")


def texts_at(pieces: Column, depth: int) -> Column:
    """The texts of ``nested`` at one depth."""
    return F.transform(F.filter(pieces, lambda p: p["depth"] == depth), lambda p: p["text"])


def bracketed(tokens: Column, deepest: int = 10) -> Column:
    """The texts inside brackets, those of depth 1 first, down to ``deepest``."""
    return let(nested(tokens), lambda n: F.concat(*[texts_at(n, k) for k in range(1, deepest + 1)]))


def main_text(tokens: Column) -> Column:
    """The text outside brackets, with single spaces between what is not quoted."""
    outside = F.filter(tokens, lambda t: (t["depth"] == 0) & ~t["type"].isin(OPEN, CLOSE))
    last_space = lambda ts, i: (i == 0) | F.coalesce(F.get(ts, i - 1)["type"] == SPACE, F.lit(False))
    return let(outside, lambda ts: _trimmed(F.array_join(F.transform(ts, lambda t, i: F.when(t["type"] != SPACE, t["value"]).when(last_space(ts, i), "").otherwise(" ")), "")))


def split_smartly(tokens: Column) -> Column:
    """Struct of main_text and attributes, the texts inside brackets."""
    return F.struct(main_text(tokens).alias("main_text"), bracketed(tokens).alias("attributes"))


def in_depths(tokens: Column, low: int, high: int) -> Column:
    """The tokens of depths ``low`` to ``high``."""
    return F.filter(tokens, lambda t: t["depth"].between(low, high))


def structure(tokens: Column) -> Column:
    """Counts of tokens, texts, numbers, separators and closed brackets, the deepest depth, whether there are quotes, and tokens by depth."""
    n = lambda kind: F.size(F.filter(tokens, lambda t: t["type"] == kind))
    depths = F.transform(tokens, lambda t: t["depth"])
    by = let(depths, lambda d: F.transform(F.array_sort(F.array_distinct(d)), lambda k: F.struct(k.alias("key"), F.size(F.filter(d, lambda x: x == k)).alias("value"))))
    return F.struct(
        F.size(tokens).alias("tokens"), n(TEXT).alias("texts"), n(NUMBER).alias("numbers"), n(DELIMITER).alias("delimiters"), n(CLOSE).alias("brackets"),
        F.greatest(F.coalesce(F.array_max(depths), F.lit(0)), F.lit(0)).alias("max_depth"), (n(QUOTE) > 0).alias("quotes"), F.map_from_entries(by).alias("depths"),
    )


def key_values(tokens: Column) -> Column:
    """Map of the texts inside brackets: key and value around the first colon, else
    equals sign, else space; a single word, or a text without a key, stands under
    ``attr_`` and itself. Keys are lowered; of equal ones the last counts."""

    def pair(a: Column) -> Column:
        parted = lambda sign: (_trimmed(F.substring_index(a, sign, 1)), _trimmed(F.substring(a, F.locate(sign, a) + 1, F.length(a))))
        (colon_key, colon_value), (equals_key, equals_value) = parted(":"), parted("=")
        words = F.split(a, f"{_SPACE}+")
        key = F.when(a.contains(":"), colon_key).when(a.contains("="), equals_key).when(F.size(words) > 1, F.get(words, F.lit(0))).otherwise("")
        value = F.when(a.contains(":"), colon_value).when(a.contains("="), equals_value).when(F.size(words) > 1, F.array_join(F.slice(words, 2, F.size(words)), " ")).otherwise(a)
        return F.struct(F.when(key != "", F.lower(key)).otherwise(F.concat(F.lit("attr_"), a)).alias("key"), value.alias("value"))

    told = F.filter(F.transform(bracketed(tokens), pair), lambda p: p["value"] != "")
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(let(told, last))


# Parts of words that tell materials, colours and kinds of cores inside brackets.
MATERIAL_PARTS = ["медный", "медн", "стальной", "сталь", "алюминиев", "пластиков", "деревян", "стеклян"]
COLOR_PARTS = ["белый", "черн", "сер", "красн", "син", "зелен", "желт", "коричнев"]
CORE_PARTS = ["многожильн", "одножильн", "двухжильн", "трехжильн"]
AMOUNT = rf"(\d+\.?\d*)\s*({D.UNITS_GLUED})"


def _attribute(kind: str, name: Column | str, value: Column, unit: Column | str, confidence: float) -> Column:
    name, unit = (F.lit(x) if isinstance(x, str) else x for x in (name, unit))
    return F.struct(F.lit(kind).alias("type"), name.alias("name"), value.alias("value"), unit.alias("unit"), F.lit(confidence).alias("confidence"))


def _sides(size: Column) -> Column:
    sides = F.split(size, "[xх]")
    return F.transform(sides, lambda v, i: _attribute("dimension", F.coalesce(F.get(F.array(*map(F.lit, ("width", "height", "depth"))), i), F.lit("dimension")), F.trim(v), "", 0.9))


def _amounts(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)), lambda x: _attribute("numeric_value", unit_meaning(F.regexp_extract(x, AMOUNT, 2)), F.regexp_extract(x, AMOUNT, 1), F.regexp_extract(x, AMOUNT, 2), 0.9))


def contextual_attributes(tokens: Column) -> Column:
    """Attributes (type, name, value, unit, confidence) of the texts inside
    brackets: of each key's value a number with its unit, else sides of a size,
    else the text; then of each text that isn't written with a key's sign the
    first size, all numbers with units, and a material, a colour and a kind of
    core if a part of a word tells so."""

    def keyed(e: Column) -> Column:
        first = F.slice(_amounts(e["value"]), 1, 1)
        return F.when(F.size(first) > 0, first).when(e["value"].rlike(DIMENSION), _sides(e["value"])).otherwise(F.array(_attribute("text_value", e["key"], e["value"], "", 0.85)))

    def plain(a: Column) -> Column:
        size = F.regexp_extract(a, DIMENSION, 0)
        low = F.lower(a)
        told = [F.when(F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(low, p)), _attribute("text_value", name, a, "", sure)) for name, parts, sure in (("material", MATERIAL_PARTS, 0.8), ("color", COLOR_PARTS, 0.8), ("type", CORE_PARTS, 0.85))]
        return F.concat(F.when(size != "", _sides(size)).otherwise(F.slice(_sides(F.lit("")), 1, 0)), _amounts(a), F.array_compact(F.array(*told)))

    def found(s: Column) -> Column:
        signed = lambda a: F.exists(F.map_keys(s["pairs"]), lambda k: a.contains(F.concat(k, F.lit(":"))) | a.contains(F.concat(k, F.lit("="))))
        return F.concat(F.flatten(F.transform(F.map_entries(s["pairs"]), keyed)), F.flatten(F.transform(F.filter(s["texts"], lambda a: ~signed(a)), plain)))

    return let(F.struct(key_values(tokens).alias("pairs"), bracketed(tokens).alias("texts")), found)


def recommended_method(name: Column, standard: Column, contextual: Column) -> Column:
    """``standard`` or ``contextual``, by the numbers of attributes that both find and the brackets of the name."""
    return F.when(name.contains("(") & name.contains(")"), "contextual").when(contextual > standard + 2, "contextual").when(F.abs(contextual - standard) <= 1, "standard").otherwise("contextual")


# ---------------------------------------------------------------- places of matches

_MARK, _END = "\x01", "\x02"


def match_positions(text: Column, regex: str) -> Column:
    """Array of (start, stop, char_start, text) of all matches of ``regex``
    (which no empty text matches): bytes of UTF-8 from 0, and characters.

    Matches are marked by two control characters; where a text has them itself they count as another one."""
    clean = F.translate(F.coalesce(text, F.lit("")), _MARK + _END, "\x03\x03")
    marked = F.regexp_replace(clean, f"(?:{regex})", f"{_MARK}$0{_END}")
    # before the first match, then a match and what follows it, in turn
    parts = F.split(marked, f"[{_MARK}{_END}]")

    def told(p: Column) -> Column:
        at = F.struct(p.alias("p"), sums_before(F.transform(p, F.octet_length)).alias("b"), sums_before(F.transform(p, F.length)).alias("c"))
        every = F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return let(at, lambda s: F.transform(every, lambda i: F.struct(
            F.get(s["b"], i).cast("int").alias("start"), (F.get(s["b"], i) + F.octet_length(F.get(s["p"], i))).cast("int").alias("stop"), F.get(s["c"], i).cast("int").alias("char_start"), F.get(s["p"], i).alias("text"))))

    return let(parts, told)
