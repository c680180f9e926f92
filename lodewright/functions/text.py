"""Regular expressions with one meaning in Java and RE2, and small text helpers."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "[0-9A-Za-z_]"
_EDGE = rf"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def ascii_edges(pattern: str) -> str:
    r"""``pattern`` with ``\b`` as a boundary of ASCII words, which Java's own is not."""
    return pattern.replace(r"\b", _EDGE)


def is_filled(c: Column, trim: bool = False) -> Column:
    """Neither null nor empty; with ``trim`` not blank either."""
    return c.isNotNull() & ((F.trim(c) if trim else c) != "")


def squeeze(c: Column) -> Column:
    """Words (runs without Unicode space) joined by single spaces."""
    return F.trim(F.regexp_replace(c, r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def any_contains(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words), F.lit(False))


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Into [low, high]; null, NaN and infinities give ``low``."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), c)))
