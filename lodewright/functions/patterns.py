"""Detection and repair of patterns that item names shouldn't hold."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import BRANDS
from .text import ascii_edges, squeeze
from .tokens import match_positions


@dataclass(frozen=True)
class Pattern:
    """A rule: what to find, how bad it is and how to mend it (None: by hand)."""

    kind: str
    regex: str
    severity: str
    confidence: float
    fix: Callable[[Column, str], Column] | None = None

    @property
    def java(self) -> str:
        return ascii_edges(self.regex)


def _by(replacement: str) -> Callable[[Column, str], Column]:
    return lambda c, r: F.regexp_replace(c, r, replacement)


def _title(c: Column, _: str) -> Column:
    return F.array_join(F.transform(F.split(squeeze(c), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def _once(c: Column, _: str) -> Column:
    words = F.split(squeeze(c), " ")
    return F.array_join(F.filter(words, lambda w, i: (i == 0) | (F.lower(w) != F.lower(F.coalesce(F.get(words, i - 1), F.lit(""))))), " ")


def _cut(replacement: str) -> Callable[[Column, str], Column]:
    return lambda c, r: F.trim(F.regexp_replace(c, r, replacement))


# The rules, in the order in which they are tried.
PATTERNS = [
    Pattern("technical_code", r"\b[A-ZА-Я]{2,5}-\d{4,10}\b", "medium", 0.95, _by("")),
    Pattern("articul", r"(?iu)\b(арт\.?|артикул|art\.?)\s*:?\s*\d+[-\w]*\b", "medium", 0.9, _by("")),
    Pattern("dimension", r"\b\d+[xхXХ]\d+([xхXХ]\d+)?\b", "low", 0.85, _by("")),
    Pattern("units_of_measure", r"\b\d+\.?\d*\s*(см|мм|м|л|кг|%|г|мг|шт|мл|в|а|вт|квт|ч|мин|сек|м²|м³|мм²|см²)\b", "low", 0.8, _by("")),
    Pattern("extra_spaces", r"\s{3,}", "low", 0.95, _by(" ")),
    Pattern("mixed_case", r"\b([А-ЯЁ]{2,}[а-яё]+|[а-яё]+[А-ЯЁ]{2,})|[A-Z]{2,}[a-z]+|[a-z]+[A-Z]{2,}\b", "medium", 0.7, _title),
    Pattern("special_chars", r"[!@#$%^&*_=+<>?/\\|~`]", "medium", 0.8, _by(" ")),
    Pattern("duplicate_words", r"\b(\w+)\s+\w+\b", "high", 0.9, _once),
    Pattern("numbers_in_name", r"(^\d+[-\w]*\s+|\s+\d+[-\w]*$)", "low", 0.75, _cut(" ")),
    Pattern("prefix_suffix", r"(^[№#]\s*\d+|-\s*[A-ZА-Я]+$|^\d+\s*-)", "low", 0.7, _cut("")),
    Pattern("incomplete_word", r"\b\w{1,2}\.\.\.|\b\w{1,2}\s|^\w{1,2}$", "medium", 0.6),
    Pattern("brand", r"(?iu)\b(" + "|".join(re.escape(b) for b in BRANDS) + r")\b", "info", 0.95),
    Pattern("model", r"\b([A-ZА-Я]{1,4}[-\s]?\d{2,5}[A-ZА-Я]?|[A-ZА-Я]{2,}\s*\d{1,3}\s*(Pro|Max|Plus|Ultra|Mini|Lite|SE)?)\b", "info", 0.85),
]


def detect(name: Column, patterns: list[Pattern] = PATTERNS) -> Column:
    """Array of (type, matched_text, suggested_fix, severity, confidence, auto_fixable), rule by rule."""
    text = F.coalesce(name, F.lit(""))

    def found(p: Pattern) -> Column:
        return F.transform(
            F.regexp_extract_all(text, F.lit(p.java), F.lit(0)),
            lambda x: F.struct(
                F.lit(p.kind).alias("type"),
                x.alias("matched_text"),
                (p.fix(x, p.java) if p.fix else x).alias("suggested_fix"),
                F.lit(p.severity).alias("severity"),
                F.lit(p.confidence).alias("confidence"),
                F.lit(p.fix is not None).alias("auto_fixable"),
            ),
        )

    return F.concat(*[found(p) for p in patterns])


def detect_at(name: Column, patterns: list[Pattern] = PATTERNS) -> Column:
    """Array of (type, position, length, char_position, matched_text), rule by rule; position and length in bytes."""

    def found(p: Pattern) -> Column:
        told = lambda m: F.struct(F.lit(p.kind).alias("type"), m["start"].alias("position"), (m["stop"] - m["start"]).alias("length"), m["char_start"].alias("char_position"), m["text"].alias("matched_text"))
        return F.transform(match_positions(name, p.java), told)

    return F.concat(*[found(p) for p in patterns])


def apply_fixes(name: Column, patterns: list[Pattern] = PATTERNS) -> Column:
    """The name after the fix of every rule that the original matches, each once, in rule order."""
    fixed = name
    for p in patterns:
        if p.fix:
            fixed = F.when(name.rlike(p.java), p.fix(fixed, p.java)).otherwise(fixed)
    return squeeze(fixed)


def pattern_confidence(matches: Column) -> Column:
    """Mean confidence (times 0.7 if not mended by itself), times 0.95 if all are, else 0.8; 1 without matches."""
    total = F.aggregate(matches, F.lit(0.0), lambda a, m: a + m["confidence"] * F.when(m["auto_fixable"], 1.0).otherwise(0.7))
    sure = F.forall(matches, lambda m: m["auto_fixable"])
    return F.when(F.size(matches) == 0, 1.0).otherwise(total / F.size(matches) * F.when(sure, 0.95).otherwise(0.8))


def brands(name: Column) -> Column:
    """All brands in the name, as written."""
    p = next(p for p in PATTERNS if p.kind == "brand")
    return F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(p.java), F.lit(0))


def models(name: Column) -> Column:
    p = next(p for p in PATTERNS if p.kind == "model")
    return F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(p.java), F.lit(0))
