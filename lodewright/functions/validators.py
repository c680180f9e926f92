"""Checks of codes and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the check digits of ten and twelve digit taxpayer numbers.
WEIGHTS_10 = [2, 4, 10, 3, 5, 9, 4, 6, 8]
WEIGHTS_12 = [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
WEIGHTS_12_LAST = [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]


def _bare(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), " -", "")


def _check(digits: Column, weights: list[int]) -> Column:
    """Whether the digit behind ``weights`` is their sum modulo 11 modulo 10."""
    values = F.transform(F.split(F.substring(digits, 1, len(weights)), ""), lambda d: d.cast("int"))
    total = F.aggregate(F.zip_with(values, F.array(*map(F.lit, weights)), lambda d, w: d * w), F.lit(0), lambda a, b: a + b)
    return total % 11 % 10 == F.substring(digits, len(weights) + 1, 1).cast("int")


def valid_inn(inn: Column) -> Column:
    """A taxpayer number of 10 or 12 digits with right check digits; spaces and hyphens don't count."""
    d = _bare(inn)
    ten = F.when(d.rlike("^[0-9]{10}$"), _check(d, WEIGHTS_10))
    twelve = F.when(d.rlike("^[0-9]{12}$"), _check(d, WEIGHTS_12) & _check(d, WEIGHTS_12_LAST))
    return F.coalesce(ten, twelve, F.lit(False))


def valid_kpp(kpp: Column) -> Column:
    return _bare(kpp).rlike("^[0-9]{9}$")


def _first(text: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def extract_inn(attributes: Column) -> Column:
    """A labelled number of 10 to 12 digits, else the first run of ten; null if none."""
    return _first(attributes, r"(?iu)(?:инн|inn)[\s:]*(\d{10,12})", r"(\d{10}|\d{12})")


def extract_kpp(attributes: Column) -> Column:
    return _first(attributes, r"(?iu)(?:кпп|kpp)[\s:]*(\d{9})", r"(\d{9})")


def valid_code(code: Column, kind: str = "any") -> Column:
    filled = F.coalesce(code, F.lit("")) != ""
    pattern = {"numeric": "^[0-9]+$", "alphanumeric": "^[A-Za-z0-9]+$"}.get(kind)
    return filled & code.rlike(pattern) if pattern else filled


def valid_kpved(code: Column) -> Column:
    """Two digits, then one to three groups of two."""
    return F.coalesce(code, F.lit("")).rlike(r"^[0-9]{2}(\.[0-9]{2}){1,3}$")


def repair_kpved(code: Column) -> Column:
    """Groups of digits brought to two digits each; the cleaned code if fewer than two are left."""
    clean = F.translate(F.trim(code), ",- ", "..")
    groups = F.filter(F.split(F.regexp_replace(clean, "[^0-9.]", ""), r"\."), lambda g: g != "")
    pairs = F.transform(groups, lambda g: F.when(F.length(g) == 1, F.concat(F.lit("0"), g)).otherwise(F.substring(g, 1, 2)))
    return F.when(F.size(pairs) >= 2, F.array_join(pairs, ".")).otherwise(clean)


def has_any(text: Column, words: list[str]) -> Column:
    """Whether the text has one of the words, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


# Words that show an address or a contact in attribute text.
ADDRESS_WORDS = ["адрес", "address", "улица", "street", "город", "city"]
CONTACT_WORDS = ["телефон", "phone", "email", "почта", "контакт", "contact"]
