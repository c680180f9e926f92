"""Splitting delimited names, and extraction by position; see ``tokens`` for brackets and quotes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

def split_top(text: Column, delimiter: str = ",") -> Column:
    """Split at a delimiter outside round brackets, by expressions alone."""
    chars = F.split(F.coalesce(text, F.lit("")), "")
    start = F.struct(F.lit(0).alias("depth"), F.array(F.lit("")).alias("parts"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)
        last = F.element_at(a["parts"], -1)
        head = F.slice(a["parts"], 1, F.size(a["parts"]) - 1)
        parts = F.when((c == delimiter) & (a["depth"] == 0), F.array_append(a["parts"], F.lit(""))).otherwise(F.array_append(head, F.concat(last, c)))
        return F.struct(F.greatest(depth, F.lit(0)).alias("depth"), parts.alias("parts"))

    return F.transform(F.aggregate(chars, start, step)["parts"], lambda p: F.trim(p))


def key_values(parts: Column, between: str = ":") -> Column:
    """Map of the parts that are written key, sign, value."""
    pairs = F.filter(parts, lambda p: p.contains(between))
    keyed = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, between, 1)).alias("key"), F.trim(F.substring(p, F.instr(p, between) + 1, F.length(p))).alias("value")))
    return F.map_from_entries(F.filter(keyed, lambda kv, i: F.size(F.filter(F.slice(keyed, 1, i), lambda x: x["key"] == kv["key"])) == 0))


@dataclass(frozen=True)
class Slot:
    """An attribute that stands at a fixed position of a delimited name."""

    name: str
    kind: str = "text_value"
    required: bool = False
    default: str = ""
    #: The value must match this, if given.
    valid: str = ""


# Schemas by name.
SCHEMAS: dict[str, list[Slot]] = {
    "StandardProduct": [Slot("brand"), Slot("model"), Slot("color"), Slot("dimension", "dimension", valid="[xх]"), Slot("material")],
    "Electronics": [Slot("brand", required=True), Slot("model", required=True), Slot("power", "numeric_value", valid=r"\d"), Slot("voltage", "numeric_value", valid=r"\d"), Slot("color")],
    "Furniture": [Slot("type", required=True), Slot("material"), Slot("color"), Slot("dimension", "dimension", valid="[xх]"), Slot("manufacturer")],
    "Tools": [Slot("type", required=True), Slot("brand"), Slot("model"), Slot("power", "numeric_value", valid=r"\d"), Slot("weight", "numeric_value", valid=r"\d")],
    "BuildingMaterials": [Slot("type", required=True), Slot("material"), Slot("dimension", "dimension", valid="[xх]"), Slot("thickness", "numeric_value", valid=r"\d"), Slot("color")],
}


def register_schema(name: str, slots: list[Slot]) -> None:
    """Add or replace a schema."""
    if not slots or any(not s.name or not s.kind for s in slots):
        raise ValueError("a schema needs slots with names and kinds")
    SCHEMAS[name] = slots


def extract_by_position(parts: Column, slots: list[Slot]) -> tuple[Column, Column]:
    """Attributes (type, name, value, confidence) and errors of a list of parts.

    A missing part gives its default with confidence 0.8, or an error if it is
    required; an empty one is an error if required; a value that its pattern
    doesn't match is an error.
    """
    good, bad = [], []
    for i, s in enumerate(slots):
        given = F.size(parts) > i
        value = F.trim(F.get(parts, F.lit(i)))
        ok = value.rlike(s.valid) if s.valid else F.lit(True)

        def made(v: Column, confidence: float, s: Slot = s) -> Column:
            return F.struct(F.lit(s.kind).alias("type"), F.lit(s.name).alias("name"), v.alias("value"), F.lit(confidence).alias("confidence"))

        taken = F.when(given & (value != "") & ok, made(value, 1.0))
        good.append(taken if s.required or not s.default else taken.when(~given, made(F.lit(s.default), 0.8)))
        wrong = F.when(given & (value != "") & ~ok, F.lit(f"validation failed for position {i}: {s.name}"))
        if s.required:
            wrong = wrong.when(~given, F.lit(f"missing required field at position {i}: {s.name}")).when(value == "", F.lit(f"empty value at position {i}: {s.name}"))
        bad.append(wrong)
    return F.array_compact(F.array(*good)), F.array_compact(F.array(*bad))
