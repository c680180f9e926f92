"""Answers of language models, file names and addresses, made safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze

# What is put right in an answer, in order.
REPAIRS = [
    (r"^\s*```(?:json)?", ""),
    (r"```\s*$", ""),
    (r'"confidence": ?(?:null\b|(?=,))', '"confidence": 0.5'),
    (r'"confidence":\s*\.([0-9]+)', '"confidence": 0.$1'),
    (r'("confidence":\s*[0-9.]+)\s*("reasoning")', "$1, $2"),
    (r'("selected_code":\s*"[^"]+")\s*("confidence")', "$1, $2"),
]
ANSWER = "selected_code string, confidence double, reasoning string"


def parse_answer(text: Column) -> Column:
    """Struct of code, confidence (in [0, 1]; percent are divided, anything else
    is 0.5) and reasoning; null where no code can be read."""
    mended = reduce(lambda c, r: F.regexp_replace(c, *r), REPAIRS, F.trim(text))
    again = F.regexp_replace(mended, r'([0-9.]+|"[^"]+")\s*\n\s*(")', "$1, $2")
    read = lambda c: F.from_json(c, ANSWER, {"mode": "PERMISSIVE"})
    got = F.when(F.coalesce(read(mended)["selected_code"], F.lit("")) != "", read(mended)).otherwise(read(again))
    sure = got["confidence"]
    bounded = F.when((sure > 0) & (sure <= 1), sure).when((sure > 1) & (sure <= 100), sure / 100).otherwise(0.5)
    return F.when(F.coalesce(got["selected_code"], F.lit("")) != "", F.struct(got["selected_code"].alias("code"), bounded.alias("confidence"), got["reasoning"].alias("reasoning")))


def file_name(text: Column) -> Column:
    """Without characters that file systems refuse; runs of underscores as one."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r'[\\/:*?"<>|\s]', "_"), "_+", "_"), F.lit("_"))


def target_url(text: Column) -> Column:
    """The address without slashes at its end; null unless it has a scheme and a host."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/\s]+"), F.regexp_replace(bare, "/+$", ""))


def xml_escaped(text: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def prompt_context(name: Column, category: Column, kind: Column, key_words: Column, specs: Column) -> Column:
    """What a model is told about an item: words, kind and technical data, with a confidence that grows with them."""
    sure = 0.5 + F.when(F.size(key_words) > 0, 0.1).otherwise(0.0) + F.when(kind != "unknown", 0.2).otherwise(0.0) + F.when(F.size(specs) > 0, 0.1).otherwise(0.0)
    return F.struct(squeeze(name).alias("name"), category.alias("category"), key_words.alias("key_words"), kind.alias("kind"), specs.alias("specs"), sure.alias("confidence"))
