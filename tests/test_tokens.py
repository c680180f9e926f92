"""Tokens by expressions against a machine that walks over characters."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodewright.functions import patterns, tokens
from lodewright.functions.text import ascii_edges


def is_space(c):
    return c in "\t\n\x0b\x0c\r \x85" or unicodedata.category(c)[0] == "Z"


def walk(text):
    """(type, value, depth, position) of each token, a character at a time."""
    out, run, start, depth, quoted, escaped, at = [], "", 0, 0, False, False, 0

    def flush():
        nonlocal run
        if run:
            number = unicodedata.category(run[0]) == "Nd" and all(unicodedata.category(c) == "Nd" or c in ".," for c in run)
            out.append(("number" if number else "text", run, depth, start))
        run = ""

    for c in text:
        if not run:
            start = at
        if escaped or (quoted and c != '"'):
            escaped = not escaped and c == "\\"
            run += c
        elif c == '"':
            flush()
            quoted = not quoted
            out.append(("quote", c, depth, at))
        elif c in "([{":
            flush()
            depth += 1
            out.append(("bracket_open", c, depth, at))
        elif c in ")]}":
            flush()
            depth -= 1
            out.append(("bracket_close", c, depth, at))
        elif c in ",;":
            flush()
            out.append(("delimiter", c, depth, at))
        elif is_space(c):
            flush()
            out.append(("whitespace", c, depth, at))
        else:
            run += c
        at += len(c.encode())
    flush()
    return out


def pieces_of(found):
    """(depth, text) between brackets and separators."""
    out, held = [], []
    for kind, value, depth, _ in [*found, ("delimiter", ",", 0, 0)]:
        if kind in ("bracket_open", "bracket_close", "delimiter"):
            text = "".join(v for _, v, _ in held).strip()
            if text:
                out.append((max(d for k, _, d in held if k != "whitespace"), text))
            held = []
        elif kind != "quote":
            held.append((kind, value, depth))
    return out


def main_of(found):
    out, space = "", False
    for kind, value, depth, _ in found:
        if depth or kind in ("bracket_open", "bracket_close"):
            continue
        if kind == "whitespace":
            out += " " if out and not space else ""
            space = True
        else:
            out, space = out + value, False
    return out.strip()


def parts_of(found, delimiters):
    out, held = [], ""
    for kind, value, depth, _ in found:
        if kind == "delimiter" and depth == 0 and value in delimiters:
            out += [held.strip()] if held else []
            held = ""
        else:
            held += value
    return out + ([held.strip()] if held else [])


def odd_texts():
    r = random.Random(7)
    made = ["".join(r.choice('ab1.,;()[]{}"\\ \t ыж２') for _ in range(r.randint(0, 30))) for _ in range(400)]
    return ["", None, "Кабель (медный (многожильный) 2x1.5мм) 100м", 'a "b, (c" d', '"открыто (', "a\\", '"\\"', "((x))", "x" * 2000 + " (" * 300, *made]


def test_tokens_are_those_of_the_walk(spark):
    texts = odd_texts()
    t = F.col("t")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, n string").repartition(8).select("id", tokens.tokenize(F.col("n")).alias("t"))
    assert "Python" not in df._jdf.queryExecution().toString()
    told = df.select("id", "t", tokens.nested(t).alias("nested"), tokens.main_text(t).alias("main"), tokens.split_at(t, ",").alias("one"), tokens.split_at(t, ",", ";").alias("two"), tokens.structure(t).alias("s"), F.size(tokens.in_depths(t, 1, 2)).alias("range"), tokens.bracketed(t).alias("inside"))
    for r in told.collect():
        want = walk(texts[r.id] or "")
        assert [(x.type, x.value, x.depth, x.position) for x in r.t] == want, texts[r.id]
        assert all(x.length == len(x.value.encode()) for x in r.t)
        pieces = pieces_of(want)
        assert [tuple(p) for p in r.nested] == pieces and r.main == main_of(want), texts[r.id]
        assert r.inside == [p for k in range(1, 11) for d, p in pieces if d == k]
        assert r.one == parts_of(want, ",") and r.two == parts_of(want, ",;")
        assert r.s.tokens == len(want) and r.s.max_depth == max([0, *(d for *_, d, _ in want)]) and r.s.depths == {d: sum(x[2] == d for x in want) for d in {x[2] for x in want}}
        assert r.range == sum(1 <= x[2] <= 2 for x in want)


def test_keys_and_attributes_inside_brackets(spark):
    of = lambda text, f: spark.createDataFrame([(text,)], "n string").select(f(tokens.tokenize(F.col("n"))).alias("x")).first().x
    assert of("Товар (цвет: белый, размер=100мм, вес 5кг, Цвет: синий)", tokens.key_values) == {"цвет": "синий", "размер": "100мм", "вес": "5кг"}
    assert of("Товар (медный; a=; :b)", tokens.key_values) == {"attr_медный": "медный", "attr_:b": "b"}
    got = {(a.type, a.name, a.value, a.unit) for a in of("Кабель (медный (многожильный) 2x1.5мм, мощность: 5 кВт, цвет: ral) 100м", tokens.contextual_attributes)}
    assert {("text_value", "material", "медный", ""), ("text_value", "type", "многожильный", ""), ("dimension", "width", "2", ""), ("text_value", "цвет", "ral", "")} <= got
    assert of("ничего", tokens.contextual_attributes) == [] and of("", tokens.contextual_attributes) == []
    s = of("Кабель (медный, 2x1.5мм) 100м", tokens.split_smartly)
    assert (s.main_text, s.attributes) == ("Кабель 100м", ["медный", "2x1.5мм"])


@pytest.mark.parametrize("name, standard, contextual, want", [("a (b)", 0, 0, "contextual"), ("a", 1, 4, "contextual"), ("a", 2, 3, "standard"), ("a", 5, 2, "contextual"), ("a", 1, 3, "contextual")])
def test_recommended_method(spark, name, standard, contextual, want):
    assert spark.range(1).select(tokens.recommended_method(F.lit(name), F.lit(standard), F.lit(contextual)).alias("x")).first().x == want


def test_sums_before(spark):
    rows = [(i, [random.Random(i).randint(-9, 9) for _ in range(i)]) for i in (0, 1, 2, 31, 32, 33, 64, 200, 1500)]
    for r in spark.createDataFrame(rows, "id int, a array<int>").select("a", tokens.sums_before(F.col("a")).alias("s")).collect():
        assert r.s == [sum(r.a[:i]) for i in range(len(r.a))]


def test_match_positions(spark):
    texts = [None, "", "м10 x20", "10", "a1b22 333", "ы" * 50 + "7", "1\x011\x02", "5 6"]
    for regex, same in ((r"\d+", r"\d+"), (ascii_edges(r"\b\d+\b"), r"(?<!\w)\d+(?!\w)"), (r"(\d)(\d)?", r"(\d)(\d)?")):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, n string").select("id", tokens.match_positions(F.col("n"), regex).alias("m"))
        for r in df.collect():
            text = texts[r.id] or ""
            found = list(re.finditer(same, text.translate({1: 3, 2: 3}), re.ASCII))
            assert [(m.start, m.stop, m.char_start, m.text) for m in r.m] == [(len(text[: f.start()].encode()), len(text[: f.end()].encode()), f.start(), f.group()) for f in found]


def test_places_of_patterns_are_those_of_detection(spark):
    names = ["Кабель ВВГнг 3х2.5 черный", "ER-00013004 датчик  давления 10 бар", "Samsung Galaxy S21 Ultra", "№ 15 Шайба (м²)", ""]
    for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", patterns.detect(F.col("n")).alias("d"), patterns.detect_at(F.col("n")).alias("a")).collect():
        assert [(x.type, x.matched_text) for x in r.d] == [(x.type, x.matched_text) for x in r.a]
        assert all(r.n.encode()[x.position : x.position + x.length].decode() == x.matched_text == r.n[x.char_position :][: len(x.matched_text)] for x in r.a)
