"""Scalar functions against literals and plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from lodewright.functions import names, parsing, patterns, validators
from lodewright.operators import classify, quality


def column(spark, values, make, name="x"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col(name))).collect()]


def test_normalize_name(spark):
    given = {
        "Молоток": "молоток", "Молоток ER-00013004": "молоток er", "Панель 100x100": "панель", "Кабель 50м": "кабель", "Молоток    большой": "молоток большой",
        "Товар 123": "товар", "Молоток ER-00013004 100x100 50кг": "молоток er", "!!!": "", "!@#$%^&*()": "", "": "", "wbc00z0002 Панель": "панель", "Труба - ": "труба",
    }
    assert column(spark, list(given), names.normalize_name) == list(given.values())
    assert column(spark, [None], names.normalize_name) == [None]


def test_categorize_takes_the_first_category(spark):
    given = {"Молоток большой": "инструмент", "Антибиотик энрофлоксацин": "медикаменты", "Компьютер": "электроника", "Насос водяной": "оборудование", "Ручка шариковая": "канцелярия", "Неизвестный товар": "другое", "Кабель": "стройматериалы"}
    assert column(spark, list(given), names.categorize) == list(given.values())
    assert column(spark, [None], names.categorize) == ["другое"]


def test_attributes(spark):
    got = column(spark, ["wbc00z0002 Панель 100x200 5кг", "", None], names.extract_attributes)
    assert [(a["type"], a["name"], a["value"], a["unit"]) for a in got[0]] == [("article_code", "article", "wbc00z0002", ""), ("dimension", "width", "100", ""), ("dimension", "height", "200", ""), ("numeric_value", "weight", "5", "кг")]
    assert got[1:] == [[], []]


def test_tokens_and_sounds(spark):
    assert column(spark, ["Ноутбук для дома и офиса!", None], names.tokens) == [["ноутбук", "дома", "офиса"], []]
    assert column(spark, ["болт м10 123"], names.table_tokens) == [["болт", "м10"]]
    assert column(spark, ["Ёлка", "зов"], names.phonetic_key) == ["илка", "саф"]


def test_inn_and_codes(spark):
    good = ["7707083893", "77-0708 3893", "500100732259"]
    bad = ["7707083894", "500100732258", "123", "", None, "77070838a3"]
    assert column(spark, good + bad, validators.valid_inn) == [True] * 3 + [False] * 6
    assert column(spark, ["ИНН: 7707083893 КПП 123456789", "x 500100732259", None], validators.extract_inn) == ["7707083893", "5001007322", None]
    assert column(spark, ["46.90", "46.90.10", "4690", "46.9", None], validators.valid_kpved) == [True, True, False, False, False]
    assert column(spark, ["46,9", "46-90-1", "4690"], validators.repair_kpved) == ["46.09", "46.90.01", "4690"]


def test_table_names(spark):
    given = {"Номенклатура": "nomenklatura_items", "Щётки - 2": "shchyotki_2_items", "2024": "cat_2024_items", "!": "unknown_items", None: "unknown_items"}
    assert column(spark, list(given), names.table_name) == list(given.values())


def test_trim_words(spark):
    def brute(text, n):
        if len(text) <= n:
            return text
        out = ""
        for w in text.split():
            if len(out + " " + w) > n:
                break
            out = f"{out} {w}".strip()
        return out or text[:n]

    texts = ["a bb ccc dddd", "abcdefghijkl", "aa bbbbbbbbbbb c", "x"]
    assert column(spark, texts, lambda c: names.trim_words(c, 8)) == [brute(t, 8) for t in texts]


@pytest.mark.parametrize("name, kinds", [("Товар ER-00013004", {"technical_code"}), ("Панель 100x100", {"dimension", "numbers_in_name"}), ("Товар    большой", {"extra_spaces"}), ("Товар!@#", {"special_chars"}), ("№123 Товар", {"prefix_suffix"}), ("", set())])
def test_patterns_found(spark, name, kinds):
    got = {m["type"] for m in column(spark, [name], patterns.detect)[0]}
    assert kinds <= got and (name or not got)


def test_pattern_fixes(spark):
    given = {"Товар ER-00013004": "Товар", "Панель 100x100": "Панель", "Товар    большой": "Товар большой", "Товар арт.123": "Товар арт.123", "red red bolt": "red bolt"}
    assert column(spark, list(given), patterns.apply_fixes) == list(given.values())
    conf = column(spark, ["", "Samsung"], lambda c: patterns.pattern_confidence(patterns.detect(c)))
    assert conf[0] == 1.0 and 0 < conf[1] < 1


def test_split(spark):
    assert column(spark, ["a, b(c,d), e", ""], parsing.split_top) == [["a", "b(c,d)", "e"], [""]]
    assert column(spark, ["k: v, k: w, z:1"], lambda c: parsing.key_values(parsing.split_top(c))) == [{"k": "v", "z": "1"}]


def test_positions(spark):
    slots = [parsing.Slot("brand", required=True), parsing.Slot("size", "dimension", valid="x"), parsing.Slot("color", default="white")]
    good = column(spark, ["A,10x2", ",5"], lambda c: parsing.extract_by_position(F.split(c, ","), slots)[0])
    bad = column(spark, ["A,10x2", ",5"], lambda c: parsing.extract_by_position(F.split(c, ","), slots)[1])
    assert [[a["value"] for a in g] for g in good] == [["A", "10x2", "white"], ["white"]]
    assert bad == [[], ["empty value at position 0: brand", "validation failed for position 1: size"]]


def test_folding(spark):
    path = F.split(F.lit("a,b,c"), ",")
    one = spark.range(1)
    fold = lambda s: one.select(classify.fold_path(path, 2, s)).first()[0]
    assert (fold("top"), fold("bottom"), fold("mixed")) == (["a", "b / c"], ["a / b", "c"], ["a", "b / c"])
    named = lambda s: one.select(classify.fold_category(path, s)).first()[0]
    assert (named("top_priority"), named("bottom_priority"), named("mixed_priority"), named("none")) == (["a", "c"], ["a / b / c", "c"], ["a", "c"], ["a", "b / c"])


def test_quality_score(spark):
    row = spark.createDataFrame([("Молоток большой стальной", "молоток большой стальной", "инструмент", 0.9, "ai_enhanced")], "s string, n string, c string, a double, l string")
    q = row.select(quality.quality_score(*map(F.col, "sncal")).alias("q")).first().q
    assert q.category == 0.95 and q.clarity == 1.0 and q.consistency == 1.0 and q.completeness == 1.0 and q.standardisation == 1.0
    assert q.overall == 1.0 and q.is_benchmark


def test_keyword_classifier(spark):
    rows = spark.createDataFrame([("болт м10",), ("панель сэндвич",), ("датчик давления",), ("ничего",), ("",)], "normalized_name string")
    got = {r.normalized_name: (r.code, r.confidence) for r in classify.classify_by_keyword(rows).collect()}
    assert got == {"болт м10": ("25.93.11", 0.98), "панель сэндвич": ("25.11.11", 0.98), "датчик давления": ("26.51.52", 0.98), "ничего": (None, None), "": (None, None)}


def test_ascii_edges_are_those_of_re2(spark):
    # in RE2 a Cyrillic letter is no word character, so there is a boundary between it and a digit
    assert column(spark, ["м10 болт"], lambda c: names.F.regexp_replace(c, names.ascii_edges(r"\b\d+\b"), "X")) == ["мX болт"]
    assert re.sub(r"\b\d+\b", "X", "м10", flags=re.ASCII) == "мX"
