"""Pairs by edits, groups by words, descents down code trees, reclassification: against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodewright.functions import names
from lodewright.operators import classify, dedup, descent, edits, overlap

LOW = "id long, n string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(texts, threshold, unit):
    size = (lambda t: len(t.encode())) if unit == "bytes" else len
    return sorted((i, j) for i, j in itertools.combinations(range(len(texts)), 2) if round(1 - distance(texts[i], texts[j]) / max(size(texts[i]), size(texts[j])), 9) >= threshold)


def mixed_texts():
    r = random.Random(11)
    out = ["a", "b", "ab", "№", "№№", "x" * 40, "x" * 41, "😀😀😀", "😀a😀"]
    for letters in ("abc", "abcdefghij0123456789 ", "абвгде 12", "а1😀"):
        for _ in range(7):
            t = "".join(r.choice(letters) for _ in range(r.randint(1, 45)))
            at = r.randrange(len(t))
            out += [t, t[:at] + t[at + 1 :], r.choice(letters) + t, t[::-1], t[:at] + r.choice("№q") + t[at + 1 :]]
    return [t for t in dict.fromkeys(out) if t]


@pytest.mark.parametrize("threshold, unit, tile", [(0.85, "bytes", 2000), (0.7, "bytes", 5), (0.5, "chars", 2000), (0.9, "chars", 1), (0.2, "bytes", 50)])
def test_edit_pairs_are_those_of_all_pairs(spark, threshold, unit, tile):
    texts = mixed_texts()
    got = dedup.edit_pairs(spark.createDataFrame(list(enumerate(texts)), LOW), threshold, unit, tile).collect()
    assert sorted((r.a, r.b) for r in got) == near(texts, threshold, unit)
    assert all(abs(r.score - (1 - distance(texts[r.a], texts[r.b]) / max((len(t.encode()) if unit == "bytes" else len(t)) for t in (texts[r.a], texts[r.b])))) < 1e-9 for r in got)


def test_long_texts_and_their_edits(spark):
    r = random.Random(3)
    base = "".join(r.choice("abcdefgh ") for _ in range(1500))
    other = list(base)
    for at in r.sample(range(1500), 200):
        other[at] = "z"
    texts = [base, "".join(other), base[::-1], base[40:], "q" + base[:700]]
    got = dedup.edit_pairs(spark.createDataFrame(list(enumerate(texts)), LOW), 0.85, "chars").collect()
    assert sorted((r.a, r.b) for r in got) == [(0, 1), (0, 3)]


def test_one_wide_character_changes_no_other_text(spark):
    r = random.Random(5)
    rows = [(i, "bolt red " + "".join(r.choice("0123456789abcdef") for _ in range(12))) for i in range(1500)]
    count = lambda more: edits.candidates(prepared(spark, rows + more)).filter("a < 1500 and b < 1500").count()
    plain = count([])
    assert abs(count([(1500, "№ 15 шайба")]) - plain) <= 0.02 * plain + 20 and plain < 1500 * 1499 / 40


def prepared(spark, rows):
    size = F.octet_length("n")
    return spark.createDataFrame(rows, LOW).select("id", "n", F.length("n").alias("chars"), size.alias("size"), F.floor(size * 0.15 + 1e-6).cast("int").alias("most"))


@pytest.fixture
def small_broadcasts(spark):
    """A table of 24 MB can't be broadcast: Spark knows the size of the texts, not that of the rows they become."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "24m")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def numbered_names(n=4000):
    r = random.Random(21)
    one = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    return [(i, f"k{i // 2}", f"{one()} {'red' if i % 2 else 'blue'} {'steel' if i % 3 else 'copper'} {one()}") for i in range(n)]


def test_runs_of_names_are_not_broadcast_for_edits(spark, small_broadcasts):
    rows = numbered_names()
    items = spark.createDataFrame([*rows, *[(i + 5000, c, n[1:]) for i, c, n in rows[:40]]], "id long, code string, name string")
    assert sorted((x.a, x.b) for x in dedup.fuzzy_pairs(items).collect()) == [(i, i + 5000) for i in range(40)]


def test_runs_of_keys_are_not_broadcast_for_sounds(spark, small_broadcasts):
    rows = numbered_names()
    items = spark.createDataFrame([*rows, *[(i + 5000, c, n + "!") for i, c, n in rows[:40]]], "id long, code string, name string")
    assert {(i, i + 5000) for i in range(40)} <= {(x.a, x.b) for x in dedup.phonetic_pairs(items).collect()}


def test_runs_of_stored_names_are_not_broadcast(spark, small_broadcasts, tmp_path):
    spark.createDataFrame(numbered_names(), "id long, code string, name string").write.parquet(f"{tmp_path}/items")
    items = spark.read.parquet(f"{tmp_path}/items")
    batch = items.filter("id % 50 = 0").select("id", F.substring("name", 2, 9).alias("name"))
    for most in (dedup.ASKED, 79, 80):
        assert sorted(map(tuple, dedup.containing(batch, items, asked_most=most).collect())) == [(i, i) for i in range(0, 4000, 50)]


def test_subsets_of_words_are_not_broadcast(spark, small_broadcasts):
    n = 2000  # two names of the same ten words each, one of which has a word of its own
    words = lambda i: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.substring(F.md5(F.concat_ws("-", i, k).cast("binary")), 1, 12))
    sets = spark.range(2 * n).select("id", F.concat(words(F.floor(F.col("id") / 2)), F.when(F.col("id") % 2 == 1, F.array(F.concat(F.lit("own"), "id"))).otherwise(F.array().cast("array<string>"))).alias("t"))
    shared = overlap.shared_sets(sets, F.col("t"))
    assert sorted(map(tuple, overlap.star_links(shared, 3).collect())) == [(i, i + 1) for i in range(0, 2 * n, 2)]


def test_merged_groups_without_large_broadcasts(spark, small_broadcasts):
    items = spark.createDataFrame([(i, f"k{i}", n) for i, _, n in numbered_names()] + [(i + 5000, "", n[1:]) for i, _, n in numbered_names(40)], "id long, code string, name string")
    assert sorted((x.group_id, x.id) for x in dedup.duplicate_groups(items, common_words=3).collect()) == sorted((i, j) for i in range(40) for j in (i, i + 5000))


def test_links_of_groups_without_large_broadcasts(spark, small_broadcasts):
    items = spark.createDataFrame(numbered_names(), "id long, code string, name string")
    groups, links = dedup.found_groups(items, common_words=3)
    assert groups.count() == 4000
    assert sorted(map(tuple, links.collect())) == [(i, "exact", 1, 1.0) for i in range(0, 4000, 2)]


def test_no_texts_no_pairs(spark):
    assert dedup.edit_pairs(spark.createDataFrame([], LOW), 0.85).collect() == []


# ---------------------------------------------------------------- words


def by_words(sets, least):
    """group of each id, links and mean similarity of each group, by all pairs."""
    group = {i: i for i in sets}
    linked = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least]
    for _ in sets:
        for a, b in linked:
            group[a] = group[b] = min(group[a], group[b])
    joined = {i for pair in linked for i in pair}
    out = {}
    for g in {group[i] for i in joined}:
        own = sorted(i for i in joined if group[i] == g)
        pairs = list(itertools.combinations(own, 2))
        score = sum(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs) / len(pairs)
        out[g] = (len(own), sum(len(sets[a] & sets[b]) >= least for a, b in pairs), round(score, 9), sorted(set.intersection(*(sets[i] for i in own))))
    return {i: group[i] for i in joined}, out


@pytest.mark.parametrize("least", [1, 2, 3])
@pytest.mark.parametrize("most", [4, 14])
def test_groups_by_words_are_those_of_all_pairs(spark, least, most):
    r = random.Random(least * 100 + most)
    texts = ["", "solo", "same same", "same", "one two three", "one two three"]
    texts += [" ".join({f"w{int(r.paretovariate(0.6)) % 40}" for _ in range(r.randint(1, most))}) for _ in range(70)]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    groups, told = overlap.overlap_groups(items, F.filter(F.split("name", " "), lambda w: w != ""), least)
    want_groups, want = by_words({i: set(t.split()) for i, t in enumerate(texts) if t}, least)
    assert {x.id: x.group_id for x in groups.collect()} == want_groups
    assert {x.group_id: (x.size, x.links, round(x.score, 9), x.common) for x in told.collect()} == want


def test_a_word_of_all_names_makes_few_rows(spark):
    items = spark.range(5000).select("id", F.concat(F.lit("bolt w"), F.col("id") % 1000).alias("name"))
    shared = overlap.shared_sets(items, names.tokens(F.col("name")))
    assert overlap.star_links(shared, 1).count() < 2 * 5000
    _, told = overlap.overlap_groups(items, names.tokens(F.col("name")), 1)
    assert [(r.size, r.links, r.common) for r in told.collect()] == [(5000, 5000 * 4999 // 2, ["bolt"])]


# ---------------------------------------------------------------- descents

TREE = [("A", "", "things"), ("B", "", "rest"), ("A.1", "A", "bolts"), ("A.2", "A", "nuts"), ("A.1.1", "A.1", "long bolts"), ("B.1", "B", "paint")]


def counting(path):
    """A model that writes each question on a line of a file of its task."""

    def model(asked):
        import uuid

        with open(f"{path}/{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
            f.writelines(f"{name}|{code}\n" for name, code in asked)
        steps = {"": "A", "A": "A.1", "A.1": "A.1.1"}
        return [(steps.get(code, "none"), 0.3 if name == f"stop {code}" else 0.9 - 0.01 * len(code)) for name, code in asked]

    return model


def questions(path):
    return sorted(line for f in path.iterdir() for line in f.read_text(encoding="utf-8").splitlines())


def test_one_question_a_name_and_level_and_none_again(spark, tmp_path):
    asked, store = tmp_path / "asked", tmp_path / "store"
    asked.mkdir()
    tree = spark.createDataFrame(TREE, "code string, parent_code string, name string")
    rows = spark.createDataFrame([("x",), ("x",), ("stop A",), ("stop ",), (None,)], "name string").repartition(4)
    answers = descent.Answers(spark, str(store))
    got = {r.name: (r.code, r.steps, round(r.confidence, 6)) for r in descent.descend(rows, tree, counting(str(asked)), answers=answers).collect()}
    assert got == {"x": ("A.1.1", 3, 0.87), "stop A": ("A", 1, 0.9), "stop ": ("", 0, 1.0)}
    assert questions(asked) == sorted(["x|", "stop A|", "stop |", "x|A", "stop A|A", "x|A.1"])
    more = rows.unionByName(spark.createDataFrame([("y",)], "name string"))
    again = descent.descend(more, tree, counting(str(asked)), answers=descent.Answers(spark, str(store)))
    assert again.count() == 4 and questions(asked) == sorted(["x|", "stop A|", "stop |", "x|A", "stop A|A", "x|A.1", "y|", "y|A", "y|A.1"])


def test_the_whole_classifier(spark, tmp_path):
    tree = spark.createDataFrame([("A", "", "things"), ("A.1", "A", "bolts"), ("33.1", "", "услуги"), ("25.93.11", "", "болты")], "code string, parent_code string, name string")
    rows = spark.createDataFrame([(1, "болт м10", "keep"), (2, "ремонт", "keep"), (3, "known thing", "keep"), (4, None, "keep"), (5, "болт м10", "keep")], "id int, normalized_name string, code string")
    roots = spark.createDataFrame([("known", "A.1", 0.95), ("ремонт", "A.1", 0.5)], "root string, code string, confidence double")
    asked = tmp_path / "asked"
    asked.mkdir()
    got = descent.classify_fully(rows, tree, counting(str(asked)), lambda n, r: F.lit(True), roots=roots).collect()
    told = {r.id: (r.code, r.title, r.by, r.mended) for r in got}
    assert told == {1: ("25.93.11", "болты", "keyword", ""), 2: ("A.1", "bolts", "model", ""), 3: ("A.1", "bolts", "root", ""), 4: (None, None, None, None), 5: ("25.93.11", "болты", "keyword", "")}
    assert questions(asked) == ["ремонт|", "ремонт|A"]
    learned = descent.sure_roots(spark.createDataFrame([("known thing", "A.1", 0.95), ("known", "A", 0.99), ("vague", "B", 0.5)], "normalized_name string, code string, confidence double"))
    assert [tuple(r) for r in learned.collect()] == [("known", "A", 0.99)]


def test_reclassified_rows_keep_what_has_no_answer(spark):
    rows = [(1, "болт м8", "own", "", 0.1), (2, "ничего", "own", "", 0.2), (3, "болт м9", "own", "1.2", 0.3), (4, None, "own", None, None), (5, "болт", "own", None, None)]
    items = spark.createDataFrame(rows, "id int, normalized_name string, code string, kpved_code string, kpved_confidence double").withColumn("root", F.lit("r")).withColumn("confidence", F.lit("c"))
    got = {r.id: (r.code, r.kpved_code, r.kpved_confidence, r.root, r.confidence, r.reclassified) for r in classify.reclassify(items).collect()}
    assert got == {
        1: ("own", "25.93.11", 0.98, "r", "c", True), 2: ("own", "", 0.2, "r", "c", False), 3: ("own", "1.2", 0.3, "r", "c", False),
        4: ("own", None, None, "r", "c", False), 5: ("own", "25.93.11", 0.98, "r", "c", True),
    }
    every = {r.id: r.kpved_code for r in classify.reclassify(items.drop("code"), where=F.col("kpved_code") == "1.2").collect()}
    assert every == {1: "", 2: "", 3: "25.93.11", 4: None, 5: None}
