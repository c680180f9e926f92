"""Secret scan with a random forest that removes false positives.

Candidates, their features and the forest's votes are built-in expressions
alone. What words look like (a dictionary and how often one letter follows
another) is learned from the scanned texts; the forest is trained on labelled
findings and then written out as nested CASE expressions, so scoring needs no
model object on the executors.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Names that introduce a secret, and words of harmless values.
NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key"
HARMLESS = "example sample test dummy fake placeholder change changeme your here insert none null true false default value key token secret password user name admin root local host".split()
#: Words that name identifiers which are no secrets.
DIGESTS = r"sha-?\d*|md5|crc32|commit|checksum|digest|revision|etag|uuid|guid|build|serial|\bid\b"

#: Characters of text before and after a candidate that are looked at.
NEAR = 48
#: Labelled findings that the forest is trained on.
FINDINGS = 8_000
TREES, DEPTH, SEED = 15, 8, 11
#: Words of the dictionary learned from texts: those that most texts have.
WORDS = 4_000
#: Letters of a word that is learned; those of four or more count as covered.
LETTERS = (3, 20)

_RUN = r"A-Za-z0-9+/_=.\-"
#: A telling name and what leads from it to its value.
_LEAD = rf"(?i:{NAMES})[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?"
#: A lead with its value, or a long run with a digit in it. Never empty, so that splitting at it gives one part more.
CANDIDATE = rf"{_LEAD}[^\s\"'<>:=]{{6,}}|(?<![{_RUN}])(?=[{_RUN}]*[0-9])[{_RUN}]{{16,}}"
#: What stands before the value in a match.
LEADING = rf"^([A-Za-z0-9_.\-]*{_LEAD})(?=[^\s\"'<>:=]{{6}})"
#: A text without any of these has no candidate; most texts end here, at a single pass.
NEEDED = "[0-9:=]"
#: The characters that are told apart when distinct ones are counted.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-"

FEATURES = ["length", "turns", "transitions", "digits", "uppers", "distinct", "vowels", "hex", "covered", "assigned", "named", "quoted", "harmless_words", "digest_words", "contact", "harmless_path", "code_path", "prefix"]


@dataclass(frozen=True)
class Language:
    """What words look like: the dictionary, in any script, and the log-odds of a
    pair of the letters a to z in words against equal chance."""

    words: tuple[str, ...]
    pairs: dict[str, float]

    @classmethod
    def of(cls, counts: list[tuple[str, int]]) -> Language:
        """From words and the number of texts that have each. With no words every pair is as likely as any other."""
        seen: Counter = Counter()
        for word, n in counts:
            for a, b in zip(word, word[1:], strict=False):
                seen[a + b] += n
        first: Counter = Counter()
        for pair, n in seen.items():
            first[pair[0]] += n
        letters = "abcdefghijklmnopqrstuvwxyz"
        odds = {a + b: round(math.log((seen[a + b] + 1) / (first[a] + 26) * 26), 4) for a in letters for b in letters}
        return cls(tuple(sorted({w for w, _ in counts if len(w) > 3} | set(HARMLESS))), odds)


def longest_word(words: tuple[str, ...]) -> str:
    """A pattern of the longest of ``words`` at a place: words that begin alike share
    their beginning, so a place is looked at letter by letter, whatever their number."""
    tree: dict = {}
    for w in words:
        node = tree
        for letter in w:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        after = [c + pattern(n) for c, n in sorted(node.items()) if c]
        if not after:
            return ""
        inner = after[0] if len(after) == 1 and "" not in node else f"(?:{'|'.join(after)})"
        return inner + "?" * ("" in node)

    return pattern(tree)


def learn_language(docs: DataFrame, text: str = "text", words: int = WORDS) -> Language:
    """From the ``words`` words of lower-case letters of any script that most texts have; all texts are counted."""
    each = F.array_distinct(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"\P{Ll}+"))
    counted = docs.select(F.explode(each).alias("word")).filter(F.length("word").between(*LETTERS)).groupBy("word").agg(F.count("*").alias("n"))
    return Language.of([(r[0], r[1]) for r in counted.orderBy(F.desc("n"), "word").limit(words).collect()])


def candidates(docs: DataFrame, ident: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, path, ordinal, before, candidate, after): every candidate of every text, with its neighbourhood."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{ident}`").alias("doc_id"), F.coalesce(F.col(f"`{path}`"), F.lit("")).alias("path"), whole.alias("t")).filter(F.col("t").rlike(NEEDED))
    rows = rows.withColumn("found", F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0))).filter(F.size("found") > 0)
    parts = F.split("t", CANDIDATE, -1)
    near = F.transform(parts, lambda x: F.struct(F.substring(x, 1, NEAR).alias("head"), F.substring(x, -NEAR, NEAR).alias("tail")))
    rows = rows.select("doc_id", "path", "found", near.alias("near"))
    each = F.zip_with("found", F.slice("near", 2, F.size("found")), lambda c, after: F.struct(c.alias("c"), after["head"].alias("after")))
    both = F.zip_with(each, F.slice("near", 1, F.size("found")), lambda c, before: F.struct(c["c"].alias("match"), before["tail"].alias("before"), c["after"].alias("after")))
    rows = rows.select("doc_id", "path", F.posexplode(both)).select("doc_id", "path", F.col("pos").alias("ordinal"), "col.*")
    lead = F.regexp_extract("match", LEADING, 1)
    value = F.expr("substring(match, length(lead) + 1)")
    return rows.withColumn("lead", lead).select("doc_id", "path", "ordinal", F.concat("before", "lead").alias("before"), value.alias("candidate"), "after")


def features(found: DataFrame, language: Language) -> DataFrame:
    """``found`` plus a double column for each of ``FEATURES``, all of them over whole candidates."""
    c, before, after, path = F.col("candidate"), F.lower("before"), F.lower("after"), F.lower("path")
    n = F.length(c)
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    classes = F.translate(c, lower + upper + "0123456789", "a" * 26 + "A" * 26 + "0" * 10)
    turns = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) / n
    # letter pairs: 26 by 26 odds, a pair with anything but letters counts as the least likely ones do
    letters = F.split(F.lower(c), "")
    odds = F.create_map(*[F.lit(x) for p in language.pairs.items() for x in p])
    told = F.transform(F.arrays_zip(F.slice(letters, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(letters, 2, F.greatest(n - 1, F.lit(0))).alias("b")), lambda p: F.coalesce(F.try_element_at(odds, F.concat(p["a"], p["b"])), F.lit(-2.0)))
    mean = F.aggregate(told, F.lit(0.0), lambda a, x: a + x) / F.greatest(n - 1, F.lit(1))
    alphabet = F.array(*map(F.lit, ALPHABET))
    known = longest_word(language.words)

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(c, pattern, "")) / n

    def tells(where: Column, pattern: str) -> Column:
        return where.rlike(pattern).cast("double")

    made = {
        "length": n.cast("double"),
        "turns": turns,
        "transitions": mean,
        "digits": share("[^0-9]"),
        "uppers": share("[^A-Z]"),
        "distinct": F.size(F.filter(alphabet, lambda x: c.contains(x))) / F.least(n, F.lit(len(ALPHABET))),
        "vowels": share("[^aeiouAEIOU]"),
        "hex": c.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"),
        "covered": 1 - F.length(F.regexp_replace(F.lower(c), known, "")) / n,
        "assigned": tells(before, r"[:=]\s*[\"']?$"),
        "named": tells(before, rf"(?:{NAMES})[\"']?\s*[:=]?\s*[\"']?$"),
        "quoted": (before.rlike(r"[\"']$") & after.rlike(r"^[\"']")).cast("double"),
        "harmless_words": tells(F.concat(before, F.lit(" "), after), r"example|sample|dummy|fake|placeholder|test|\byour\b"),
        "digest_words": tells(before, DIGESTS),
        "contact": (c.rlike(r"^[+\d().\-]+$") | after.rlike("^@") | before.rlike("@$") | c.rlike(r"\.(com|org|net|html?|png|jpe?g|js|css|txt)\b")).cast("double"),
        "harmless_path": tells(path, r"test|example|sample|fixture|mock|doc"),
        "code_path": tells(path, r"\.(py|js|ts|go|java|rb|env|ya?ml|json|ini|cfg|conf|properties)$"),
        "prefix": c.rlike(r"^(AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xox[bp]-|AIza|glpat-|eyJ)").cast("double"),
    }
    return found.withColumns({k: v.cast("double") for k, v in made.items()})


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """``n`` labelled findings made by rule from hashed row numbers: path,
    before, candidate, after and label (1: a secret). They follow what
    credentials and the usual false alarms look like anywhere, not any one
    table; the kinds are equally frequent. Real labelled findings of the same
    columns serve as well.
    """
    i = F.col("id").cast("string")

    def draw(salt: str) -> Column:
        return F.sha2(F.concat(F.lit(salt), i).cast("binary"), 256)

    def number(salt: str, below: int) -> Column:
        return F.conv(F.substring(draw(salt), 1, 7), 16, 10).cast("int") % below

    def pick(salt: str, options: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), number(salt, len(options)) + 1)

    def cut(c: Column, salt: str, least: int, most: int) -> Column:
        return F.substring(c, F.lit(1), F.lit(least) + number(salt, most - least + 1))

    def chars(salt: str, kept: str) -> Column:
        """Some eighty random characters of a class."""
        return F.regexp_replace(F.concat(F.base64(F.unhex(draw(salt))), F.base64(F.unhex(draw(salt + "2")))), f"[^{kept}]", "")

    nouns = "river stone table window garden silver winter market letter report system server customer invoice order module record session".split()
    word, other = pick("w1", nouns), pick("w2", nouns)
    digits = F.translate(F.concat(draw("num"), draw("num2")), "abcdef", "012345")
    name = pick("name", ["token", "secret", "api_key", "apikey", "access_key", "auth_token", "password", "passwd", "client_secret", "private_key", "credential"])
    opening, closing = pick("eq", [' = "', '="', ": '", '": "', "=", ": ", " = '"]), pick("close", ['"', '",', "'", "\n", ";", '")', " "])
    given = F.concat(pick("intro", ["", "export ", "set ", "  ", "the ", "const ", "and "]), name, opening)
    prose = F.concat(pick("lead", ["see ", "on the ", "and then ", "with ", "(", "> ", "from "]), word, pick("gap", [" ", ": ", ", ", " - "]))
    digest = pick("dig", ["commit ", "sha256: ", "md5 checksum ", "revision = ", "etag: ", "uuid ", "digest ", "build id "])
    rest = pick("rest", [" ", "\n", ", ", ". ", " and ", ")"])
    random_chars, alnum = chars("mix", "A-Za-z0-9+/"), chars("alnum", "A-Za-z0-9")
    mark = pick("mark", list("!@#$%&*?"))
    kinds = [
        (given, F.substring(draw("hex"), 1, 32), closing, 1),
        (given, cut(draw("hex2"), "len", 24, 64), closing, 1),
        (given, cut(random_chars, "len2", 20, 60), closing, 1),
        (given, cut(alnum, "len3", 10, 24), closing, 1),
        (given, F.concat(cut(alnum, "len4", 5, 9), mark, F.substring(digits, 1, 3)), closing, 1),
        (F.concat(pick("aws", ["aws_access_key_id = ", "AccessKeyId: ", "using ", "key "])), F.concat(F.lit("AKIA"), F.substring(F.upper(alnum), 1, 16)), rest, 1),
        (prose, F.concat(pick("pre", ["ghp_", "sk_live_", "glpat-", "xoxb-", "AIza"]), cut(alnum, "len5", 24, 40)), rest, 1),
        (F.concat(pick("jwt", ["Bearer ", "token=", "jwt: ", "Authorization: "])), F.concat(F.lit("eyJ"), cut(alnum, "len6", 20, 30), F.lit("."), F.substring(chars("j2", "A-Za-z0-9_"), 1, 30)), rest, 1),
        (digest, cut(draw("b"), "len7", 32, 40), rest, 0),
        (digest, draw("c"), rest, 0),
        (digest, F.concat_ws("-", F.substring(draw("u"), 1, 8), F.substring(draw("u"), 9, 4), F.substring(draw("u"), 13, 4), F.substring(draw("u"), 17, 4), F.substring(draw("u"), 21, 12)), rest, 0),
        (given, pick("ph", ["changeme123", "your_api_key_here", "example-token-1234", "placeholder_value_1", "test_password_12", "dummysecretvalue00", "insert-your-key-here", "<redacted>", "xxxxxxxxxxxx", "none_default", "os.environ", "config.get_secret()"]), closing, 0),
        (given, F.concat(word, pick("join", ["_", ".", "-", ""]), other, pick("tail", ["", "_name", ".value", "1", "_01"])), closing, 0),
        (prose, F.concat(F.substring(digits, 1, 3), pick("tel", ["-", ".", ""]), F.substring(digits, 4, 3), pick("tel2", ["-", "."]), F.substring(digits, 7, 10)), rest, 0),
        (prose, cut(digits, "len8", 16, 20), rest, 0),
        (prose, F.concat_ws("-", F.concat(F.lit("20"), F.substring(digits, 1, 2)), F.lit("10"), F.concat(F.substring(digits, 3, 2), F.lit("T12.30.00"), F.substring(digits, 5, 3))), rest, 0),
        (prose, F.concat(word, F.lit("."), other, F.lit("."), F.substring(digits, 1, 3), pick("mail", ["", "-info", ".team"])), F.concat(F.lit("@"), other, F.lit(".org ")), 0),
        (F.concat(pick("url", ["https://", "see ", "http://"])), F.concat(F.lit("www."), word, other, pick("tld", [".com/", ".org/", ".net/"]), word, F.substring(digits, 1, 3), pick("end", [".html", "/index", ".png", ""])), rest, 0),
        (prose, F.concat(pick("dir", ["src/", "/usr/lib/", "build/", "../"]), word, F.lit("/"), other, F.lit("_v"), F.substring(digits, 1, 2), pick("ext", [".py", ".json", ".tar.gz", ".js"])), rest, 0),
        (prose, F.concat(word, pick("w3", ["_", "-", "."]), other, F.substring(digits, 1, 2), pick("w4", ["_", "-", "."]), word), rest, 0),
        (prose, F.concat(F.initcap(word), F.initcap(other), F.initcap(word), F.substring(digits, 1, 2), F.initcap(other)), rest, 0),
    ]
    at = (F.col("id") % len(kinds)) + 1
    options = F.array(*[F.struct(b.alias("before"), c.alias("candidate"), a.alias("after"), F.lit(y).alias("label")) for b, c, a, y in kinds])
    path = pick("path", ["web", "forum", "app/settings.py", "conf/prod.yaml", "readme", "mail", "web/page.html", "service.env", ""])
    shown = F.when((F.col("k.label") == 0) & (number("where", 5) == 0), F.lit("tests/fixture.txt")).otherwise(path)
    return spark.range(n).withColumn("k", F.element_at(options, at.cast("int"))).select(shown.alias("path"), "k.before", "k.candidate", "k.after", "k.label")


def _vote(node, names: list[str]) -> Column:
    """Share of secrets in the leaf that a row reaches."""
    if node.subtreeDepth() == 0:
        stats = node.impurityStats()
        return F.lit(float(stats.stats()[1]) / max(1e-9, float(stats.stats()[0]) + float(stats.stats()[1])))
    split = node.split()
    return F.when(F.col(names[split.featureIndex()]) <= float(split.threshold()), _vote(node.leftChild(), names)).otherwise(_vote(node.rightChild(), names))


def fit_model(findings: DataFrame, language: Language, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """A random forest of Spark's ML library over ``FEATURES``, gathered in column x, from labelled findings."""
    from pyspark.ml.classification import RandomForestClassifier

    rows = feature_vectors(findings, language).select("x", F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2).fit(rows)


def feature_vectors(findings: DataFrame, language: Language) -> DataFrame:
    """``findings`` plus the features, and all of them as a vector x."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=FEATURES, outputCol="x").transform(features(findings, language))


def as_expressions(model) -> list[Column]:
    """One expression over ``FEATURES`` per tree of the model."""
    return [_vote(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode"), FEATURES) for t in model.trees]


def train_forest(findings: DataFrame, language: Language, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Column]:
    """One expression over ``FEATURES`` per tree, from labelled findings."""
    return as_expressions(fit_model(findings, language, trees, depth, seed))


def scan_secrets(docs: DataFrame, forest: list[Column], language: Language, ident: str = "doc_id", text: str = "text", path: str = "source", threshold: float = 0.5) -> DataFrame:
    """Every candidate with ``p_secret``, the forest's mean vote, and ``secret``: a
    mean vote of ``threshold`` or more, so a tie at it counts as a secret.

    A null text has no candidates and a null path is empty. Null ids and
    repeated rows give their findings again. An empty table gives no rows.
    Other columns of ``docs``, whatever their names, are not read.
    """
    scored = features(candidates(docs, ident, text, path), language).withColumn("p_secret", reduce(lambda a, b: a + b, forest) / len(forest))
    return scored.withColumn("secret", F.col("p_secret") >= threshold)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in all ``documents``; ``source`` stands for the path."""
    docs = table(spark, sf_dir, "documents")
    language = learn_language(docs)
    found = scan_secrets(docs, train_forest(labelled_findings(spark), language), language)
    return found.select("doc_id", "ordinal", F.length("candidate").alias("length"), F.sha2(F.encode("candidate", "UTF-8"), 256).alias("candidate_sha256"), F.substring("candidate", 1, 4).alias("starts"), F.round("p_secret", 6).alias("p_secret"), "secret")
