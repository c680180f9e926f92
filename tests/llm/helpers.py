"""Shared fixtures of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=""):
    """A documents table of the texts; ``extra`` adds columns whose names clash with those that operators make."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in filter(None, extra.split()):
        df = df.selectExpr("*", f"'x' as `{c}`")
    return df


ODD = [None, "", " ", "\n", "a", "é x", "x" * 300_000, "same text here", "same text here", "same  text\there", "\x0b line \r\n line "]


def prose(n, seed=3, words=60):
    """``n`` texts of random words, with exact and near copies."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    out = []
    for i in range(n):
        if i > 5 and i % 4 == 0:
            w = out[r.randrange(len(out))].split(" ")
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choice(vocabulary) for _ in range(r.randint(1, words))))
    return out
