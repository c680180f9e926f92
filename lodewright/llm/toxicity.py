"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each model is a logistic
regression over chosen words and word beginnings, and over the probabilities of
all earlier categories; it is trained with their out-of-fold predictions, so it
sees them as unsure as they will be on new documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, table

#: The models are fitted on so many labelled documents at most, half of them of the last category where it has enough.
TRAIN_ROWS = 12_000
#: Features chosen for each category, by chi-squared.
FEATURES = 192
#: Documents of the sample that must have a feature.
LEAST_DOCS = 4
#: Lengths of word beginnings that are features.
STEMS = (4, 5, 6)
FOLDS = 5
RIDGE = 0.01
#: Feature counts, and words, that a task holds before it passes them on or forgets them.
HELD = 400_000

WORD = re.compile(r"\w+")


def word_features(word: str) -> set[str]:
    """The word and its beginnings; beginnings end in a hyphen."""
    return {word, *(word[:k] + "-" for k in STEMS if len(word) >= k)}


def text_features(text: str | None) -> set[str]:
    return {f for w in set(WORD.findall((text or "").lower())) for f in word_features(w)}


@dataclass
class Linear:
    """Logistic regression over standardised columns of 0/1 features and chained log-odds."""

    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = RIDGE) -> Linear:
        """Newton's method; with one class only the bias tells the smoothed rate."""
        w = w / w.mean() if len(w) else w
        rate = (w @ y + 1) / (w.sum() + 2)
        if not len(y) or y.min() == y.max():
            return cls(np.zeros(x.shape[1]), float(np.log(rate / (1 - rate))))
        full = np.hstack([x, np.ones((len(x), 1))])
        beta = np.zeros(full.shape[1])
        beta[-1] = np.log(rate / (1 - rate))
        penalty = np.full(full.shape[1], ridge * np.sqrt(len(x)) / 4)
        penalty[-1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(full @ beta, -35, 35)))
            gradient = full.T @ (w * (p - y)) + penalty * beta
            hessian = (full * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ full + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            step *= min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
            beta -= step
            if np.abs(step).max() < 1e-6:
                break
        return cls(beta[:-1], float(beta[-1]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -35, 35)))


def _odds(p: np.ndarray) -> np.ndarray:
    """Log-odds within a few units, so that a sure model doesn't drown the words."""
    q = np.clip(p, 0.02, 0.98)
    return np.log(q / (1 - q))


@dataclass
class Chain:
    """One model per category, in order; ``features`` are their common columns."""

    categories: list[str]
    features: list[str]
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)
    #: Out-of-fold probabilities of the training rows, by category.
    held_out: np.ndarray | None = None

    @classmethod
    def fit(cls, categories: list[str], features: list[str], x: np.ndarray, y: np.ndarray, w: np.ndarray, folds: int = FOLDS) -> Chain:
        """``x`` rows by features, ``y`` rows by categories, ``w`` row weights."""
        chain = cls(categories, features)
        fold = np.arange(len(x)) % folds
        out = np.zeros((len(x), len(categories)))
        for j in range(len(categories)):
            z = np.hstack([x, _odds(out[:, :j])])
            for k in range(folds):
                test = fold == k
                if test.any():
                    out[test, j] = Linear.fit(z[~test], y[~test, j], w[~test]).predict(z[test])
            chain.models.append(Linear.fit(z, y[:, j], w))
            chain.thresholds.append(best_threshold(out[:, j], y[:, j], w))
        chain.held_out = out
        return chain

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.categories)))
        for j, m in enumerate(self.models):
            out[:, j] = m.predict(np.hstack([x, _odds(out[:, :j])]))
        return out


def best_threshold(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The probability from which on to say yes: of 0.05 to 0.95, the nearest to a half whose F1 is within 0.002 of the best."""
    if not (y == 1).any():
        return 2.0  # nothing to learn from: never
    found = []
    for t in sorted(np.arange(1, 20) / 20, key=lambda t: abs(t - 0.5)):
        yes = p >= t
        hit = (w * (yes & (y == 1))).sum()
        f1 = 2 * hit / max(1e-9, (w * yes).sum() + (w * (y == 1)).sum())
        found.append((f1, float(t)))
    top = max(found)[0]
    return next(t for f1, t in found if f1 >= top - 0.002)


def _matrix(texts: list[str | None], index: dict[str, int], known: dict[str, tuple[int, ...]]) -> np.ndarray:
    x = np.zeros((len(texts), len(index)))
    for i, t in enumerate(texts):
        for word in set(WORD.findall((t or "").lower())):
            at = known.get(word)
            if at is None:
                if len(known) > HELD:
                    known.clear()
                at = known[word] = tuple(index[f] for f in word_features(word) if f in index)
            for k in at:
                x[i, k] = 1.0
    return x


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int = TRAIN_ROWS, features: int = FEATURES, ident: str = "doc_id", text: str = "text") -> Chain:
    """``categories``: name and boolean column over ``labels``, in the order of the chain.

    The sample is the ``rows`` labelled documents of the lowest hash, half of
    them of the last category, half not (fewer where there are fewer), weighted
    back to their shares. Labels of a document are joined by ``or``; null labels
    and ids are left out. Of the rows of one id the smallest text is read, so that
    the sample is bounded however often an id repeats.
    """
    names = list(categories)
    last = names[-1]
    told = labels.filter(F.col(f"`{ident}`").isNotNull()).select(F.col(f"`{ident}`").cast("long").alias("id"), *[c.cast("int").alias(n) for n, c in categories.items()])
    told = told.groupBy("id").agg(*[F.max(n).alias(n) for n in names]).dropna()
    order = F.md5(F.col("id").cast("string").cast("binary"))
    halves = [told.filter(F.col(last) == v).orderBy(order, "id").limit(rows // 2) for v in (0, 1)]
    sizes = {r[0]: r[1] for r in told.groupBy(last).count().collect()}
    # at most ``rows`` rows of a few integers
    sample = F.broadcast(halves[0].unionByName(halves[1]))
    texts = docs.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    mine = texts.join(sample, "id").groupBy("id", *names).agg(F.min("text").alias("text"))
    mine = staged(mine.select("id", "text", *names), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            table = np.array(list(held.values())).reshape(-1, 1 + len(names))
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *[pa.array(table[:, k]) for k in range(1 + len(names))]], ["feature", "n", *names])

        for b in batches:
            marks = np.stack([np.ones(len(b), np.int64), *[b.column(2 + k).to_numpy().astype(np.int64) for k in range(len(names))]], 1)
            for t, m in zip(b.column(1).to_pylist(), marks, strict=True):
                for f in text_features(t):
                    if f in held:
                        held[f] += m
                    else:
                        held[f] = m.copy()
                if len(held) > HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    counts = mine.mapInArrow(count, "feature string, n long" + "".join(f", `{n}` long" for n in names))
    counts = counts.groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names]).filter(F.col("n") >= LEAST_DOCS)
    counts = staged(counts, "toxicity-features")
    totals = mine.agg(F.count("*").cast("double"), *[F.sum(n).cast("double") for n in names]).first()
    chosen: set[str] = set()
    for k, n in enumerate(names):
        all_rows, yes = totals[0] or 0.0, totals[1 + k] or 0.0
        if not 0 < yes < all_rows:
            continue
        a, m = F.col(n).cast("double"), F.col("n").cast("double")
        lift = a * all_rows - m * yes
        chi = lift * lift / (m * (all_rows - m + 1e-9) * yes * (all_rows - yes))
        chosen |= {r[0] for r in counts.select("feature", F.round(chi, 9).alias("chi")).orderBy(F.desc("chi"), "feature").limit(features).collect()}
    words = sorted(chosen)
    index = {f: i for i, f in enumerate(words)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            x = _matrix(b.column(1).to_pylist(), index, known)
            bits = [np.packbits(row.astype(np.uint8)).tobytes() for row in x]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary()), *[b.column(2 + k) for k in range(len(names))]], ["id", "bits", *names])

    # the sample's rows, each of a few hundred bits
    got = sorted(mine.mapInArrow(vectors, "id long, bits binary" + "".join(f", `{n}` int" for n in names)).collect())
    x = np.array([np.unpackbits(np.frombuffer(r[1], np.uint8))[: len(words)] for r in got], float).reshape(len(got), len(words))
    y = np.array([r[2:] for r in got], float).reshape(len(got), len(names))
    share = {v: sizes.get(v, 0) / max(1, min(rows // 2, sizes.get(v, 0))) for v in (0, 1)}
    w = np.array([share[int(r[-1])] for r in got], float)
    return Chain.fit(names, words, x, y, w)


def score(docs: DataFrame, chain: Chain, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` plus ``p_<category>`` for each category and the boolean ``is_<category>`` for the last.

    A null text has no words; null ids play no part, and repeated rows get equal
    scores, each its own row. A probability at the threshold counts. Of input
    columns named like a new one the new one wins. An empty table gives no rows.
    """
    new = [T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories] + [T.StructField(f"is_{chain.categories[-1]}", T.BooleanType())]
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in [f.name.lower() for f in new]])
    schema = T.StructType(docs.schema.fields + new)
    at, names = docs.columns.index(text), schema.names
    index = {f: i for i, f in enumerate(chain.features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.slice(k, 500)
                p = chain.predict(_matrix(part.column(at).to_pylist(), index, known))
                yes = p[:, -1] >= chain.thresholds[-1]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(p[:, j]) for j in range(p.shape[1])], pa.array(yes)], names)

    return docs.mapInArrow(run, schema)


def label_categories() -> dict[str, Column]:
    """The chain over ``labels``: low quality first, then toxic. The first is no
    kind of toxicity, but ``labels`` has these two categories only; a table with
    finer ones gives a longer chain by the same code."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def toxic_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` scored by a chain trained on the labelled rows of ``documents`` in ``sf_dir``."""
    chain = train_chain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label_categories())
    return score(docs, chain)


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: probability of each category, and whether the document is toxic."""
    scored = toxic_scores(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return scored.select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), F.col("is_toxic").alias("toxic"))
