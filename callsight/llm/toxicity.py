"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. The logistic model of each sees the text's
features and the probabilities of the categories before it; in training those are out-of-fold
predictions, so a later model learns from probabilities as good as those it will meet.

Features of a text are its distinct words (small letters, ASCII marks dropped) and their
beginnings of PREFIXES bytes, hashed to DIMENSIONS numbers, so that inflected and joined
forms share what their beginning tells. A feature is weighted by its smoothed log odds
between the classes before the logistic fit, so that the many that tell nothing weigh
nothing. The threshold of a category is the one with the fewest errors on the out-of-fold
predictions. The models are fitted on a bounded sample: of the labelled documents, those
MAX_LABELLED with the smallest hash of their id. Scoring covers all documents and keeps
nothing but the weights and a bounded word cache.

Defined cases: null and empty texts have no features and get the intercept's probability;
repeated labels of a document count by their maximum; a null label leaves the document out
of that category's training; a category without both classes always predicts its share;
without any labelled row it is 0. A threshold is never below
MIN_THRESHOLD. Columns of the input named like an added one are replaced.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsight.llm.common import WordCache, text_bytes, worker_state

MAX_LABELLED = 4000
DIMENSIONS = 1 << 18
PREFIXES = (4, 5, 6)
FOLDS = 3
STEPS = 60
RATE = 0.1
DECAY = 1e-3
SMOOTHING = 4.0  # documents that a feature is taken to have been in, split as all documents
MIN_THRESHOLD = 0.05

LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def distinct_words(text: bytes) -> list[bytes]:
    return sorted(set(text.translate(LETTERS).split()))


def word_features(word: bytes) -> list[int]:
    """The word itself, then its beginnings that are shorter than the word."""
    parts = [b"=" + word] + [b"%d" % n + word[:n] for n in PREFIXES if n <= len(word)]
    return [zlib.crc32(p) % DIMENSIONS for p in parts]


@dataclass
class Rows:
    """Sparse rows: features `at` with `value`, a row's part from `start`."""

    at: np.ndarray
    value: np.ndarray
    start: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.start)[rows]
        chosen = np.zeros(len(self.start) - 1, bool)
        chosen[rows] = True
        keep = np.repeat(chosen, np.diff(self.start))
        return Rows(self.at[keep], self.value[keep], np.concatenate([[0], np.cumsum(sizes)]))


@dataclass
class Linear:
    """A logistic model: weights of hashed features, of earlier probabilities, intercept;
    from `threshold` on it says yes."""

    weights: np.ndarray
    earlier: np.ndarray
    intercept: float
    threshold: float = 0.5

    def predict(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        text = np.bincount(rows.row, rows.value * self.weights[rows.at], len(rows.start) - 1)
        return sigmoid(text + earlier @ self.earlier + self.intercept)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def log_odds(rows: Rows, y: np.ndarray) -> np.ndarray:
    """Of each feature: how much likelier it is in texts of the class, as a logarithm."""
    held = np.bincount(rows.at, minlength=DIMENSIONS)
    yes = np.bincount(rows.at, y[rows.row], DIMENSIONS)
    share = y.mean()
    odds = np.log((yes + SMOOTHING * share) / share) - np.log((held - yes + SMOOTHING * (1 - share)) / (1 - share))
    return np.where(held > 0, odds, 0.0)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Between the predictions where yes from there on gives the fewest errors; the middle one of equals."""
    order = np.argsort(p, kind="stable")
    p, y = p[order], y[order]
    errors = np.concatenate([[0], np.cumsum(2 * y - 1)])
    best = np.flatnonzero(errors == errors.min())
    at = int(best[len(best) // 2])
    between = np.concatenate([[0.0], p, [1.0]])
    return max(MIN_THRESHOLD, float((between[at] + between[at + 1]) / 2))


def fit_one(rows: Rows, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """Logistic regression over log-odds features by full gradients with a rate per weight."""
    model = Linear(np.zeros(DIMENSIONS), np.zeros(earlier.shape[1]), 0.0)
    share = float(y.mean()) if len(y) else 0.0
    model.intercept = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    if share in (0.0, 1.0):
        return model
    odds = log_odds(rows, y)
    rows = Rows(rows.at, rows.value * odds[rows.at], rows.start)
    row = rows.row
    seen, seen_earlier, seen_one = np.full(DIMENSIONS, 1e-8), np.full(earlier.shape[1], 1e-8), 1e-8
    for _ in range(STEPS):
        error = (model.predict(rows, earlier) - y) / len(y)
        slope = np.bincount(rows.at, rows.value * error[row], DIMENSIONS) + DECAY * model.weights
        slope_earlier, slope_one = earlier.T @ error + DECAY * model.earlier, float(error.sum())
        seen += slope**2
        seen_earlier += slope_earlier**2
        seen_one += slope_one**2
        model.weights -= RATE * slope / np.sqrt(seen)
        model.earlier -= RATE * slope_earlier / np.sqrt(seen_earlier)
        model.intercept -= RATE * slope_one / math.sqrt(seen_one)
    model.weights *= odds
    return model


def fit_chain(rows: Rows, labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """One model per column of `labels` (1, 0, or nan where it is not known)."""
    models = []
    earlier = np.zeros((len(labels), 0))
    for k in range(labels.shape[1]):
        known = ~np.isnan(labels[:, k])
        out_of_fold = np.zeros(len(labels))
        for fold in range(FOLDS):
            rest = np.flatnonzero(known & (folds != fold))
            own = np.flatnonzero(folds == fold)
            model = fit_one(rows.take(rest), earlier[rest], labels[rest, k])
            out_of_fold[own] = model.predict(rows.take(own), earlier[own])
        all_known = np.flatnonzero(known)
        models.append(fit_one(rows.take(all_known), earlier[all_known], labels[all_known, k]))
        if len(all_known):
            models[-1].threshold = best_threshold(out_of_fold[all_known], labels[all_known, k])
        earlier = np.column_stack([earlier, out_of_fold])
    return models


def text_row(text: bytes, cache: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their values; a feature counts the distinct words that have it."""
    words = distinct_words(text)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at, times = np.unique(np.concatenate([cache[w] for w in words]), return_counts=True)
    return at.astype(np.int32), (times / math.sqrt(len(words))).astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, categories: list[str]) -> DataFrame:
    """At most MAX_LABELLED labelled documents, the same ones at every run; of several texts with one
    id the smallest by its bytes."""
    known = labels.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories]).where("doc_id is not null")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    texts = docs.select(F.col("doc_id"), text_bytes().alias("text"))
    # The bound on the labelled rows is a bound on what is sent around.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *categories).agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, categories: list[str]) -> list[Linear]:
    """The chain, fitted on the driver: it gets the features of at most MAX_LABELLED texts."""

    def featurize(batches):
        cache = WordCache(lambda w: np.array(word_features(w), np.int32))
        for batch in batches:
            got = [text_row(t, cache.fresh()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([a.tobytes() for a, _ in got], pa.binary()),
                    pa.array([v.tobytes() for _, v in got], pa.binary()),
                    *[batch.column(c) for c in categories],
                ],
                names=["doc_id", "at", "value", *categories],
            )

    rows = sample(docs, labels.select("doc_id", *[F.col(c).cast("double").alias(c) for c in categories]), categories)
    ddl = "doc_id long, at binary, value binary" + "".join(f", {c} double" for c in categories)
    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *categories).mapInArrow(featurize, ddl).toArrow()
    got = got.sort_by("doc_id")
    at = [np.frombuffer(b, np.int32) for b in got["at"].to_pylist()]
    value = [np.frombuffer(b, np.float32) for b in got["value"].to_pylist()]
    start = np.concatenate([[0], np.cumsum([len(a) for a in at])]).astype(np.int64)
    ids = got["doc_id"].to_numpy()
    folds = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in ids], int)
    empty = [np.zeros(0, np.int32)]
    sparse = Rows(np.concatenate([*empty, *at]).astype(np.int64), np.concatenate([*empty, *value]).astype(float), start)
    known = np.column_stack([got[c].to_numpy(zero_copy_only=False).astype(float) for c in categories])
    # A feature of a single text tells nothing about others.
    common = np.bincount(sparse.at, minlength=DIMENSIONS)[sparse.at] > 1
    counts = np.add.reduceat(np.append(common, 0), start[:-1]) * (np.diff(start) > 0) if len(ids) else np.zeros(0, int)
    sparse = Rows(sparse.at[common], sparse.value[common], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))
    return fit_chain(sparse, known, folds)


def score(docs: DataFrame, chain: list[Linear], categories: list[str]) -> DataFrame:
    """`docs` with `p_<category>` of every category, and whether it reaches the category's threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    state: list = []

    @F.arrow_udf(f"struct<{','.join(f'p_{c}:double' for c in categories)}>")
    def probabilities(texts: pa.Array) -> pa.Array:
        models = shared.value
        if not state:
            worker_state("toxicity", dict)  # lets go of another operator's
            state.extend(
                WordCache(lambda w, m=m: math.fsum(m.weights[f] for f in word_features(w))) for m in models
            )
        out: list[list[float]] = [[] for _ in models]
        for text in texts.to_pylist():
            words = distinct_words(text)
            earlier: list[float] = []
            for model, cache, column in zip(models, state, out, strict=True):
                total = math.fsum(map(cache.fresh().__getitem__, words)) / math.sqrt(max(1, len(words)))
                total += math.fsum(w * p for w, p in zip(model.earlier, earlier, strict=True)) + model.intercept
                earlier.append(round(float(sigmoid(total)), 9))
                column.append(earlier[-1])
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in out], [f"p_{c}" for c in categories])

    added = {f"p_{c}" for c in categories} | set(categories) | {"__scores"}
    scored = docs.withColumn("__scores", probabilities(text_bytes()))
    return scored.select(
        *[c for c in docs.columns if c not in added],
        *[F.col(f"__scores.p_{c}").alias(f"p_{c}") for c in categories],
        *[(F.col(f"__scores.p_{c}") >= m.threshold).alias(c) for c, m in zip(categories, chain, strict=True)],
    )
