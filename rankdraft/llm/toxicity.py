"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training texts are unlabelled, not
negative. With class prior p, loss l and the means P over positives and U over
unlabelled texts, the risk of a classifier g is

    p P[l(g)] + max(0, U[l(-g)] - p P[l(-g)])

and where the second part falls below zero its gradient is turned round, which keeps
the classifier from learning its positives by heart. Features are words, and beginnings
of words, by how large a part of the text's words they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankdraft.llm.common import in_arrow, map_slices, slices, texts, to_batch
from rankdraft.llm.words import FOLDED, Words, beginnings, split_words

# Bounds of the training sample: expected rows, chosen by a hash of the id.
MAX_POSITIVE = 3_000
MAX_UNLABELLED = 6_000
# Features that the classifier looks at, of those in at least so many sampled texts.
FEATURES = 256
LEAST_TEXTS = 5
# Lengths in bytes of the beginnings of words.
BEGINNINGS = (4, 5, 6, 7, 8)
# A feature has its full value of 1 where one word in so many shows it.
FULL_SHARE = 40
STEPS = 800
RATE = 0.05
DECAY = 1e-4
THRESHOLD = 0.5

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
SAMPLED = "positive boolean, unlabelled boolean, feature long, value double"
ROWS = "positive boolean, unlabelled boolean, row array<float>"


@dataclass(frozen=True)
class Classifier:
    """Weights of feature hashes (ascending) and a bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """A probability for each text; a null text counts as empty."""
        return sigmoid(design(column, self.features) @ self.weights + self.bias)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def shown(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, text) of everything that the words show, in a few arrays."""
    text = words.text
    yield words.hashes, text
    for size in BEGINNINGS:
        hashes, at = beginnings(words, size, FOLDED)
        yield hashes, text[at]


def design(column: pa.Array, features: np.ndarray) -> np.ndarray:
    """The value of each feature in each text, 0 to 1."""
    words = split_words(column, FOLDED)
    counts = np.zeros(len(column) * len(features))
    for hashes, text in shown(words) if len(features) else ():
        at = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
        hit = features[at] == hashes
        counts += np.bincount(text[hit] * len(features) + at[hit], minlength=len(counts))
    n_words = np.maximum(np.diff(words.first), 1)
    share = counts.reshape(len(column), len(features)) / n_words[:, None]
    return np.minimum(1, FULL_SHARE * share).astype(np.float32)


# ---------------------------------------------------------------- training


def train(features: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> Classifier:
    """Fit to the feature values of positive and of unlabelled texts.

    Without positives, or without features, every text scores the prior.
    """
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    start = float(np.log(prior / (1 - prior)))
    w, b = np.zeros(len(features)), start
    if not len(p) or not len(u) or not len(features):
        return Classifier(features, w, b)
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        gp, gu = p @ w + b, u @ w + b
        # Logistic loss: l(g) = log(1 + exp(-g)); slopes of l(g) and of l(-g).
        as_toxic = prior * _gradient(p, -sigmoid(-gp))
        as_clean = _gradient(u, sigmoid(gu)) - prior * _gradient(p, sigmoid(gp))
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        gradient = -as_clean if rest < 0 else as_toxic + as_clean
        gradient[:-1] += DECAY * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Classifier(features, w, float(b))


def _gradient(x: np.ndarray, slope: np.ndarray) -> np.ndarray:
    return np.append(slope @ x, slope.sum()) / len(x)


def fit(docs: DataFrame, labels: DataFrame, trainable: Column | None = None) -> Classifier:
    """Train on a bounded sample of ``docs``; the prior is that of the labelled rows.

    ``trainable`` (a condition on doc_id) restricts the rows whose labels and texts are
    learned from. Rows with a null id, text or label teach nothing. An id that is
    labelled more than once is toxic if any of its labels says so.
    """
    allowed = F.col("doc_id").isNotNull() & (F.lit(True) if trainable is None else trainable)
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("toxic"))
        .filter(allowed & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg((F.max("toxic") >= 1).alias("positive"))
    )
    rows = texts(docs).filter(allowed & F.col("text").isNotNull())
    marked = rows.select("doc_id").join(marks, "doc_id", "left")
    ids = marked.select("doc_id", F.coalesce("positive", F.lit(False)).alias("positive"))
    size = ids.agg(F.count("*").alias("all"), F.count_if("positive").alias("positive")).first()
    labelled = marks.agg(F.count("*").alias("all"), F.count_if("positive").alias("toxic")).first()
    prior = labelled["toxic"] / labelled["all"] if labelled["all"] else 0.0

    # One draw per id and purpose, so that a repeated run takes the same rows.
    sampled = ids.select(
        "doc_id",
        (F.col("positive") & (_draw("positive") < MAX_POSITIVE / max(1, size["positive"]))).alias(
            "positive"
        ),
        (_draw("unlabelled") < MAX_UNLABELLED / max(1, size["all"])).alias("unlabelled"),
    )
    # Bounded by the two sizes above, and so is what the join sends to the texts.
    chosen = sampled.filter("positive OR unlabelled").dropDuplicates(["doc_id"])
    sample = rows.join(F.broadcast(chosen), "doc_id").select("positive", "unlabelled", "text")
    features = select_features(sample)
    found = map_slices(sample, ROWS, lambda part: _rows(part, features)).toArrow()
    positive = np.array(found["positive"].to_pylist(), bool)
    matrix = np.array(found["row"].to_pylist(), np.float32).reshape(len(positive), len(features))
    unlabelled = np.array(found["unlabelled"].to_pylist(), bool)
    return train(features, matrix[positive], matrix[unlabelled], prior)


def _draw(purpose: str) -> Column:
    """A number in [0, 1) that only the id decides."""
    return F.pmod(F.xxhash64("doc_id", F.lit(purpose)), F.lit(1 << 30)) / F.lit(1 << 30)


def select_features(sample: DataFrame) -> np.ndarray:
    """The features whose mean among the positives lies furthest above that of the rest,
    in standard errors; ascending hashes."""
    sizes = sample.agg(
        F.count_if("positive").alias("p"), F.count_if("unlabelled").alias("u")
    ).first()
    n_p, n_u = max(1, sizes["p"]), max(1, sizes["u"])
    x, positive, unlabelled = F.col("value"), F.col("positive"), F.col("unlabelled")

    def mean(condition: Column, c: Column, n: int) -> Column:
        return F.sum(F.when(condition, c).otherwise(0.0)) / n

    sums = (
        in_arrow(sample, _values, SAMPLED)
        .groupBy("feature")
        .agg(
            mean(positive, x, n_p).alias("p1"),
            mean(positive, x * x, n_p).alias("p2"),
            mean(unlabelled, x, n_u).alias("u1"),
            mean(unlabelled, x * x, n_u).alias("u2"),
            F.count_if("positive").alias("n"),
        )
        .filter(F.col("n") >= min(LEAST_TEXTS, n_p))
    )
    spread = F.sqrt(
        (F.col("p2") - F.col("p1") ** 2) / n_p + (F.col("u2") - F.col("u1") ** 2) / n_u + 1e-9
    )
    distance = (F.col("p1") - F.col("u1")) / spread
    best = (
        sums.select("feature", distance.alias("distance"))
        .filter("distance > 0")
        .orderBy(F.desc("distance"), "feature")
        .limit(FEATURES)
        .collect()
    )
    return np.sort(np.array([r["feature"] for r in best], np.int64).view(np.uint64))


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every feature of every text with its value."""
    for part in slices(batches):
        words = split_words(part["text"], FOLDED)
        n_words = np.maximum(np.diff(words.first), 1)
        for hashes, text in shown(words):
            order = np.lexsort((hashes, text))
            hashes, text = hashes[order], text[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            counts = np.diff(np.append(at, len(hashes)))
            value = np.minimum(1.0, FULL_SHARE * counts / n_words[text[at]])
            rows = pa.array(text[at])
            yield to_batch(
                {
                    "positive": part["positive"].take(rows),
                    "unlabelled": part["unlabelled"].take(rows),
                    "feature": pa.array(hashes[at].view(np.int64)),
                    "value": pa.array(value),
                }
            )


def _rows(part: pa.RecordBatch, features: np.ndarray) -> dict[str, object]:
    rows = list(design(part["text"], features))
    return {
        "positive": part["positive"],
        "unlabelled": part["unlabelled"],
        "row": pa.array(rows, pa.list_(pa.float32())),
    }


# ---------------------------------------------------------------- scoring


def score(docs: DataFrame, model: Classifier, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row, duplicates included.

    A null or empty text has the score of a text that shows no feature.
    """
    rows = texts(docs).withColumn("held_out", F.lit(False) if held_out is None else held_out)

    def run(part: pa.RecordBatch) -> dict[str, object]:
        scores = model.scores(part["text"])
        return {
            "doc_id": part["doc_id"],
            "held_out": part["held_out"],
            "score": pa.array(scores, pa.float64()),
            "predicted": pa.array((scores >= THRESHOLD).astype(np.int32), pa.int32()),
        }

    return map_slices(rows, SCHEMA, run)


def keep_clean(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic."""

    def run(part: pa.RecordBatch) -> dict[str, object]:
        clean = pa.array(model.scores(part["text"]) < THRESHOLD)
        kept = part.filter(clean)
        return {name: kept[i] for i, name in enumerate(kept.schema.names)}

    return map_slices(docs, docs.schema, run)
