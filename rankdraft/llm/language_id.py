"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its hashed character n-grams. Each language
has several centroids, found by spherical k-means, and a text goes to the language of
the centroid with the largest cosine. Every centroid also has the least cosine that its
own training texts show; a text further away than that is marked as rejected.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankdraft.llm.common import map_slices, strings, texts

# Expected training rows of each language, and in all, chosen by a hash of the id.
ROWS_PER_LANGUAGE = 600
MAX_ROWS = 6_000
CENTROIDS = 3
ROUNDS = 12
BUCKETS = 1 << 11
LONGEST = 3
# A text is rejected below this share of a centroid's low training cosines.
LOW_PERCENTILE = 1
REJECT_SHARE = 0.8
UNKNOWN = "und"

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
SAMPLE = "lang string, counts array<float>"
# Letters below this code point are looked up in a table.
LETTERS = 1 << 16


@dataclass(frozen=True)
class Centroids:
    """Unit vectors (one a row), their languages, distance limits, and the term weights."""

    vectors: np.ndarray
    languages: list[str]
    limits: np.ndarray
    idf: np.ndarray

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text; null and letterless ones are
        ``und`` with cosine 0, rejected."""
        counts, letters = ngram_counts(strings(column))
        vectors = unit(weighted(counts) * self.idf)
        known = letters & (len(self.languages) > 0)
        if not len(self.languages):
            return [UNKNOWN] * len(column), np.zeros(len(column)), ~known
        cosines = vectors @ self.vectors.T
        best = cosines.argmax(axis=1)
        cosine = np.clip(cosines[np.arange(len(best)), best], 0, 1)
        languages = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return languages, np.where(known, cosine, 0.0), ~known | (cosine < self.limits[best])


_LETTER_TABLE: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters; the last entry is for those beyond the table."""
    if not _LETTER_TABLE:
        flags = [unicodedata.category(chr(c))[0] == "L" for c in range(LETTERS)]
        _LETTER_TABLE.append(np.array([*flags, False]))
    return _LETTER_TABLE[0]


def ngram_counts(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams of 1 to 3 letters or gaps for each text, and which texts
    hold a letter. Everything but letters is a gap; a run of gaps counts as one."""
    table = letter_table()
    counts = np.zeros((len(rows), BUCKETS), np.float32)
    letters = np.zeros(len(rows), bool)
    for i, row in enumerate(rows):
        codes = np.frombuffer(row.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = table[np.minimum(codes, LETTERS)]
        for rare in np.unique(codes[codes >= LETTERS]):
            letter[codes == rare] = chr(rare).isalpha()
        letters[i] = letter.any()
        kept = letter.copy()
        kept[:1] = True
        kept[1:] |= letter[:-1]
        gram = np.where(letter, codes, 0)[kept].astype(np.uint64)
        gram = np.concatenate(([0], gram, [0])).astype(np.uint64)
        rolled = np.zeros(len(gram), np.uint64)
        for n in range(1, LONGEST + 1):
            if len(gram) < n:
                break
            rolled = rolled[: len(gram) - n + 1] * np.uint64(0x100000001B3) + gram[n - 1 :]
            mixed = (rolled + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            buckets = (mixed >> np.uint64(64 - 11)).astype(np.int64)
            counts[i] += np.bincount(buckets, minlength=BUCKETS)
    return counts, letters


def weighted(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


# ---------------------------------------------------------------- training


def train(counts: np.ndarray, languages: list[str]) -> Centroids:
    """Centroids of the training texts; without any, nothing is known."""
    present = (counts > 0).sum(axis=0)
    idf = np.log((1 + len(counts)) / (1 + present)).astype(np.float32) + 1
    vectors = unit(weighted(counts) * idf) if len(counts) else counts
    found, names, limits = [], [], []
    for language in sorted(set(languages)):
        own = vectors[[x == language for x in languages]]
        centres = spherical_kmeans(own, CENTROIDS)
        nearest = own @ centres.T
        for c in range(len(centres)):
            mine = nearest[nearest.argmax(axis=1) == c, c]
            low = np.percentile(mine, LOW_PERCENTILE) if len(mine) else 1.0
            limits.append(REJECT_SHARE * low)
            names.append(language)
        found.append(centres)
    stacked = np.concatenate(found) if found else np.zeros((0, BUCKETS), np.float32)
    return Centroids(stacked, names, np.array(limits), idf)


def spherical_kmeans(own: np.ndarray, k: int) -> np.ndarray:
    """Centroids on the unit sphere, begun with texts far from each other."""
    centres = unit(own.mean(axis=0, keepdims=True))
    for _ in range(min(k, len(own)) - 1):
        furthest = (own @ centres.T).max(axis=1).argmin()
        centres = np.concatenate((centres, own[furthest : furthest + 1]))
    for _ in range(ROUNDS):
        nearest = (own @ centres.T).argmax(axis=1)
        sums = [own[nearest == c].sum(axis=0) for c in range(len(centres))]
        centres = np.stack([s if s.any() else centres[c] for c, s in enumerate(sums)])
        centres = unit(centres)
    return centres


def fit(docs: DataFrame, trainable: Column | None = None) -> Centroids:
    """Learn from text and non-null ``lang`` of a bounded sample of each language.

    ``trainable`` is a condition on doc_id. Texts without a letter teach nothing.
    """
    allowed = F.col("doc_id").isNotNull() & (F.lit(True) if trainable is None else trainable)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    ).filter(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return train(np.zeros((0, BUCKETS), np.float32), [])
    per_language = min(ROWS_PER_LANGUAGE, MAX_ROWS / len(sizes))
    shares = F.create_map(
        *(F.lit(x) for lang, n in sizes.items() for x in (lang, per_language / n))
    )
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = rows.filter(draw < shares[F.col("lang")]).select("lang", "text")

    def features(part: pa.RecordBatch) -> dict[str, object]:
        counts, letters = ngram_counts(strings(part["text"]))
        kept = np.flatnonzero(letters)
        return {
            "lang": part["lang"].take(pa.array(kept)),
            "counts": pa.array(list(counts[kept]), pa.list_(pa.float32())),
        }

    found = map_slices(sample, SAMPLE, features).toArrow()
    values = found["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return train(values.reshape(found.num_rows, BUCKETS), found["lang"].to_pylist())


# ---------------------------------------------------------------- prediction


def predict(docs: DataFrame, model: Centroids, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row, duplicates included.

    Texts that are null, empty or without a letter are ``und`` with score 0.
    """
    rows = texts(docs).withColumn("held_out", F.lit(False) if held_out is None else held_out)

    def run(part: pa.RecordBatch) -> dict[str, object]:
        languages, cosine, rejected = model.predict(part["text"])
        return {
            "doc_id": part["doc_id"],
            "held_out": part["held_out"],
            "lang_pred": pa.array(languages, pa.string()),
            "score": pa.array(cosine.astype(np.float64), pa.float64()),
            "rejected": pa.array(rejected, pa.bool_()),
        }

    return map_slices(rows, SCHEMA, run)
