"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms whose inverse document frequency, ln(N / df) over all
documents, lies in a band. A fingerprint has a hash of 64 bits for the whole lexicon and
one of 8 bits for each of many random subsets of it, from a quarter of the terms down to
one in 2,048: the hash of the text's distinct terms in that subset, in sorted order.
Texts alike in most terms agree in some subsets, and the share of those is their
likeness. Only subsets that hold about one term of a text tell much, one or two scales
whatever the text's length; there are many draws, so that those few are enough.

The lexicon is small whatever the size of the corpus: document frequencies sum up to the
number of distinct terms of all texts, so at most m * exp(IDF_MAX) terms reach the band,
where m is the mean number of distinct terms of a text. Counting it takes two passes. A
term in the band must reach its share in at least one task, so each task names the terms
that do there; then those are counted exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankdraft.llm.common import in_arrow, slices, texts, to_batch
from rankdraft.llm.words import FOLDED, counted, mix, split_words

IDF_MIN, IDF_MAX = 1.2, 6.2
# Subsets hold about one term in 2^scale, and each scale has several of them.
SCALES, DRAWS = range(2, 12), 32
# Weight of a scale none of whose subsets is empty; one of empty subsets only has 1 more.
DENSE_WEIGHT = 0.05
# Bytes of a fingerprint: the hash of the whole lexicon, and one for each subset.
WHOLE = 8
BYTES = WHOLE + len(SCALES) * DRAWS
STEP = np.uint64(0x9E3779B97F4A7C15)
# Candidate terms that may be sent to every task; beyond, all terms are counted.
MAX_CANDIDATES = 4_000_000
# Ranges of ids for each shuffle partition.
RANGES = 4

PLACED = "part int, halo boolean, doc_id long, text string"
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


# ---------------------------------------------------------------- lexicon


def lexicon(docs: DataFrame) -> np.ndarray:
    """Ascending hashes of the terms in the band, by all texts of ``docs``."""
    spark, rows = docs.sparkSession, texts(docs)
    total = rows.count()
    least, most = total * math.exp(-IDF_MAX), total * math.exp(-IDF_MIN)
    candidates = in_arrow(rows, _frequent_here, "term long").distinct()
    # One row more tells that there are too many.
    named = candidates.limit(MAX_CANDIDATES + 1).toArrow()
    known = np.sort(named["term"].to_numpy().view(np.uint64))
    only = spark.sparkContext.broadcast(known if len(known) <= MAX_CANDIDATES else None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n, _ = _document_counts(batches, only.value)
        yield to_batch({"term": pa.array(terms.view(np.int64)), "n": pa.array(n)})

    counts = in_arrow(rows, count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = counts.filter((F.col("n") >= least) & (F.col("n") <= most)).select("term").toArrow()
    return np.sort(band["term"].to_numpy().view(np.uint64))


def _document_counts(
    batches: Iterator[pa.RecordBatch], only: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray, int]:
    """Terms of all texts of a task, the number of texts with each, the texts."""
    terms, counts, rows = np.empty(0, np.uint64), np.empty(0, np.int64), 0
    for part in slices(batches):
        words = split_words(part["text"], FOLDED)
        hashes, text = words.hashes, words.text
        if only is not None:
            kept = contains(only, hashes)
            hashes, text = hashes[kept], text[kept]
        here, n = np.unique(counted(hashes, text)[0], return_counts=True)
        both, at = np.unique(np.concatenate((terms, here)), return_inverse=True)
        summed = np.bincount(at, weights=np.concatenate((counts, n)), minlength=len(both))
        terms, counts, rows = both, summed.astype(np.int64), rows + part.num_rows
    return terms, counts, rows


def _frequent_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms, counts, rows = _document_counts(batches, None)
    frequent = terms[counts >= rows * math.exp(-IDF_MAX)]
    yield to_batch({"term": pa.array(frequent.view(np.int64))})


def contains(ascending: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values


# ---------------------------------------------------------------- fingerprints


def fingerprints(column: pa.Array, terms: np.ndarray) -> np.ndarray:
    """A row of bytes for each text; those of a subset that has none of its terms are 0.

    A text without any term of the lexicon is represented by all its terms; one without
    terms has zeros only.
    """
    n = len(column)
    words = split_words(column, FOLDED)
    hashes, text = words.hashes, words.text
    known = contains(terms, hashes)
    found = np.bincount(text[known], minlength=n) > 0
    kept = known | ~found[text]
    hashes, text, _ = counted(hashes[kept], text[kept])
    values = mix(hashes + STEP)
    out = np.zeros((n, BYTES), np.uint8)
    out[:, :WHOLE] = _summed(values, text, n).astype(">u8").view(np.uint8).reshape(n, WHOLE)
    column = WHOLE
    for seed in mix(np.arange(1, DRAWS + 1, dtype=np.uint64) * STEP):
        random, chosen, own = mix(hashes ^ seed), values, text
        for scale in SCALES:
            # The subsets of a draw lie inside each other.
            inside = random < np.uint64(1 << (64 - scale))
            random, chosen, own = random[inside], chosen[inside], own[inside]
            total = _summed(chosen, own, n)
            short = np.maximum(total >> np.uint64(56), np.uint64(1))
            out[:, column] = np.where(total == 0, np.uint64(0), short)
            column += 1
    return out


def _summed(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """A hash of each text's values, which come in sorted order; 0 if it has none."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    cuts = np.searchsorted(text, np.arange(n + 1))
    total = mix(sums[cuts[1:]] - sums[cuts[:-1]])
    return np.where(cuts[1:] > cuts[:-1], np.maximum(total, np.uint64(1)), np.uint64(0))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes among those of subsets that either text has terms of; 1 if
    both have none at all.

    A subset of many terms is rarely equal, one of about a single term as often as the
    texts share terms. So a scale weighs more, the more of its subsets are empty.
    """
    same = (a[:, :WHOLE] == b[:, :WHOLE]).all(axis=1)
    some = a[:, :WHOLE].any(axis=1) | b[:, :WHOLE].any(axis=1)
    shape = (len(a), DRAWS, len(SCALES))
    a, b = a[:, WHOLE:].reshape(shape), b[:, WHOLE:].reshape(shape)
    held = (a != 0) | (b != 0)
    equal = (a == b) & held
    weights = DENSE_WEIGHT + 1 - held.mean(axis=1)
    total = DENSE_WEIGHT * some + (weights * held.sum(axis=1)).sum(axis=1)
    shared = DENSE_WEIGHT * (some & same) + (weights * equal.sum(axis=1)).sum(axis=1)
    # Equal texts are exactly 1, whatever the sums are rounded to.
    return np.where(some & ~same, shared / np.maximum(total, 1e-12), 1.0)


def written(rows: np.ndarray) -> list[str]:
    raw = rows.tobytes().hex()
    size = 2 * BYTES
    return [raw[i : i + size] for i in range(0, len(raw), size)]


# ---------------------------------------------------------------- next documents


def _placed(docs: DataFrame) -> DataFrame:
    """Documents by ranges of ids, each range with a copy of the document after it.

    Bounds are ids that occur, so the bound of a range is its first document in
    descending order, which the range above needs, and the first range needs the last
    bound. Rows without an id stand behind all others.
    """
    spark = docs.sparkSession
    rows = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)]
    found = rows.agg(
        F.percentile_approx("doc_id", shares, 100 * n).alias("bounds"),
        F.max("doc_id").alias("last"),
    ).first()
    bounds = sorted({*(found["bounds"] or []), *([] if found["last"] is None else [found["last"]])})
    ascending = np.array(bounds, np.int64)

    def place(part: pa.RecordBatch) -> dict[str, object]:
        ids = part["doc_id"].to_numpy(zero_copy_only=False)
        known = ~np.isnan(ids) if ids.dtype.kind == "f" else np.ones(len(ids), bool)
        ids = part["doc_id"].fill_null(0).to_numpy()
        home = np.where(known, np.searchsorted(ascending, ids), 0)
        first = np.flatnonzero(known & contains(ascending, ids))
        at = np.concatenate((np.arange(len(ids)), first))
        where = np.concatenate((home, (home[first] + 1) % max(1, len(ascending))))
        halo = np.arange(len(at)) >= len(ids)
        rows = part.take(pa.array(at))
        return {
            "part": pa.array(where.astype(np.int32)),
            "halo": pa.array(halo),
            "doc_id": rows["doc_id"],
            "text": rows["text"],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield to_batch(place(part))

    return in_arrow(rows, run, PLACED)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first ones of another text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprint_documents(docs: DataFrame, terms: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next, by row.

    The next document is that with the next smaller id, after the last the first; rows
    of one id come in the order of their texts, rows without an id last. A null text
    counts as empty, and a single document is its own next.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon(docs) if terms is None else terms)
    ordered = (
        _placed(docs)
        .repartition("part")
        .sortWithinPartitions("part", "halo", F.desc_nulls_last("doc_id"), "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _with_next(batches):
            yield _described(rows, shared.value)

    return in_arrow(ordered, run, SCHEMA)


Row = tuple[int | None, str, str]


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Row]]:
    """(doc_id, text, text of the next) of each range's own rows, some at a time."""
    part, first, last, halo_seen = None, "", None, False
    for batch in slices(batches):
        out: list[Row] = []
        columns = (batch[c].to_pylist() for c in ("part", "halo", "doc_id", "text"))
        for where, halo, doc_id, text in zip(*columns):
            if where != part:
                if last is not None:
                    out.append((*last, first))
                part, first, last, halo_seen = where, text, None, False
            if last is not None:
                out.append((*last, text))
            if halo:
                last, halo_seen = None, True
            elif not halo_seen:
                last = (doc_id, text)
        if out:
            yield out
    if last is not None:
        yield [(*last, first)]


def _described(rows: list[Row], terms: np.ndarray) -> pa.RecordBatch:
    ids, own, following = zip(*rows)
    changed = [edited(t, f) for t, f in zip(own, following)]
    # The next text of a row mostly is the text of the row behind it.
    known = fingerprints(pa.array([*own, following[-1]], pa.large_string()), terms)
    mine, after = known[:-1], known[1:].copy()
    apart = [i for i in range(len(rows) - 1) if following[i] is not own[i + 1]]
    if apart:
        after[apart] = fingerprints(pa.array([following[i] for i in apart], pa.large_string()), terms)
    other = fingerprints(pa.array(changed, pa.large_string()), terms)
    return to_batch(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "n_chars": pa.array([len(t) for t in own], pa.int64()),
            "edited_sha256": pa.array(
                [hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()
            ),
            "fingerprint": pa.array(written(mine), pa.string()),
            "edited_fingerprint": pa.array(written(other), pa.string()),
            "near_edited": pa.array(likeness(mine, other), pa.float64()),
            "near_next": pa.array(likeness(mine, after), pa.float64()),
        }
    )
