"""Removal of long passages that a document with a smaller id holds as well.

Passages are found by recompression: each window of 50 words is represented by a high
interior symbol, and equal windows by the same one. Symbols that occur in two different
texts reveal candidate windows, which are few; those are compared by two independent
64-bit hashes of all their words, and the smallest document of each decides.

Copies of a text are represented by their smallest document. What has to be looked up
by document are narrow rows; the texts themselves move only where a passage is shared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankdraft.llm.common import map_slices, stored, texts
from rankdraft.llm.recompression import anchors
from rankdraft.llm.words import SPACED, Words, other_table, rehashed, split_words, windows
from rankdraft.session import fits_broadcast

WINDOW = 50
SECOND = other_table(SPACED)
# A key is hot if it has more rows than this and more than one row in HOT_KEYS, so that
# there are never more than HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 10_000, 50_000

ANCHORS = "doc_id long, digest binary, keys array<long>, at array<int>, n array<int>"
WHOLE = "doc_id long, digest binary, n_words long, whole_sha256 string"
WINDOWS = "node long, tag int, h1 long, h2 long, at int, later boolean"
CUT = "node long, tag int, n_removed long, kept_sha256 string"


def _tag() -> Column:
    """A few bits of the digest, which tell texts of one id apart."""
    return F.hash("digest")


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _anchors(part: pa.RecordBatch) -> dict[str, object]:
    text, keys, at, n = anchors(split_words(part["text"], SPACED), WINDOW)
    cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
    return {
        "doc_id": part["doc_id"],
        "digest": part["digest"],
        "keys": _lists(keys.view(np.int64), cuts, pa.int64()),
        "at": _lists(at.astype(np.int32), cuts, pa.int32()),
        "n": _lists(n.astype(np.int32), cuts, pa.int32()),
    }


def _joined(words: Words, kept: np.ndarray | None, i: int) -> bytes:
    """The kept words of text ``i`` joined by one space."""
    a, b = words.first[i], words.first[i + 1]
    if kept is None:
        data = words.data[words.starts[a] : words.ends[b - 1]].tobytes() if b > a else b""
        return b" ".join(data.split())
    at = np.flatnonzero(kept[a:b]) + a
    data = memoryview(words.data)
    return b" ".join(data[s:e] for s, e in zip(words.starts[at], words.ends[at]))


def _whole(part: pa.RecordBatch) -> dict[str, object]:
    words = split_words(part["text"], SPACED)
    digests = [hashlib.sha256(_joined(words, None, i)).hexdigest() for i in range(part.num_rows)]
    return {
        "doc_id": part["doc_id"],
        "digest": part["digest"],
        "n_words": pa.array(np.diff(words.first)),
        "whole_sha256": pa.array(digests, pa.string()),
    }


def _covered(first: np.ndarray, spans: list, size: int) -> np.ndarray:
    """Which words, or windows, the spans (at, n) of each text cover."""
    change = np.zeros(first[-1] + 1, np.int64)
    for i, own in enumerate(spans):
        pairs = np.array(own, np.int64).reshape(-1, 2)
        begin = first[i] + pairs[:, 0]
        np.add.at(change, begin, 1)
        np.add.at(change, begin + pairs[:, 1] + size - 1, -1)
    return np.cumsum(change[:-1]) > 0


def _windows(part: pa.RecordBatch) -> dict[str, object]:
    words = split_words(part["text"], SPACED)
    spans = part["spans"].to_pylist()
    wanted = _covered(words.first, [[(s["at"], s["n"]) for s in own] for own in spans], 1)
    later = _covered(
        words.first, [[(s["at"], s["n"]) for s in own if s["later"]] for own in spans], 1
    )
    h1, at = windows(words, WINDOW, 1)
    h2, _ = windows(words, WINDOW, 2, rehashed(words, SECOND))
    chosen = wanted[at]
    at = at[chosen]
    text = words.text[at] if len(at) else np.empty(0, np.int64)
    rows = pa.array(text)
    return {
        "node": part["node"].take(rows),
        "tag": part["tag"].take(rows),
        "h1": pa.array(h1[chosen].view(np.int64)),
        "h2": pa.array(h2[chosen].view(np.int64)),
        "at": pa.array((at - words.first[text]).astype(np.int32)),
        "later": pa.array(later[at]),
    }


def _cut(part: pa.RecordBatch) -> dict[str, object]:
    words = split_words(part["text"], SPACED)
    spans = [[(at, 1) for at in own] for own in part["starts"].to_pylist()]
    removed = _covered(words.first, spans, WINDOW)
    counts = np.add.reduceat(np.append(removed, False), words.first[:-1]) * (
        np.diff(words.first) > 0
    )
    digests = [
        hashlib.sha256(_joined(words, ~removed, i)).hexdigest() for i in range(part.num_rows)
    ]
    return {
        "node": part["node"],
        "tag": part["tag"],
        "n_removed": pa.array(counts.astype(np.int64)),
        "kept_sha256": pa.array(digests, pa.string()),
    }


def _with_text(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (one row per node and tag) with the texts of its documents."""
    ids = found.select(F.col("node").alias("doc_id")).distinct()
    if fits_broadcast(ids):
        # A small list of ids is sent to the texts, so that only those move.
        rows = rows.join(F.broadcast(ids), "doc_id", "left_semi")
    own = rows.select(F.col("doc_id").alias("node"), _tag().alias("tag"), "text")
    return own.join(found, ["node", "tag"])


def _join_keys(
    rows: DataFrame, keyed: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``rows`` joined with ``keyed``, a finished table of one row a key, where ``held``
    is how many rows have it.

    Hot keys go to the rows, which stay where they are; the rows of the others meet them
    in a shuffle, in which no task gets more than its share by one key.
    """
    total = keyed.agg(F.sum("held")).first()[0] or 0
    least = max(hot_rows, total // HOT_KEYS)
    hot = F.broadcast(keyed.filter(F.col("held") > least))
    cold = rows.join(hot.select(keys), keys, "left_anti")
    cold = cold.join(keyed.filter(F.col("held") <= least), keys)
    return cold.unionByName(rows.join(hot, keys)).drop("held")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row.

    A word goes if a window of 50 words around it also starts in a document with a
    smaller id, as the documents are given. A null text has no words. Rows that share an
    id are one document: they take nothing from each other, and equal rows have equal
    results. A row without an id neither loses words nor takes them from others.
    """
    rows = texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    known = rows.filter("doc_id IS NOT NULL")

    nodes = stored(
        map_slices(known, ANCHORS, _anchors)
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("node"),
            F.any_value(F.struct("keys", "at", "n")).alias("anchors"),
        ),
        "anchors",
    )
    zipped = F.arrays_zip("anchors.keys", "anchors.at", "anchors.n")
    spans = nodes.select("node", _tag().alias("tag"), F.explode(zipped).alias("a")).select(
        "node", "tag", F.col("a.keys").alias("key"), "a.at", "a.n"
    )
    extent = (F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("held"))
    shared = stored(
        spans.groupBy("key").agg(*extent).filter("low < high").drop("high"), "shared-symbols"
    )
    # The smallest document of a key may give a window its owner, but loses none by it.
    span = F.struct("at", "n", (F.col("node") > F.col("low")).alias("later"))
    candidates = stored(
        _join_keys(spans, shared, ["key"])
        .groupBy("node", "tag")
        .agg(F.collect_list(span).alias("spans")),
        "spans",
    )
    found = stored(map_slices(_with_text(known, candidates), WINDOWS, _windows), "windows")
    repeated = stored(
        found.groupBy("h1", "h2").agg(*extent).filter("low < high").drop("high"), "shared-windows"
    )
    covered = stored(
        _join_keys(found.filter("later"), repeated, ["h1", "h2"])
        .filter("node > low")
        .groupBy("node", "tag")
        .agg(F.collect_set("at").alias("starts")),
        "covered",
    )
    cut = map_slices(_with_text(known, covered), CUT, _cut).distinct()

    whole = map_slices(rows, WHOLE, _whole)
    result = whole.join(nodes.select("digest", "node"), "digest", "left").join(
        cut.withColumnsRenamed({"node": "_node", "tag": "_tag"}),
        (F.col("doc_id") == F.col("_node")) & (_tag() == F.col("_tag")),
        "left",
    )
    # A later copy of a text loses all its words, if it has enough for one window.
    copy = (F.col("doc_id") > F.col("node")) & (F.col("n_words") >= WINDOW)
    return result.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words"))
        .otherwise(F.coalesce("n_removed", F.lit(0)))
        .cast("long")
        .alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256))
        .otherwise(F.coalesce("kept_sha256", "whole_sha256"))
        .alias("kept_sha256"),
    )
