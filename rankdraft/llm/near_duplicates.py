"""Near-duplicate documents by ProbMinHash, banding and verification.

Sketch: every distinct five-word shingle of a text is a Poisson process whose arrivals
fall on random components; a component keeps the shingle of its first arrival. A shingle
stops once its next arrival comes later than all first arrivals. Two texts agree in a
component with the probability Jaccard similarity of their weighted shingles. There are
two signatures: with equal weights, for which that is the plain Jaccard similarity, the
one that is verified; and with 1 + ln(count), the same one where no shingle repeats.

Candidates: texts that agree in all components of a band share a bucket. Verification
is exact, by the Jaccard similarity of the distinct shingles. Buckets are not expanded
into pairs. First all members are compared with the bucket's hub, the member that meets
most others. What a pair x, y that is not in one class yet can still share follows from
the shingles that each has in common with the hub, a, and those of its own, e:

* if they share none of their own, they have at most a_x in common, of at least
  |y| + e_x, so to reach the similarity s, |y| must not exceed a_x / s - e_x, nor |x|
  a_y / s - e_y. Hardly any member that is not like the hub gets that far;
* else they meet in some of their own shingles, and in as many as the sizes ask for.

Only such pairs are compared in a second round. All others are proven to be unlike, so
that every link between candidates ends up in the classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankdraft.llm.common import free_name, map_slices, stored, texts
from rankdraft.llm.components import components
from rankdraft.llm.words import FOLDED, counted, mix, shingles, split_words
from rankdraft.session import fits_broadcast

SHINGLE = 5
SIMILARITY = 0.8
# At the similarity of 0.8, (1 - 0.8^4)^24 = 3 in a million pairs share no band of the
# signature with equal weights, however often their shingles repeat.
BANDS = 24
ROWS = 4
COMPONENTS = BANDS * ROWS

SKETCHED = "doc_id long, digest binary, bands array<long>"
SETS = "node long, shingles array<long>"
STEP = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- sketches


def sketch(hashes: np.ndarray, text: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash signatures of ``n`` weighted sets given as distinct (hash, text)."""
    first = np.full(n * COMPONENTS, np.inf)
    signature = np.zeros(n * COMPONENTS, np.uint64)
    limit = np.full(n, np.inf)
    times = np.zeros(len(hashes))
    seed = hashes.copy()
    while len(hashes):
        seed = seed + STEP
        draw = mix(seed)
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        times = times - np.log(uniform) / weights
        alive = times < limit[text]
        hashes, text, weights, times, seed, draw = (
            x[alive] for x in (hashes, text, weights, times, seed, draw)
        )
        component = ((mix(draw ^ STEP) >> np.uint64(32)) * np.uint64(COMPONENTS)) >> np.uint64(32)
        cell = text * COMPONENTS + component.astype(np.int64)
        np.minimum.at(first, cell, times)
        won = first[cell] == times
        signature[cell[won]] = hashes[won]
        limit = first.reshape(n, COMPONENTS).max(axis=1)
    return signature.reshape(n, COMPONENTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key for each band: equal where all components of the band are."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for row in range(ROWS):
        keys = mix(keys * STEP + parts[:, :, row])
    return keys


def _sketched(part: pa.RecordBatch) -> dict[str, object]:
    hashes, text, counts = counted(*shingles(split_words(part["text"], FOLDED), SHINGLE))
    n = part.num_rows
    keys = band_keys(sketch(hashes, text, np.ones(len(hashes)), n)).view(np.int64)
    sizes = np.bincount(text, minlength=n)
    bands = [k if size else [] for k, size in zip(keys, sizes)]
    # Where no shingle repeats the weighted signature is the same one.
    repeats = np.unique(text[counts > 1])
    own = np.isin(text, repeats)
    again = np.searchsorted(repeats, text[own])
    weighted = sketch(hashes[own], again, 1 + np.log(counts[own]), len(repeats))
    for i, more in zip(repeats, band_keys(weighted).view(np.int64)):
        bands[i] = np.union1d(bands[i], more)
    return {
        "doc_id": part["doc_id"],
        "digest": part["digest"],
        "bands": pa.array(bands, pa.list_(pa.int64())),
    }


def _sets(part: pa.RecordBatch) -> dict[str, object]:
    hashes, text, _ = counted(*shingles(split_words(part["text"], FOLDED), SHINGLE))
    cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
    sets = pa.ListArray.from_arrays(
        pa.array(cuts, pa.int32()), pa.array(hashes.view(np.int64))
    )
    return {"node": part["doc_id"], "shingles": sets}


# ---------------------------------------------------------------- classes


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id for each row: rows of a class are linked by exact copies, or by
    near copies in one or more steps; class_id is the least doc_id in it.

    Equal texts are one class, so are rows that share an id. A row whose id is null has
    a null class, a null text is a class of its own. Texts without a word are alike only
    if equal. Texts of fewer than five words are one shingle.
    """
    rows = texts(docs).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    usable = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())

    # One node for each different text. Its sketch follows from the text, so that
    # copies, however many, are combined before anything is shuffled.
    nodes = stored(
        map_slices(usable, SKETCHED, _sketched)
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("node"),
            F.any_value("bands").alias("bands"),
        ),
        "sketches",
    )
    buckets = stored(_buckets(nodes), "buckets")
    sets = stored(map_slices(_texts_of(usable, buckets), SETS, _sets), "shingle-sets")

    hubs = stored(_hubs(buckets), "hubs")
    met = buckets.join(hubs, "key").filter("node <> hub").select("hub", "node").distinct()
    compared = stored(_compared(met, sets), "compared")
    first = compared.filter(_alike("n_hub", "n", similarity)).select(
        F.col("hub").alias("a"), F.col("node").alias("b")
    )
    roots = stored(components(first), "components")

    open_pairs = _open_pairs(buckets, hubs, compared, roots, sets, similarity)
    second = (
        _compared(open_pairs, sets)
        .filter(_alike("n_hub", "n", similarity))
        .select(F.col("hub").alias("a"), F.col("node").alias("b"))
    )
    # Classes of the first round take part as links to their roots.
    held = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    classes = components(held.unionByName(second))

    own = nodes.join(classes, "node", "left").select(
        "digest", F.coalesce("root", "node").alias("class_id")
    )
    found = rows.select("doc_id", "digest").join(own, "digest", "left")
    return found.select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
    )


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, meets) for all buckets of two nodes or more; ``meets`` is how many
    others a node meets in all its buckets."""
    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    kept = members.join(shared, "key")
    meets = kept.groupBy("node").agg(F.sum("size").alias("meets"))
    return kept.join(meets, "node").select("key", "node", "meets")


def _hubs(buckets: DataFrame) -> DataFrame:
    best = F.max(F.struct("meets", (-F.col("node")).alias("minus"))).alias("best")
    hubs = buckets.groupBy("key").agg(best)
    return hubs.select("key", (-F.col("best.minus")).alias("hub"))


def _texts_of(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Texts of the nodes that have candidates."""
    nodes = buckets.select(F.col("node").alias("doc_id")).distinct()
    ids = stored(nodes, "candidates")
    # The list of ids is sent to the texts if it is small, else both are shuffled.
    listed = F.broadcast(ids) if fits_broadcast(ids) else ids
    return rows.join(listed, "doc_id", "left_semi").select("doc_id", "text")


def _alike(n_a: str, n_b: str, similarity: float) -> Column:
    return F.col("shared") >= similarity * (F.col(n_a) + F.col(n_b) - F.col("shared"))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, node, n_hub, n, shared) of distinct pairs (hub, node); exact."""
    left = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("_of_hub"))
    both = pairs.join(sets, "node").join(left, "hub")
    shared = F.size(F.array_intersect("_of_hub", "shingles"))
    return both.select(
        "hub", "node", F.size("_of_hub").alias("n_hub"), F.size("shingles").alias("n"),
        shared.alias("shared"),
    )


def _open_pairs(
    buckets: DataFrame,
    hubs: DataFrame,
    compared: DataFrame,
    roots: DataFrame,
    sets: DataFrame,
    similarity: float,
) -> DataFrame:
    """(hub, node): pairs of a bucket in different classes that may still be alike.

    One of the two, x, is always outside of the class of the bucket's hub.
    """
    # Of each hub and member: own class, the hub's, sizes shared and own.
    hub_roots = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    near = (
        compared.join(roots, "node", "left")
        .join(hub_roots, "hub", "left")
        .select(
            "hub",
            "node",
            "n",
            "shared",
            F.coalesce("root", "node").alias("root"),
            F.coalesce("hub_root", "hub").alias("hub_root"),
            # The largest partner that shares nothing of the member's own.
            (F.col("shared") / similarity - (F.col("n") - F.col("shared"))).alias("reach"),
        )
    )
    outside = F.col("root") != F.col("hub_root")
    # Hubs all of whose members are in their class have no open pairs.
    mixed = near.filter(outside).select("hub").distinct()
    near = stored(near.join(mixed, "hub", "left_semi"), "open-members")
    x = [F.col(c).alias(f"{c}_x") for c in ("node", "n", "root", "reach")]
    differ = "root <> root_x AND (root = hub_root OR node < node_x)"

    placed = buckets.select("key", "node").join(hubs, "key").join(near, ["hub", "node"])
    least = placed.groupBy("key").agg(F.min("n").alias("least"))
    far = placed.filter(outside).join(least, "key").filter("reach >= least").select("key", *x)
    by_size = placed.join(far, "key").filter(f"{differ} AND n <= reach_x AND n_x <= reach")

    # With c shingles of their own in common, c at least what their sizes ask for beyond
    # what both share with the hub, two members also share one that is not among the
    # c - 1 most frequent of either. Rare ones come first, so chance meetings drop out.
    in_hub = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("_of_hub"))
    least = near.groupBy("hub").agg(F.min("n").alias("least"))
    asked = similarity / (1 + similarity) * (F.col("n") + F.col("least")) - F.col("shared")
    own = near.join(least, "hub").withColumn("asked", F.greatest(F.ceil(asked - 1e-9), F.lit(1)))
    own = own.join(sets, "node").join(in_hub, "hub").withColumn(
        "shingle", F.explode(F.array_except("shingles", "_of_hub"))
    ).drop("shingles", "_of_hub")
    met = own.groupBy("hub", "shingle").agg(
        F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    met = met.filter("low < high").select("hub", "shingle", "members")
    of_node = Window.partitionBy("hub", "node")
    own = (
        own.join(met, ["hub", "shingle"])
        .withColumn("place", F.row_number().over(of_node.orderBy("members", "shingle")))
        .withColumn("found", F.count("*").over(of_node))
        .filter("place <= found - asked + 1")
    )
    far = own.filter(outside).select("hub", "shingle", *x)
    by_own = own.join(far, ["hub", "shingle"]).filter(differ)

    pair = [F.col("node_x").alias("hub"), "node"]
    return by_size.select(*pair).unionByName(by_own.select(*pair)).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that have the least id of their class.

    Rows without an id are kept. Of repeated rows with that id all stay.
    """
    classes = near_duplicate_classes(docs).filter("doc_id <> class_id")
    gone = free_name(docs, "_dropped")
    dropped = stored(classes.select(F.col("doc_id").alias(gone)).distinct(), "dropped")
    if fits_broadcast(dropped):
        dropped = F.broadcast(dropped)
    return docs.join(dropped, docs["doc_id"] == F.col(gone), "left_anti")
