"""A Merkle manifest of a table, with one version of the tree per tampered row.

Every row is a leaf. The leaves of a source, in order, are hashed in runs of 16 until
one node remains, the source's subroot; the subroots, in order of the sources, give the
root in the same way.

Trees are built in aligned blocks of 16^3 nodes, each by one task. The roots of the
blocks are the nodes of the next, 4,096 times smaller, round, so that no task holds more
than a block however large a source is. On the way back every block gets the siblings
of its root on the path to the top. A tampered leaf then makes a version of the tree:
inside its block the ancestors are copied and all other nodes shared; above, the copies
go on along the siblings that the block was given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from rankdraft.llm.common import fold, in_arrow, stored
from rankdraft.session import fits_broadcast

RUN = 16
LEVELS = 3
BLOCK = RUN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SIBLINGS = "array<struct<left:string,right:string>>"
ROOTS = "source string, idx long, hash binary"
PATHS = f"source string, idx long, name string, path {SIBLINGS}, over {SIBLINGS}"
PROOFS = (
    "doc_id long, source string, position long, leaf string, subroot string, root string, "
    "proof_sha256 string, folded_root string, copied array<string>"
)

Path = list[tuple[str, str]]


# ---------------------------------------------------------------- the tree


class Node(NamedTuple):
    hash: str
    children: tuple[Node, ...] = ()


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parent(children: tuple[Node, ...]) -> Node:
    return Node(digest("".join(c.hash for c in children)), children)


def grow(hashes: list[str], part_of_more: bool) -> tuple[Node, int]:
    """Root and height of a block. One that is a part of a longer row of nodes has the
    full height even if it holds a single node."""
    row, height = [Node(h) for h in hashes], 0
    while height < LEVELS if part_of_more else len(row) > 1:
        row = [parent(tuple(row[i : i + RUN])) for i in range(0, len(row), RUN)]
        height += 1
    return row[0], height


def version(root: Node, height: int, at: int, leaf: str) -> Node:
    """The tree with another leaf: ancestors are new, all else is shared."""
    if not height:
        return Node(leaf)
    slot = at // RUN ** (height - 1) % RUN
    old = root.children
    new = version(old[slot], height - 1, at, leaf)
    return parent((*old[:slot], new, *old[slot + 1 :]))


def spine(root: Node, height: int, at: int) -> list[str]:
    """Hashes from the parent of leaf ``at`` up to the root."""
    out = []
    for level in range(height - 1, -1, -1):
        out.append(root.hash)
        root = root.children[at // RUN**level % RUN]
    return out[::-1]


def paths(root: Node, height: int) -> Iterator[Path]:
    """Of each leaf in order the siblings to its left and right, from the leaf upwards."""
    if not height:
        yield []
        return
    row = "".join(c.hash for c in root.children)
    for slot, child in enumerate(root.children):
        own = (row[: 64 * slot], row[64 * (slot + 1) :])
        for below in paths(child, height - 1):
            yield [*below, own]


def climb(leaf: str, path: Path) -> list[str]:
    """Hashes of the ancestors of a leaf, the last one the top's."""
    out = []
    for left, right in path:
        leaf = digest(left + leaf + right)
        out.append(leaf)
    return out


# ---------------------------------------------------------------- blocks in tasks


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block; batches come sorted by (source, block)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        source, block = batch["source"], batch["block"]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        same = pc.fill_null(pc.equal(source[1:], source[:-1]), False)
        nulls = pc.and_(pc.is_null(source[1:]), pc.is_null(source[:-1]))
        new[1:] = ~np.asarray(pc.or_(same, nulls)) | (np.diff(np.asarray(block)) != 0)
        cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = (source[a].as_py(), block[a].as_py())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _hex(column) -> list[str | None]:
    return [None if h is None else h.hex() for h in column.to_pylist()]


def _path(column) -> Path:
    return [(s["left"], s["right"]) for s in column.as_py() or ()]


def _rows(schema: str, columns: dict[str, list]) -> pa.RecordBatch:
    path = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), SIBLINGS: path}
    kinds["array<string>"] = pa.list_(pa.string())
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    arrays = [pa.array(columns[name], kinds[kind]) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def _block_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: dict[str, list] = {"source": [], "idx": [], "hash": []}
    for block in _groups(batches):
        root, _ = grow(_hex(block["hash"]), block["n"][0].as_py() > BLOCK)
        out["source"].append(block["source"][0].as_py())
        out["idx"].append(block["block"][0].as_py())
        out["hash"].append(bytes.fromhex(root.hash))
        if len(out["idx"]) >= 1024:
            yield _rows(ROOTS, out)
            out = {c: [] for c in out}
    yield _rows(ROOTS, out)


def _with_path(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Path, Path]]:
    """Blocks, and the path of each block's root, which its first row holds."""
    for block in _groups(batches):
        yield block.slice(1), _path(block["path"][0]), _path(block["over"][0])


def _node_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs(path: Path) -> list[dict]:
        return [{"left": left, "right": right} for left, right in path]

    for block, path, over in _with_path(batches):
        root, height = grow(_hex(block["hash"]), block["n"][0].as_py() > BLOCK)
        own = [pairs([*below, *path]) for below in paths(root, height)]
        columns = {c: block[c].to_pylist() for c in ("source", "idx", "name")}
        yield _rows(PATHS, columns | {"path": own, "over": [pairs(over)] * len(own)})


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, path, over in _with_path(batches):
        leaves, tampered = _hex(block["hash"]), _hex(block["tampered"])
        root, height = grow(leaves, block["n"][0].as_py() > BLOCK)
        subroot = climb(root.hash, path)[-1] if path else root.hash
        top = climb(subroot, over)[-1] if over else subroot
        above = "".join(left + right for left, right in (*path, *over))
        proofs, folded, copies = [], [], []
        for at, below in enumerate(paths(root, height)):
            proofs.append(digest("".join(left + right for left, right in below) + above))
            if tampered[at] is None:
                ends = [leaves[at], *climb(leaves[at], [*below, *path, *over])]
                copies.append(None)
            else:
                own = version(root, height, at, tampered[at])
                ends = [*spine(own, height, at), *climb(own.hash, [*path, *over])]
                copies.append(ends)
                ends = [tampered[at], *ends]
            folded.append(ends[-1])
        n = len(leaves)
        yield _rows(
            PROOFS,
            {
                "doc_id": block["doc_id"].to_pylist(),
                "source": block["source"].to_pylist(),
                "position": block["idx"].to_pylist(),
                "leaf": leaves,
                "subroot": [subroot] * n,
                "root": [top] * n,
                "proof_sha256": proofs,
                "folded_root": folded,
                "copied": copies,
            },
        )


# ---------------------------------------------------------------- rounds in Spark


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``idx``, the place from 0 among the rows of a source, and ``n``, their number.

    The rows are range-partitioned, so that a source, however large, is spread; a row's
    place is its place in the partition plus what earlier partitions hold of its source.
    """
    keys = ["source", *order]
    schema = StructType(rows.schema.fields).add("part", IntegerType()).add("place", LongType())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            own = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))]
            names = [*batch.schema.names, "part", "place"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=names)
            at += n

    ordered = rows.repartitionByRange(_partitions(rows), *keys).sortWithinPartitions(*keys)
    found = stored(in_arrow(ordered, placed, schema), "places")
    # One row per partition and source: as many as partitions and sources together.
    runs = found.groupBy("part", "source").agg(
        F.min("place").alias("first"), F.count("*").alias("size")
    )
    own = Window.partitionBy("source")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("part").alias("_part"),
        F.col("source").alias("_source"),
        (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("offset"),
        F.sum("size").over(own).alias("n"),
    )
    runs = stored(runs, "runs")
    if fits_broadcast(runs):
        runs = F.broadcast(runs)
    same = (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source"))
    idx = (F.col("place") + F.col("offset")).alias("idx")
    return found.join(runs, same).select(*rows.columns, idx, "n")


def _in_blocks(nodes: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Apply ``run`` to the nodes, sorted in blocks; rows of idx -1 name their block."""
    placed = nodes.repartition(_partitions(nodes), "source", "block")
    return in_arrow(placed.sortWithinPartitions("source", "block", "idx"), run, schema)


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / BLOCK).cast("long"))


def _with_paths(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes in blocks, and before those of each block one row with its path."""
    heads = tops.select("source", F.col("idx").alias("block"), "path", "over")
    heads = heads.withColumn("idx", F.lit(-1).cast("long"))
    return _blocked(nodes).unionByName(heads, allowMissingColumns=True)


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Nodes of all rounds, the first as given, the last with one node per source."""
    levels = [nodes]
    while (levels[-1].agg(F.max("n")).first()[0] or 1) > 1:
        wanted = _blocked(levels[-1]).select("source", "block", "idx", "hash", "n")
        roots = _in_blocks(wanted, _block_roots, ROOTS)
        sizes = stored(levels[-1].filter("idx = 0").select("source", "n"), "sizes")
        sizes = sizes.select(
            F.col("source").alias("_source"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n")
        )
        if fits_broadcast(sizes):
            sizes = F.broadcast(sizes)
        roots = roots.join(sizes, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        levels.append(stored(roots, "nodes"))
    return levels


def _down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(source, idx, name, path, over) of the nodes of the first of ``levels``."""
    for nodes in reversed(levels):
        wanted = nodes.select(
            "source", "idx", "hash", "n",
            F.col("name") if "name" in nodes.columns else F.lit(None).cast("string").alias("name"),
        )
        tops = stored(_in_blocks(_with_paths(wanted, tops), _node_paths, PATHS), "paths")
    return tops


def field(value: Column) -> Column:
    text = value.cast("string")
    size = F.octet_length(text).cast("string")
    return F.coalesce(F.concat(size, F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """Hash of a row whose text is ``text``."""
    parts = [field(text if name == "text" else F.col(name)) for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def manifest(docs: DataFrame, tampered: Column, with_text: Column) -> DataFrame:
    """One row per row of ``docs``: where its leaf stands, the proof, and its version.

    ``tampered`` tells which rows have been tampered with, ``with_text`` what their text
    is then. Columns: doc_id, source, position (in the source, from 0), leaf, subroot,
    root and proof_sha256 of the untampered tree; copied, the hashes of the nodes that
    the row's version copies, from the leaf's parent to the root (null without one); and
    folded_root, the root that follows from the tampered leaf, else the given one.

    A null in any of the five columns hashes as ``-``. Leaves ascend by doc_id, null
    first, of one doc_id by their hash; equal rows have the same leaf at neighbouring
    places. An empty table has no rows. Other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.col("text").cast("string").alias("text"),
    )
    leaves = rows.select(
        "doc_id",
        "source",
        leaf(F.col("text")).alias("hash"),
        F.when(tampered, leaf(with_text)).alias("tampered"),
        F.monotonically_increasing_id().alias("tie"),
    )
    leaves = positions(stored(leaves, "leaves"), ["doc_id", "hash", "tie"])

    levels = _rounds(leaves.select("source", "idx", "hash", "n"))
    subroots = levels[-1].select(
        F.lit(None).cast("string").alias("source"), F.col("source").alias("name"), "hash"
    )
    upper = _rounds(positions(subroots, ["name"]))
    nothing = F.array().cast(SIBLINGS)
    top = upper[-1].select(
        F.lit(None).cast("string").alias("source"),
        "idx",
        nothing.alias("path"),
        nothing.alias("over"),
    )
    if len(upper) > 1:
        over = _down(upper[:-1], top)
    else:
        # One source at most: its subroot is the root.
        over = upper[0].select("name", nothing.alias("path"))
    tops = over.select(
        F.col("name").alias("source"),
        F.lit(0).cast("long").alias("idx"),
        nothing.alias("path"),
        F.col("path").alias("over"),
    )
    return _in_blocks(_with_paths(leaves, _down(levels[1:-1], tops)), _proofs, PROOFS)


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row.

    Rows whose id's crc32 is a multiple of 5 count as tampered with: A-Z of their text
    are lower case. A null id is never tampered with, a null text stays null. Rows are
    verified if the root recomputed from what they hold now is the root.
    """
    tampered = F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) == 0)
    found = manifest(docs, tampered, F.translate("text", UPPER, LOWER))
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    return found.select(*columns, (F.col("folded_root") == F.col("root")).alias("verified"))
