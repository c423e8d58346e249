"""Helpers shared by the operators: tables, folds, batches, scratch folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankdraft.session import scratch_dir

# Rows that one step of a Python pass holds at a time, and the bytes of their texts.
SLICE_ROWS = 512
SLICE_BYTES = 2 << 20
# Bounds of the batches that go to Python tasks and come back, unless the session has its
# own: the default of 10,000 rows is some 100 MB of long texts, twice, for each task.
ARROW_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """The two columns an operator reads; whatever else a table holds is left behind."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    as_text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(as_text.cast("binary")) % folds


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that all executors see."""
    return f"{scratch_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, lineage cut."""
    folder = shared_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part holds few rows and few bytes; a row stays whole."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                sizes += np.asarray(pc.fill_null(pc.binary_length(column), 0))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))
            stop = min(max(stop, start + 1), start + SLICE_ROWS)
            yield batch.slice(start, stop - start)
            start = stop


def gathered(parts: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Put small parts together up to some ``size`` bytes: more of their words are the same."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        held.append(part)
        if sum(p.nbytes for p in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


# What a Python worker keeps from one task to the next, by name; one thing at a time.
_KEPT: dict[tuple, object] = {}


def kept(name: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a Python worker as long as it runs such passes."""
    if name not in _KEPT:
        release_kept()
        _KEPT[name] = make()
    return _KEPT[name]


def release_kept() -> None:
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def in_arrow(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
    keeps: bool = False,
) -> DataFrame:
    """``mapInArrow`` over batches of bounded size.

    Spark's Python workers go on from pass to pass. Only passes that say so find there
    what ``kept`` made; others let go of it, which may be some hundred MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        yield from fn(batches)

    conf = df.sparkSession.conf
    for key, value in ARROW_BATCHES.items():
        if conf.get(key, None) is None:
            conf.set(key, value)
    return df.mapInArrow(fn if keeps else run, schema)


def map_slices(
    df: DataFrame,
    schema: str | StructType,
    fn: Callable[[pa.RecordBatch], dict[str, object]],
    keeps: bool = False,
    gather: int = 1,
) -> DataFrame:
    """Apply ``fn`` to slices of the rows; it returns the columns of ``schema`` by name.

    With ``gather``, slices are put together until they have so many bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(slices(batches), gather):
            yield to_batch(fn(part))

    return in_arrow(df, run, schema, keeps)


def to_batch(columns: dict[str, object]) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def strings(column: pa.Array) -> list[str]:
    """The texts as Python strings, a null as an empty text."""
    return ["" if s is None else s for s in column.to_pylist()]


class Remembered(dict):
    """Results of a function for short keys, in bounded memory.

    There are two generations of up to ``size`` keys. When the young one is full it
    becomes the old one, and what is asked for again comes back from there.
    """

    def __init__(self, fn: Callable, size: int, longest: int) -> None:
        super().__init__()
        self.fn, self.size, self.longest = fn, size, longest
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        self.keep({key: value}, [key])
        return value

    def known(self, keys: Iterable) -> tuple[dict, list]:
        """Results of those of the distinct keys that are remembered, and the other keys."""
        found, older, other = {}, [], []
        for key in keys:
            if key in self:
                found[key] = self[key]
            elif key in self.old:
                found[key] = self.old[key]
                older.append(key)
            else:
                other.append(key)
        self.keep(found, older)
        return found, other

    def keep(self, results: dict, keys: Iterable) -> None:
        """Remember the results of these keys."""
        for key in keys:
            if len(key) <= self.longest:
                if len(self) >= self.size:
                    self.old = dict(self)
                    self.clear()
                self[key] = results[key]
