"""Lines of text files in file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankdraft.session import durable, fits_broadcast

# Line ends of Python's str.splitlines() that Spark's text source does not cut at.
MORE_LINE_ENDS = r"[\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _cut(value: Column) -> Column:
    """The lines of a value; a line end at the end of it begins no further line."""
    return F.split(F.regexp_replace(value, MORE_LINE_ENDS + r"\z", ""), MORE_LINE_ENDS)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of all text files below a path, numbered from 0 in file order.

    A split knows its file and offset, so a line's number is its place in the split
    plus the lines of all earlier splits; no line moves to get its number. Places
    are checkpointed first, because another scan may cut the files differently.
    """
    lines = durable(
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.explode(_cut(F.col("value"))).alias("line"),
        )
        .withColumn("_id", F.monotonically_increasing_id())
    )
    # One row per split of at most spark.sql.files.maxPartitionBytes.
    splits = lines.groupBy("_file", "_start").agg(
        F.count("*").alias("_size"), F.min("_id").alias("_first")
    )
    # Part numbers of more digits come later: part-99999 before part-100000.
    earlier = Window.orderBy(F.length("_file"), "_file", "_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = splits.select(
        "_file",
        "_start",
        "_first",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
    )
    if fits_broadcast(offsets):
        offsets = F.broadcast(offsets)
    return lines.join(offsets, ["_file", "_start"]).select(
        (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "line"
    )
