"""Running counts and early stops in input order, without a one-partition window.

A frame is range-partitioned by ``seq``, sorted and checkpointed. From then on its
partitions are fixed, so a row's number is its place within the partition plus
the rows of all earlier partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankdraft.config import JobConfig
from rankdraft.session import durable

# monotonically_increasing_id() keeps the place within the partition in these bits.
PLACE_BITS = 33


def in_order(df: DataFrame, key: str = "seq") -> DataFrame:
    """Durable copy of a frame in global order of ``key``."""
    return durable(df.orderBy(key))


def ranged(targets: DataFrame) -> DataFrame:
    """Durable copy of a narrow list in order of ``seq``, with the number of its range."""
    ranges = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = targets.repartitionByRange(ranges, "seq").sortWithinPartitions("seq")
    return durable(ordered).withColumn("_range", F.spark_partition_id())


def in_ranges(df: DataFrame) -> DataFrame:
    """Durable copy, in order of ``seq``, of what was made of rows of a ``ranged`` list.

    The rows go where their list's ranges say, so that no bounds are sampled from them:
    the plan that made them runs once.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionById(ranges, F.col("_range")).sortWithinPartitions("seq")
    return durable(placed.drop("_range"))


def number_rows(ordered: DataFrame, wanted: Column, name: str) -> DataFrame:
    """The wanted rows of an ``in_order`` frame, numbered from 1 in column ``name``."""
    rows = ordered.where(wanted).withColumn("_id", F.monotonically_increasing_id())
    sizes = rows.groupBy(F.shiftright("_id", PLACE_BITS).alias("_part")).agg(
        F.count("*").alias("_size")
    )
    # One row per partition of the frame.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start")
    )
    place = F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (
        rows.withColumn("_part", F.shiftright("_id", PLACE_BITS))
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + place + 1)
        .drop("_id", "_part", "_start")
    )


def first_seq(rows: DataFrame) -> int | None:
    return rows.agg(F.min("seq").alias("seq")).first()["seq"]


def from_startpoint(targets: DataFrame, title: Column, startpoint: str) -> DataFrame:
    """Targets from the first one whose title contains the start point."""
    start = first_seq(targets.where(title.contains(startpoint)))
    return targets.where(F.lit(False) if start is None else F.col("seq") >= start)


def stop_after(articles: DataFrame, successes: DataFrame, cfg: JobConfig) -> int | None:
    """``seq`` of the row after which the run stops, None if it runs to the end.

    ``articles`` holds (seq, n), ``successes`` (seq, success_no, title). The row
    that reaches a limit is still part of the output. Failures count towards the
    article limit but never meet the success limit or the end point.
    """
    stops = []
    if cfg.max_arts:
        stops.append(first_seq(articles.where(F.col("n") >= cfg.max_arts)))
    if cfg.max_stage:
        stops.append(first_seq(successes.where(F.col("success_no") >= cfg.max_stage)))
    if cfg.partial:
        stops.append(first_seq(successes.where(F.col("title").contains(cfg.endpoint))))
    return min((s for s in stops if s is not None), default=None)


def upto(rows: DataFrame, seq: int | None) -> DataFrame:
    return rows if seq is None else rows.where(F.col("seq") <= seq)
