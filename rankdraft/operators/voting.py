"""The vote over rank columns as rows, for rank sets of any number of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def modes_by_rows(rows: DataFrame, rank_columns: list[str]) -> DataFrame:
    """(title, rank, votes): the most common non-null ranks of each title.

    Counting per title and rank combines map-side. The window then sees at most one
    row per known rank of a title.
    """
    ranks = F.explode(F.array_compact(F.array(*rank_columns))).alias("rank")
    votes = rows.select("title", ranks).groupBy("title", "rank").agg(F.count("*").alias("votes"))
    place = F.rank().over(Window.partitionBy("title").orderBy(F.desc("votes")))
    return votes.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")
