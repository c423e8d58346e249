"""All articles below a category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankdraft.operators.lookups import salted_semi_join
from rankdraft.session import BROADCAST_BYTES, durable, fits_broadcast

ARTICLE, CATEGORY = 0, 14
# Finished tables of equally many levels that are merged into one.
MERGED = 8


def children_of(
    links: DataFrame, parents: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Links whose parent is listed; ``parents`` is a finished, distinct ``category`` list.

    One parent may hold a large share of the links. A list of checked size is
    broadcast, so links are not shuffled; otherwise links are spread over salts.
    """
    listed = parents.select(F.col("category").alias("parent"))
    if fits_broadcast(parents, broadcast_bytes):
        return links.join(F.broadcast(listed), "parent", "left_semi")
    return salted_semi_join(links, listed, "parent", spread_by="child")


def category_closure(
    links: DataFrame, root: str, recurse: bool = True, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Distinct categories reachable from a root; cycles are harmless.

    One round per level of the tree. Each level is checkpointed, so a round reads
    finished tables only. They are merged as they get many: n levels are some log n
    tables, so a round's plan does not grow with the depth, and each category is
    written again about log n times.
    """
    spark = links.sparkSession
    frontier = durable(spark.createDataFrame([(root,)], "category string"))
    seen = [(1, frontier)]
    edges = links.where(F.col("child_ns") == CATEGORY).select("parent", "child")
    while recurse:
        children = children_of(edges, frontier, broadcast_bytes)
        fresh = children.select(F.col("child").alias("category")).distinct()
        frontier = durable(fresh.join(_union(seen), "category", "left_anti"))
        if frontier.isEmpty():
            break
        seen.append((1, frontier))
        while len(seen) >= MERGED and len({levels for levels, _ in seen[-MERGED:]}) == 1:
            levels = seen[-1][0] * MERGED
            seen[-MERGED:] = [(levels, durable(_union(seen[-MERGED:]).coalesce(_tasks(spark))))]
    return _union(seen)


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _union(tables: list[tuple[int, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (table for _, table in tables))


def category_members(
    links: DataFrame, root: str, recurse: bool = True, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Distinct titles of the articles in a category and, if asked, below it."""
    categories = category_closure(links, root, recurse, broadcast_bytes)
    articles = links.where(F.col("child_ns") == ARTICLE).select("parent", "child")
    found = children_of(articles, categories, broadcast_bytes)
    return found.select(F.col("child").alias("title")).distinct()


def targets_from_category(links: DataFrame, root: str, recurse: bool = True) -> DataFrame:
    """Target list (seq, raw_title) of a category, in title order.

    ``seq`` grows with the title but has gaps.
    """
    ordered = durable(category_members(links, root, recurse).orderBy("title"))
    seq = F.monotonically_increasing_id().alias("seq")
    return ordered.select(seq, F.col("title").alias("raw_title"))
