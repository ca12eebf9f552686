"""Connected components of a graph given by its edges, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges for each task of a round, and tasks at least: a round's tasks and their files follow its
#: edges, which are few and short rows, and not the partitions of a shuffle of whole documents.
SHARE, LEAST = 100_000, 4


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One step of alternating large and small stars: neighbours point to the least one.

    Minima are taken before anything is joined, so a node of many edges costs its tasks
    one row each; the join behind may be split where it is skewed.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u").coalesce(tasks)
    if large:
        return joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.coalesce(tasks).select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges (a, b): the least node it is connected with.

    Two numbers a round leave the cluster; rounds grow with the logarithm of the longest
    path. Edges within one node, and repeated ones, do no harm.
    """
    now = cut(edges.filter("a <> b").distinct())
    tasks = max(LEAST, -(-now.count() // SHARE))
    now, before = now.coalesce(tasks), None
    while True:
        now = cut(_star(_star(now, True, tasks), False, tasks).filter("a <> b").distinct().coalesce(tasks))
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before:
            break
        before = state
    nodes = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.union(now.select("b", "b").distinct().coalesce(tasks))
