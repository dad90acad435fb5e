"""Connected components by distributed union-find: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep

#: Edges in one task of a step; a step over few edges runs in few tasks, so that it doesn't leave many small files.
TASK_EDGES = 50_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    Nodes are of any type with an order, nulls excluded. Loops are allowed.
    Each step keeps a minimum for a node and joins it back, so no task gathers
    a node's neighbours; Spark splits a node of many edges as a skewed join key.
    """
    pairs = edges.where("a is not null and b is not null").select("a", "b")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    now = keep(pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        tasks = -(-mark[0] // TASK_EDGES)
        now = now.coalesce(tasks)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").coalesce(tasks)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m")))
        now = keep(small.where("a != b").coalesce(tasks).distinct())
        new = _mark(now)
        if new == mark:
            break
        mark = new
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return row[0], int(row[1])
