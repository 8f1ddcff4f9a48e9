"""Connected components of a graph given as edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v): every node's neighbours are linked to its least neighbour or itself."""
    rows = pairs.count()
    least = pairs.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("degree")).withColumn("low", F.least("u", "low"))
    near = work.join_hot(pairs, least, ["u"], "degree", rows)
    if large:
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("low").alias("b"))
    else:
        own = least.select(F.col("u").alias("a"), F.col("low").alias("b"))
        out = near.select(F.col("v").alias("a"), F.col("low").alias("b")).unionByName(own)
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of edges (a, b: long); order and direction don't matter.

    The graph is cut off by a table after each round; rounds grow with the
    logarithm of the nodes. Hubs of any degree are handled in parallel.
    """
    now = work.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = work.table(_star(both, large=True))
        now = work.table(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), large=False))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
