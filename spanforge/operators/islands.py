"""Ordered-sequence helpers: state with hysteresis, runs, and groups of near intervals.

All take the partitioning keys explicitly; every ordering ends in a unique
column, so results don't depend on the order of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hysteresis(score: str, keys: list[str], order: list[str], enter: float, exit_: float, initial: bool = False) -> Column:
    """True from a score of at least `enter` until one below `exit_`.

    A score outside the band forces the state, so the state is that of the last
    such score: no loop over rows is needed.
    """
    forced = F.when(F.col(score) >= enter, True).when(F.col(score) < exit_, False)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(forced, ignorenulls=True).over(w), F.lit(initial))


def with_islands(df: DataFrame, keys: list[str], start: str, end: str, gap: float, order: list[str], name: str = "island") -> DataFrame:
    """Numbers groups of intervals: a new one begins beyond the latest end so far plus gap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    latest = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(latest.isNull() | (F.col(start) > latest + F.lit(gap)), 1).otherwise(0)
    return df.withColumn("__new", fresh).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def with_runs(df: DataFrame, keys: list[str], same: Column, order: list[str], name: str = "run") -> DataFrame:
    """Numbers runs: `same` says whether a row continues the one before it (null for the first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return df.withColumn("__new", fresh).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def interval_union(df: DataFrame, keys: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """The union of intervals as disjoint blocks (touching ones merge): keys, block, start, end, n."""
    blocks = with_islands(df, keys, start, end, 0.0, [start, end, *order], "block")
    return blocks.groupBy(*keys, "block").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def even_cap(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """At most cap rows of each key, evenly spread in order: the middle one for cap 1, else both ends and equal steps."""
    w = Window.partitionBy(*keys)
    r = df.withColumns({"__n": F.count("*").over(w), "__i": F.row_number().over(w.orderBy(*order)) - 1})
    if cap < 1:
        raise ValueError("cap must be positive")
    if cap == 1:
        keep = F.col("__i") == F.expr("(__n - 1) div 2")
    else:
        # Row i is the k-th pick iff k = ceil(i * (cap - 1) / (n - 1)) lands on it.
        k = F.expr(f"(__i * {cap - 1} + __n - 2) div greatest(__n - 1, 1)")
        keep = (F.col("__n") <= cap) | (F.expr("__k * (__n - 1) div " + str(cap - 1)) == F.col("__i"))
        r = r.withColumn("__k", k)
    return r.where(keep).drop("__n", "__i", "__k")
