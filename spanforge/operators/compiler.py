"""Scored windows to stable, exclusive segments.

Windows: source_id, idx (unique per source), s, e, score, u (nullable).
Everything is partitioned by source_id; the exclusive partition is a sweep over
segment endpoints, so no range join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CompilerPolicy
from .islands import hysteresis, with_islands, with_runs

_ORDER = ["s", "e", "idx"]


def route_windows(windows: DataFrame, policy: CompilerPolicy) -> DataFrame:
    """windows with active, route and reason."""
    active = hysteresis("score", ["source_id"], _ORDER, policy.enter, policy.exit)
    unsure = (F.col("score") > policy.exit) & (F.col("score") < policy.enter)
    if policy.uncertainty is not None:
        unsure = unsure | F.coalesce(F.col("u") >= policy.uncertainty, F.lit(False))
    w = windows.withColumns({"active": active, "__unsure": unsure})
    route = F.when(F.col("__unsure"), policy.uncertain_route).when(F.col("active"), "keep").otherwise("discard")
    reason = F.when(F.col("__unsure"), "uncertain").when(F.col("active"), "hysteresis").otherwise("below_threshold")
    return w.withColumns({"route": route, "reason": reason}).drop("__unsure")


def _member() -> Column:
    return F.struct("s", "e", "idx", "score")


def merge_windows(routed: DataFrame, gap: float) -> DataFrame:
    """Segments of near windows of one route and reason: source_id, route, reason, s, e, members."""
    keys = ["source_id", "route", "reason"]
    grouped = with_islands(routed, keys, "s", "e", gap, _ORDER).groupBy(*keys, "island")
    return grouped.agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sort_array(F.collect_list(_member())).alias("members")).drop("island")


def _reason(column: str = "reason") -> Column:
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise("merged")


def merge_segments(segments: DataFrame, gap: float) -> DataFrame:
    """Near segments of one route joined whatever their reason."""
    keys = ["source_id", "route"]
    grouped = with_islands(segments, keys, "s", "e", gap, ["s", "e", "reason"]).groupBy(*keys, "island")
    made = grouped.agg(_reason().alias("reason"), F.min("s").alias("s"), F.max("e").alias("e"), F.flatten(F.collect_list("members")).alias("members"))
    return made.withColumn("members", F.array_sort("members")).drop("island")


def weighted_merge(segments: DataFrame, gap: float) -> DataFrame:
    """Near segments (source_id, route, s, e, mean, n) of one route with their mean weighted by n."""
    grouped = with_islands(segments, ["source_id", "route"], "s", "e", gap, ["s", "e"]).groupBy("source_id", "route", "island")
    mean = F.sum(F.col("mean") * F.col("n")) / F.sum("n")
    return grouped.agg(F.min("s").alias("s"), F.max("e").alias("e"), mean.alias("mean"), F.sum("n").alias("n")).drop("island")


def atoms(segments: DataFrame) -> DataFrame:
    """Consecutive distinct endpoints of each source: source_id, s, e."""
    points = segments.select("source_id", F.explode(F.array("s", "e")).alias("s")).distinct()
    return points.withColumn("e", F.lead("s").over(Window.partitionBy("source_id").orderBy("s"))).where("e is not null")


def exclusive_partition(segments: DataFrame) -> DataFrame:
    """Atoms with the route, reason and supporting members of the segment that wins them.

    Segments of one route are disjoint, so at any time each route has at most
    one: that of its latest start.  Precedence picks among the three.
    """
    routes = ("review", "keep", "discard")
    seg = F.struct(F.col("e").alias("till"), "reason", "members")
    starts = segments.select("source_id", F.col("s").alias("t"), *[F.when(F.col("route") == r, seg).alias(r) for r in routes])
    ends = segments.select("source_id", F.col("e").alias("t"), *[F.lit(None).cast(starts.schema[r].dataType).alias(r) for r in routes])
    points = starts.unionByName(ends).groupBy("source_id", "t").agg(*[F.max_by(r, F.col(r).isNotNull()).alias(r) for r in routes])
    w = Window.partitionBy("source_id").orderBy("t")
    now = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = points.select("source_id", F.col("t").alias("s"), F.lead("t").over(w).alias("e"), *[F.last(r, ignorenulls=True).over(now).alias(r) for r in routes]).where("e is not null")
    won = F.coalesce(*[F.when(F.col(f"{r}.till") > F.col("s"), F.struct(F.lit(r).alias("route"), F.col(f"{r}.reason").alias("reason"), F.col(f"{r}.members").alias("members"))) for r in routes])
    atom = swept.select("source_id", "s", "e", won.alias("won")).where("won is not null").select("source_id", "s", "e", "won.route", "won.reason", "won.members")
    strict = F.filter("members", lambda m: (m["s"] < F.col("e")) & (m["e"] > F.col("s")))
    return atom.withColumn("members", F.when(F.size(strict) > 0, strict).otherwise(F.col("members")))


def coalesce_adjacent(parts: DataFrame) -> DataFrame:
    """Joins touching parts of one route; members are united."""
    w = Window.partitionBy("source_id").orderBy("s")
    same = (F.lag("route").over(w) == F.col("route")) & (F.abs(F.lag("e").over(w) - F.col("s")) <= 1e-9)
    grouped = with_runs(parts.withColumn("__same", same), ["source_id"], F.col("__same"), ["s"]).groupBy("source_id", "run")
    made = grouped.agg(F.first("route").alias("route"), _reason().alias("reason"), F.min("s").alias("s"), F.max("e").alias("e"), F.array_distinct(F.flatten(F.collect_list("members"))).alias("members"))
    return made.withColumn("members", F.array_sort("members")).drop("run")


def with_stats(segments: DataFrame) -> DataFrame:
    """Mean, least and greatest score over members, and their indices."""
    scores = F.transform("members", lambda m: m["score"])
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size("members")
    return segments.withColumns({"mean_score": mean, "min_score": F.array_min(scores), "max_score": F.array_max(scores), "window_indices": F.transform("members", lambda m: m["idx"])})


def compile_segments(windows: DataFrame, policy: CompilerPolicy = CompilerPolicy()) -> DataFrame:
    """source_id, segment_index, route, reason, s, e, scores and window indices of the stable segments."""
    merged = merge_segments(merge_windows(route_windows(windows, policy), policy.gap), policy.gap)
    parts = coalesce_adjacent(exclusive_partition(merged))
    short = (F.col("route") == "keep") & (F.col("e") - F.col("s") < policy.min_duration)
    routed = parts.withColumn("__short", short).withColumns({"route": F.when(F.col("__short"), policy.short_route).otherwise(F.col("route")), "reason": F.when(F.col("__short"), "short").otherwise(F.col("reason"))}).drop("__short")
    done = with_stats(coalesce_adjacent(routed)).drop("members")
    if not policy.include_discard:
        done = done.where("route <> 'discard'")
    index = F.row_number().over(Window.partitionBy("source_id").orderBy("s", "e", "route")) - 1
    return done.withColumn("segment_index", index)
