"""Sampling plans: sliding windows of each source, sample times, and unique samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PlanSpec

EPSILON = 1e-12


def sliding_windows(sources: DataFrame, spec: PlanSpec) -> DataFrame:
    """source_id, window_index, s, e, tail from source_id, duration. Nothing is shuffled."""
    d, w, s = F.col("duration"), F.lit(spec.window), F.lit(spec.stride)
    many = d > w + EPSILON
    n = F.when(many, F.floor((d - w + EPSILON) / s) + 1).otherwise(1).cast("int")
    regular = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * s).alias("s"), F.least(d, i * s + w).alias("e"), F.lit(False).alias("tail")))
    whole = F.array(F.struct(F.lit(0.0).alias("s"), d.alias("e"), F.lit(False).alias("tail")))
    plan = sources.where(d > 0).withColumn("__w", F.when(many, regular).otherwise(whole))
    last = F.element_at("__w", -1)
    if spec.include_tail:
        short = (last["e"] < d - EPSILON) & (F.abs((d - w) - last["s"]) > EPSILON)
        tail = F.array(F.struct((d - w).alias("s"), d.alias("e"), F.lit(True).alias("tail")))
        plan = plan.withColumn("__w", F.when(many & short, F.concat("__w", tail)).otherwise(F.col("__w")))
    return plan.select("source_id", F.posexplode("__w").alias("window_index", "w")).select("source_id", "window_index", "w.s", "w.e", "w.tail")


def sample_times(start: Column, end: Column, count: int, strategy: str) -> Column:
    """array<double> of `count` times in a window, to 12 decimals."""
    width = end - start
    if strategy == "center":
        at = lambda j: start + (j + 0.5) * width / count
    elif strategy == "start":
        at = lambda j: start + j * width / count
    elif count == 1:
        at = lambda j: start + width / 2 + j * 0
    else:
        at = lambda j: start + j * width / (count - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: F.round(at(j.cast("double")), 12))


def plan_samples(sources: DataFrame, spec: PlanSpec) -> tuple[DataFrame, DataFrame]:
    """Unique samples (source_id, sample_index, timestamp_s, source_timestamp_s) and window references.

    References: source_id, window_index, position, sample_index.  A dense rank
    numbers distinct times, so samples and references need one shuffle by source.
    """
    windows = sliding_windows(sources, spec)
    times = windows.select("source_id", "window_index", F.posexplode(sample_times(F.col("s"), F.col("e"), spec.frames, spec.strategy)).alias("position", "timestamp_s"))
    refs = times.withColumn("sample_index", F.dense_rank().over(Window.partitionBy("source_id").orderBy("timestamp_s")) - 1)
    samples = refs.groupBy("source_id", "sample_index").agg(F.first("timestamp_s").alias("timestamp_s"))
    start = sources.select("source_id", F.coalesce("start_time", F.lit(0.0)).alias("start_time"))
    samples = samples.join(start, "source_id").select("source_id", "sample_index", "timestamp_s", F.round(F.col("timestamp_s") + F.col("start_time"), 12).alias("source_timestamp_s"))
    return samples, refs.select("source_id", "window_index", "position", "sample_index")


def uniform_indices(n: Column, count: int) -> Column:
    """Indices of `count` of n frames: all if n <= count, the first for count 1, else rounded equal steps (half to even)."""
    if count == 1:
        return F.array(F.lit(0).cast("long"))
    step = (n - 1) / F.lit(float(count - 1))
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * step).cast("long"))
    return F.when(n <= count, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).otherwise(spread)
