"""Interval joins, always with the source key in the equality part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .islands import interval_union


def overlapping(windows: DataFrame, spans: DataFrame, bucket: float | None = None) -> DataFrame:
    """Pairs of windows (source_id, window_index, s, e) and spans (source_id, a, b, ...) that strictly overlap.

    bucket: with it, both sides are dealt to time buckets of that length, so a
    long source is many keys; a pair counts in the first bucket that both share.
    """
    strict = (F.col("a") < F.col("e")) & (F.col("b") > F.col("s"))
    if bucket is None:
        return windows.join(spans, "source_id").where(strict)
    deal = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket)))
    left = windows.withColumn("__k", deal("s", "e"))
    right = spans.withColumn("__k", deal("a", "b"))
    first = F.greatest(F.floor(F.col("s") / bucket), F.floor(F.col("a") / bucket)) == F.col("__k")
    return left.join(right, ["source_id", "__k"]).where(strict & first).drop("__k")


def occupancy(windows: DataFrame, actions: DataFrame, bucket: float | None = None) -> DataFrame:
    """windows with the share of each that the union of actions covers.

    Actions of a source are united once; clipping the blocks gives each window's union.
    """
    blocks = interval_union(actions, ["source_id"], "a", "b", []).select("source_id", "a", "b")
    cut = overlapping(windows, blocks, bucket).select("source_id", "window_index", (F.least("b", "e") - F.greatest("a", "s")).alias("part"))
    covered = cut.groupBy("source_id", "window_index").agg(F.sum("part").alias("covered"))
    both = windows.join(covered, ["source_id", "window_index"], "left")
    return both.withColumn("occupancy", F.coalesce("covered", F.lit(0.0)) / (F.col("e") - F.col("s"))).drop("covered")


def occupancy_class(keep: float):
    """KEEP from `keep` on, REVIEW above nothing, else REJECT; compared before rounding."""
    return F.when(F.col("occupancy") >= keep, "KEEP").when(F.col("occupancy") > 0, "REVIEW").otherwise("REJECT")


def window_boundaries(windows: DataFrame, actions: DataFrame) -> DataFrame:
    """First start and last end of actions within each window (inclusive); an inverted pair is masked."""
    points = actions.select("source_id", F.explode(F.array(F.struct(F.lit(True).alias("is_start"), F.col("a").alias("t")), F.struct(F.lit(False).alias("is_start"), F.col("b").alias("t")))).alias("p")).select("source_id", "p.*")
    inside = windows.join(points, "source_id").where((F.col("t") >= F.col("s")) & (F.col("t") <= F.col("e")))
    found = inside.groupBy("source_id", "window_index").agg(F.min(F.when(F.col("is_start"), F.col("t"))).alias("first_start"), F.max(F.when(~F.col("is_start"), F.col("t"))).alias("last_end"))
    ok = F.coalesce(F.col("last_end") >= F.col("first_start"), F.lit(True))
    out = windows.join(found, ["source_id", "window_index"], "left")
    return out.withColumns({"start_valid": F.col("first_start").isNotNull() & ok, "end_valid": F.col("last_end").isNotNull() & ok})


def nearest_window(points: DataFrame, windows: DataFrame) -> DataFrame:
    """points (source_id, t) with the window whose middle is nearest; the earlier window wins ties."""
    pair = points.join(windows, "source_id")
    far = F.abs((F.col("s") + F.col("e")) / 2 - F.col("t"))
    return pair.groupBy("source_id", "t").agg(F.min_by("window_index", F.struct(far, "s", "window_index")).alias("window_index"))


def frame_spans(frames: DataFrame, fps: float, label: list[str]) -> DataFrame:
    """Runs of frames with equal labels: source_id, span, labels, s, e; a span ends where the next begins."""
    from .islands import with_runs

    w = Window.partitionBy("source_id").orderBy("frame")
    same = F.lit(True)
    for c in label:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    same = same & F.lag("frame").over(w).isNotNull()
    runs = with_runs(frames.withColumn("__same", same), ["source_id"], F.col("__same"), ["frame"], "span")
    made = runs.groupBy("source_id", "span").agg(*[F.first(c).alias(c) for c in label], F.min("timestamp_s").alias("s"), F.max("timestamp_s").alias("last"))
    until = F.lead("s").over(Window.partitionBy("source_id").orderBy("span"))
    end = F.coalesce(until, F.col("last"))
    return made.withColumn("e", F.round(F.when(end <= F.col("s"), F.col("s") + 1 / fps).otherwise(end), 6)).drop("last")
