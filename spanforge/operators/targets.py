"""Training targets: boundaries rasterised on sampled frames, and masked losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rasterize(windows: DataFrame, tolerance: float) -> DataFrame:
    """source_id, window_index, boundary, frame, value, valid from windows with times array<double>, start_s, end_s and validity.

    The nearest frame (the earlier on a tie) is 1 and the others 0 if it lies
    within tolerance; otherwise the whole channel is masked.  Arrays stay in
    their row, so nothing is shuffled.
    """
    channel = lambda name, t, ok: F.struct(F.lit(name).alias("boundary"), F.when(F.coalesce(F.col(ok), F.lit(False)), F.col(t)).alias("t"))
    long = windows.select("source_id", "window_index", "times", F.explode(F.array(channel("start", "start_s", "start_valid"), channel("end", "end_s", "end_valid"))).alias("c")).select("source_id", "window_index", "times", "c.*")
    gaps = F.transform("times", lambda x: F.abs(x - F.col("t")))
    near = long.withColumn("gaps", gaps).withColumn("distance", F.array_min("gaps")).withColumn("frame_hit", F.array_position("gaps", F.col("distance")) - 1)
    valid = F.coalesce(F.col("distance") <= tolerance + 1e-12, F.lit(False))
    out = near.withColumn("valid", valid).select("source_id", "window_index", "boundary", "valid", "frame_hit", F.posexplode("times").alias("frame", "time"))
    return out.select("source_id", "window_index", "boundary", "frame", F.when(F.col("valid"), (F.col("frame") == F.col("frame_hit")).cast("int")).alias("value"), "valid")


def best_frame(probabilities: Column, least: float) -> Column:
    """Index of the first largest value of an array if it is at least `least`, else null."""
    top = F.array_max(probabilities)
    return F.when(top >= least, F.array_position(probabilities, top) - 1)


def masked_bce(logit: Column, target: Column, weight: float = 1.0) -> Column:
    """Aggregate: mean binary cross-entropy of the valid (non-null) cells, positives weighted; 0 without any."""
    soft = F.greatest(logit, F.lit(0.0)) + F.log1p(F.exp(-F.abs(logit)))
    loss = F.when(target, weight * (soft - logit)).when(~target, soft)
    return F.coalesce(F.avg(loss), F.lit(0.0))


def contrastive_loss(rows: DataFrame, batch: str, key: str, group: str, a: str, b: str, temperature: float) -> DataFrame:
    """batch, loss: symmetric cross-entropy of matching pairs within each batch; other pairs of one group are left out.

    A batch is a fixed-size training batch, so its pairs are bounded by its size.
    """
    l = rows.select(batch, F.col(key).alias("i"), F.col(group).alias("gi"), F.col(a).alias("va"))
    r = rows.select(batch, F.col(key).alias("j"), F.col(group).alias("gj"), F.col(b).alias("vb"))
    pair = l.join(r, batch).where((F.col("i") == F.col("j")) | (F.col("gi") != F.col("gj")))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    z = pair.select(batch, "i", "j", (dot / temperature).alias("z"))
    row = z.groupBy(batch, "i").agg(F.max("z").alias("m"), F.collect_list("z").alias("zs"), F.max(F.when(F.col("i") == F.col("j"), F.col("z"))).alias("d"))
    col = z.groupBy(batch, "j").agg(F.max("z").alias("m"), F.collect_list("z").alias("zs"), F.max(F.when(F.col("i") == F.col("j"), F.col("z"))).alias("d"))
    lse = F.col("m") + F.log(F.aggregate(F.transform("zs", lambda x: F.exp(x - F.col("m"))), F.lit(0.0), lambda s, x: s + x))
    both = row.select(batch, (lse - F.col("d")).alias("x")).unionByName(col.select(batch, (lse - F.col("d")).alias("x")))
    return both.groupBy(batch).agg(F.when(F.count("*") > 2, F.avg("x")).otherwise(0.0).alias("loss"))
