"""Calibration on validation rows: temperature, issue thresholds, routing grid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import ratio


def fit_temperature(rows: DataFrame, logits: list[str], label: str, rounds: int = 3, points: int = 41) -> float:
    """The temperature in [0.05, 20] of least negative log-likelihood.

    Each round evaluates a whole grid of temperatures in one aggregate and
    narrows it around the best; the loss is convex in 1 / T.
    """
    low, high = np.log(0.05), np.log(20.0)
    known = rows.where(F.col(label).isNotNull())
    for _ in range(rounds):
        grid = np.exp(np.linspace(low, high, points))

        def loss(t: float):
            z = [F.col(c) / float(t) for c in logits]
            top = F.greatest(*z)
            total = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
            return F.sum(F.log(total) + top - F.element_at(F.array(*z), F.col(label) + 1))

        values = known.agg(*[loss(t).alias(f"l{k}") for k, t in enumerate(grid)]).first()
        best = int(np.argmin([np.inf if v is None else v for v in values]))
        step = (high - low) / (points - 1)
        middle = np.log(grid[best])
        low, high = max(np.log(0.05), middle - step), min(np.log(20.0), middle + step)
    return float(np.exp((low + high) / 2))


def threshold_sweep(rows: DataFrame, keys: list[str], score: str, truth: str) -> DataFrame:
    """F1 at each fixed candidate and each distinct score: keys, threshold, f1 (0 where undefined).

    Counts per distinct score are cumulated from the top, so a threshold costs
    one row, not one pass.
    """
    from pyspark.sql import Window

    known = rows.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    fixed = sorted({0.05, 0.95, *np.linspace(0.1, 0.9, 17).tolist()})
    scored = known.groupBy(*keys, F.col(score).alias("threshold")).agg(F.sum(F.when(F.col(truth), 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    marks = known.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(x) for x in fixed])).alias("threshold"))
    points = scored.unionByName(marks.withColumns({"p": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})).groupBy(*keys, "threshold").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    cut = points.select(*keys, "threshold", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("called"), F.sum("p").over(every).alias("pos"), F.sum("n").over(every).alias("total"))
    return cut.withColumn("f1", F.coalesce(ratio(2 * F.col("tp"), F.col("called") + F.col("pos")), F.lit(0.0)))


def best_thresholds(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold of best F1, then nearest one half, then the larger; one half if a class is absent."""
    order = F.struct("f1", -F.abs(F.col("threshold") - 0.5), "threshold")
    best = sweep.groupBy(*keys).agg(F.max_by("threshold", order).alias("threshold"), F.max("pos").alias("pos"), F.max("total").alias("total"))
    return best.select(*keys, F.when((F.col("pos") == 0) | (F.col("pos") == F.col("total")), 0.5).otherwise(F.col("threshold")).alias("threshold"))


def routing_grid(rows: DataFrame, keep: str, review: str, entropy: str, label: str) -> DataFrame:
    """Macro-F1 of every (uncertainty, enter) pair of the grid: 132 rows of literals against the rows."""
    spark = rows.sparkSession
    cells = [(float(u), float(e)) for u in np.linspace(0.35, 0.85, 11) for e in np.linspace(0.35, 0.9, 12)]
    grid = F.broadcast(spark.createDataFrame(cells, "uncertainty double, enter double"))
    known = rows.where(F.col(label).isNotNull()).select(F.col(keep).alias("k"), F.greatest(entropy, review).alias("unsure"), F.col(label).alias("y"))
    pred = F.when(F.col("unsure") >= F.col("uncertainty"), 1).when(F.col("k") >= F.col("enter"), 0).otherwise(2)
    cell = known.join(grid).groupBy("uncertainty", "enter", F.col("y"), pred.alias("p")).agg(F.count("*").alias("n"))
    sums = cell.groupBy("uncertainty", "enter").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"{name}{k}") for k in range(3) for name, c in (("tp", (F.col("y") == k) & (F.col("p") == k)), ("s", F.col("y") == k), ("c", F.col("p") == k))])
    f1 = [ratio(2 * F.col(f"tp{k}"), F.col(f"s{k}") + F.col(f"c{k}")) for k in range(3)]
    defined = sum((x.isNotNull().cast("int") for x in f1[1:]), f1[0].isNotNull().cast("int"))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in f1[1:]), F.coalesce(f1[0], F.lit(0.0)))
    return sums.select("uncertainty", "enter", F.coalesce(ratio(total, defined), F.lit(0.0)).alias("macro_f1"))


def best_routing(grid: DataFrame) -> DataFrame:
    best = grid.agg(F.max_by(F.struct("uncertainty", "enter", "macro_f1"), F.struct("macro_f1", "uncertainty", "enter")).alias("b")).select("b.*")
    return best.withColumn("exit", F.greatest(F.lit(0.0), F.col("enter") - 0.15))
