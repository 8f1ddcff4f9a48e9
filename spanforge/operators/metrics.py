"""Evaluation metrics as aggregates; unknown labels are null and never negative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import READINESS


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))


def confusion(rows: DataFrame, true: str, pred: str, classes: int, keys: list[str] | None = None) -> DataFrame:
    """Counts of every (true, pred) pair of 0..classes-1, zeros included; rows with a null are left out."""
    keys = keys or []
    spark = rows.sparkSession
    grid = spark.range(classes).select(F.col("id").cast("int").alias("true"))
    grid = grid.join(spark.range(classes).select(F.col("id").cast("int").alias("pred")))
    if keys:
        grid = rows.select(*keys).distinct().join(F.broadcast(grid))  # classes squared rows
    n = rows.where(F.col(true).isNotNull() & F.col(pred).isNotNull()).groupBy(*keys, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return grid.join(n, [*keys, "true", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_scores(matrix: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """precision, recall, f1 and support of each class of a confusion matrix; undefined values are null."""
    keys = keys or []
    side = F.explode(F.array(F.struct(F.col("true").alias("class"), F.lit(True).alias("is_true")), F.struct(F.col("pred").alias("class"), F.lit(False).alias("is_true"))))
    long = matrix.select(*keys, "n", (F.col("true") == F.col("pred")).alias("hit"), side.alias("x")).select(*keys, "n", "hit", "x.*")
    tp = F.sum(F.when(F.col("hit") & F.col("is_true"), F.col("n")).otherwise(0))
    support, predicted = F.sum(F.when(F.col("is_true"), F.col("n")).otherwise(0)), F.sum(F.when(~F.col("is_true"), F.col("n")).otherwise(0))
    return long.groupBy(*keys, "class").agg(ratio(tp, predicted).alias("precision"), ratio(tp, support).alias("recall"), ratio(2 * tp, support + predicted).alias("f1"), support.alias("support"))


def macro(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Means over the classes where a score is defined."""
    return scores.groupBy(*(keys or [])).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def auroc(rows: DataFrame, keys: list[str], score: str, truth: str) -> DataFrame:
    """Area under the ROC curve from average ranks; null if a class is absent.

    Scores are first counted per distinct value, so the ordered pass is over
    distinct scores, not rows.
    """
    g = rows.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(F.when(F.col(truth), 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(w), F.lit(0))
    ranked = g.withColumn("rank", below + (F.col("n") + 1) / 2)
    pos, neg = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    area = ratio(F.sum(F.col("rank") * F.col("p")) - pos * (pos + 1) / 2, pos * neg)
    return ranked.groupBy(*keys).agg(area.alias("auroc"), pos.alias("positives"), neg.alias("negatives"))


def average_precision(rows: DataFrame, keys: list[str], score: str, truth: str) -> DataFrame:
    """Sum of recall steps times precision, tied scores entering together; null without positives."""
    g = rows.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(F.when(F.col(truth), 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    cut = g.withColumns({"tp": F.sum("p").over(w), "seen": F.sum("n").over(w)})
    return cut.groupBy(*keys).agg(ratio(F.sum(F.col("p") * F.col("tp") / F.col("seen")), F.sum("p")).alias("average_precision"))


def calibration_bins(rows: DataFrame, confidence: str, correct: str, bins: int) -> DataFrame:
    """Equal-width bins that have rows: bin, n, mean confidence, accuracy."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(correct).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg(ratio(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))), F.sum("n")).alias("ece"))


def selective_risk(rows: DataFrame, confidence: str, correct: str) -> DataFrame:
    """A point for each distinct confidence, most confident first: coverage and risk of the rows so far."""
    g = rows.where(F.col(correct).isNotNull()).groupBy(confidence).agg(F.count("*").alias("n"), F.sum(F.when(F.col(correct), 0).otherwise(1)).alias("wrong"))
    w = Window.orderBy(F.desc(confidence)).rowsBetween(Window.unboundedPreceding, 0)
    cum = g.select(F.col(confidence).alias("confidence"), "n", F.sum("n").over(w).alias("seen"), F.sum("wrong").over(w).alias("errors"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return cum.select("confidence", "n", (F.col("seen") / F.col("total")).alias("coverage"), (F.col("errors") / F.col("seen")).alias("risk"), "total")


def area_under_risk(curve: DataFrame) -> DataFrame:
    return curve.agg(F.sum(F.col("risk") * F.col("n") / F.col("total")).alias("aurc"))


def event_matches(reference: DataFrame, predicted: DataFrame, tolerance: float) -> DataFrame:
    """source_id, boundary, n_ref, n_pred, tp from events (source_id, boundary, t).

    The greedy merge is a fold over each sequence's sorted arrays, in the JVM.
    """
    keys = ["source_id", "boundary"]
    r = reference.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("r"))
    p = predicted.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("p"))
    both = r.join(p, keys, "full").select(*keys, *[F.coalesce(c, F.array().cast("array<double>")).alias(c) for c in ("r", "p")])
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("tp"))

    def step(s: Column, _: Column) -> Column:
        a, b = F.get("r", s["i"]), F.get("p", s["j"])
        gap = F.abs(a - b)
        hit = gap <= tolerance + 1e-12 * F.greatest(F.lit(1.0), gap)
        move = lambda di, dj, dt: F.struct((s["i"] + di).alias("i"), (s["j"] + dj).alias("j"), (s["tp"] + dt).alias("tp"))
        return F.when(a.isNull() | b.isNull(), s).when(hit, move(1, 1, 1)).when(a < b, move(1, 0, 0)).otherwise(move(0, 1, 0))

    tp = F.aggregate(F.concat("r", "p"), start, step)["tp"]
    return both.select(*keys, F.size("r").cast("long").alias("n_ref"), F.size("p").cast("long").alias("n_pred"), tp.cast("long").alias("tp"))


def event_scores(matches: DataFrame, keys: list[str]) -> DataFrame:
    tp, ref, pred = F.sum("tp"), F.sum("n_ref"), F.sum("n_pred")
    return matches.groupBy(*keys).agg(ratio(tp, pred).alias("precision"), ratio(tp, ref).alias("recall"), ratio(2 * tp, ref + pred).alias("f1"))


def softmax(logits: list[Column], temperature: float = 1.0) -> list[Column]:
    top = F.greatest(*logits)
    parts = [F.exp((x - top) / temperature) for x in logits]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def normalized_entropy(p: list[Column]) -> Column:
    import math

    terms = [F.when(x > 0, -x * F.log(x)).otherwise(0.0) for x in p]
    return sum(terms[1:], terms[0]) / math.log(len(p))


def decision(p: list[Column]) -> Column:
    """The first of the largest: KEEP, REVIEW, REJECT."""
    k, v, x = p
    return F.when((k >= v) & (k >= x), READINESS[0]).when(v >= x, READINESS[1]).otherwise(READINESS[2])


def class_weights(rows: DataFrame, label: str, classes: int) -> DataFrame:
    """Inverse frequencies scaled to mean 1."""
    n = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    inverse = n.withColumn("w", 1.0 / F.col("n"))
    return inverse.join(F.broadcast(inverse.agg((F.sum("w") / classes).alias("mean")))).select("class", "n", (F.col("w") / F.col("mean")).alias("weight"))


def positive_weights(rows: DataFrame, keys: list[str], truth: str) -> DataFrame:
    """Negatives per positive, held within 0.25 and 20; null without positives."""
    pos, neg = F.sum(F.when(F.col(truth), 1).otherwise(0)), F.sum(F.when(~F.col(truth), 1).otherwise(0))
    return rows.where(F.col(truth).isNotNull()).groupBy(*keys).agg(F.least(F.lit(20.0), F.greatest(F.lit(0.25), ratio(neg, pos))).alias("weight"), pos.alias("positives"), neg.alias("negatives"))
