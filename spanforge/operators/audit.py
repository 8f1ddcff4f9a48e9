"""Constraint audits: each returns one row per violation (entity, key, rule, detail); none means valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ISSUES, READINESS


class ContractError(ValueError):
    """Data that breaks its contract."""


def check(rows: DataFrame, entity: str, key: Column, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """rules: name -> (condition that must not hold, detail). One pass over rows."""
    broken = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail"))) for name, (bad, detail) in rules.items()])
    found = rows.select(key.cast("string").alias("key"), F.explode(F.array_compact(broken)).alias("v"))
    return found.select(F.lit(entity).alias("entity"), "key", "v.rule", "v.detail")


def duplicates(rows: DataFrame, entity: str, key: Column, rule: str = "duplicate") -> DataFrame:
    n = rows.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    return n.select(F.lit(entity).alias("entity"), "key", F.lit(rule).alias("rule"), F.col("n").cast("string").alias("detail"))


def outside(x: str, low: float = 0.0, high: float = 1.0) -> Column:
    c = F.col(x)
    return c.isNotNull() & (F.isnan(c) | (c < low) | (c > high))


def window_scores(windows: DataFrame) -> DataFrame:
    key = F.concat_ws(":", "source_id", "idx")
    rules = {
        "index": (F.col("idx").isNull() | (F.col("idx") < 0), F.col("idx")),
        "interval": (F.col("s").isNull() | F.col("e").isNull() | (F.col("s") < 0) | (F.col("e") <= F.col("s")), F.concat_ws("-", "s", "e")),
        "score_range": (F.col("score").isNull() | outside("score"), F.col("score")),
        "uncertainty_range": (outside("u"), F.col("u")),
    }
    return check(windows, "window_score", key, rules).unionByName(duplicates(windows, "window_score", key))


def training_windows(windows: DataFrame) -> DataFrame:
    """windows flattened by records.flatten."""
    key = F.col("example_id")
    rules = {
        "interval": (F.col("start_s").isNull() | F.col("end_s").isNull() | (F.col("end_s") <= F.col("start_s")), F.concat_ws("-", "start_s", "end_s")),
        "readiness_vocabulary": (F.col("readiness").isNotNull() & ~F.col("readiness").isin(*READINESS), F.col("readiness")),
        "valid_without_value": (F.col("readiness_valid") & F.col("readiness").isNull(), F.lit(None)),
        "unknown_issue": (F.size(F.array_except(F.coalesce(F.map_keys("issues"), F.array().cast("array<string>")), F.array(*map(F.lit, ISSUES)))) > 0, F.array_join(F.map_keys("issues"), ",")),
        "boundary_outside": ((F.col("boundary_start") < F.col("start_s")) | (F.col("boundary_start") > F.col("end_s")) | (F.col("boundary_end") < F.col("start_s")) | (F.col("boundary_end") > F.col("end_s")), F.lit(None)),
        "boundary_inverted": (F.col("boundary_end") < F.col("boundary_start"), F.lit(None)),
    }
    return check(windows, "training_window", key, rules)


def predictions(rows: DataFrame, probabilities: list[str]) -> DataFrame:
    """rows with a key column `key`: probabilities within 0..1 (to 1e-12) that sum to 1 (to 1e-6)."""
    total = sum((F.col(c) for c in probabilities[1:]), F.col(probabilities[0]))
    rules = {f"range_{c}": (outside(c, -1e-12, 1 + 1e-12), F.col(c)) for c in probabilities}
    rules["sum"] = (F.abs(total - 1) > 1e-6, total)
    return check(rows, "prediction", F.col("key"), rules)


def coverage(expected: DataFrame, found: DataFrame, key: str, entity: str) -> DataFrame:
    """Missing and extra keys of found against expected."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    rows = lambda d, rule: d.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("key"), F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("detail"))
    return rows(a.join(b, key, "left_anti"), "missing").unionByName(rows(b.join(a, key, "left_anti"), "extra"))


def recomputed(stated: DataFrame, computed: DataFrame, key: str, value: str, entity: str) -> DataFrame:
    """Keys whose stated value is not that computed again (relative 1e-7, absolute 1e-9), or is absent on one side."""
    both = stated.select(key, F.col(value).alias("a")).join(computed.select(key, F.col(value).alias("b")), key, "full")
    close = F.abs(F.col("a") - F.col("b")) <= F.greatest(F.lit(1e-9), 1e-7 * F.greatest(F.abs("a"), F.abs("b")))
    return check(both, entity, F.col(key), {"recompute": (~F.coalesce(close, F.col("a").isNull() & F.col("b").isNull()), F.concat_ws(" <> ", "a", "b"))})


def require(violations: DataFrame) -> None:
    """Raises with the first violation by key and rule."""
    first = violations.orderBy("entity", "key", "rule").first()
    if first is not None:
        raise ContractError(f"{first['entity']} {first['key']}: {first['rule']} {first['detail'] or ''}".strip())
