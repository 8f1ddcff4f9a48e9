"""From model output to predictions; the model itself is a pluggable Arrow function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics


def run_model(windows: DataFrame, model: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies a batch model to windows with gathered features; schema: of its output."""
    return windows.mapInArrow(model, schema)


def sample_once(refs: DataFrame, samples: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """References with the encoding of their sample; each unique sample is encoded once.

    encode: adds columns to samples (source_id, sample_index, ...).
    """
    return refs.join(encode(samples), ["source_id", "sample_index"])


def predict(logits: DataFrame, temperature: float, thresholds: dict[str, float]) -> DataFrame:
    """logits: z_keep, z_review, z_reject and i_<issue>; adds probabilities, decision, uncertainties and reported issues."""
    k, v, x = metrics.softmax([F.col(f"z_{c}") for c in ("keep", "review", "reject")], temperature)
    d = logits.withColumns({"p_keep": k, "p_review": v, "p_reject": x, **{f"p_{i}": 1 / (1 + F.exp(-F.col(f"i_{i}"))) for i in thresholds}})
    p = [F.col("p_keep"), F.col("p_review"), F.col("p_reject")]
    entropy = metrics.normalized_entropy(p)
    reported = F.array_compact(F.array(*[F.when(F.col(f"p_{i}") >= t, F.lit(i)) for i, t in thresholds.items()]))
    return d.withColumns({"decision": metrics.decision(p), "entropy": entropy, "routing_uncertainty": F.greatest(entropy, F.col("p_review")), "reported_issues": reported})


def normalized(vector: str):
    """A vector of length 1 (an all-zero one stays so)."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12)))
