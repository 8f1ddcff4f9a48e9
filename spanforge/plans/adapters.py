"""Composite operators: weak-label adapters, corpus build, evaluation and release audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AdapterSpec, PlanSpec, SplitSpec
from ..operators import audit, curation, intervals, metrics, planning, splits
from ..operators.islands import even_cap


def occupancy_windows(videos: DataFrame, actions: DataFrame, spec: AdapterSpec = AdapterSpec(), bucket: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Weakly labelled windows of videos (source_id, duration) from action intervals, and violations.

    actions: source_id, a, b.  Classes by covered share, boundaries from the
    first start and last end, at most spec.caps windows a class, evenly spread.
    """
    late = actions.join(videos, "source_id").where(F.col("b") > F.col("duration") + 0.5)
    bad = late.select(F.lit("action").alias("entity"), F.col("source_id").cast("string").alias("key"), F.lit("beyond_duration").alias("rule"), F.col("b").cast("string").alias("detail"))
    idle = videos.join(actions.select("source_id").distinct(), "source_id", "left_anti")
    bad = bad.unionByName(idle.select(F.lit("video").alias("entity"), F.col("source_id").cast("string").alias("key"), F.lit("no_action").alias("rule"), F.lit(None).cast("string").alias("detail")))
    grid = planning.sliding_windows(videos, PlanSpec(window=spec.window, stride=spec.stride)).select("source_id", "window_index", "s", "e")
    kinds = intervals.occupancy(grid, actions.select("source_id", "a", "b"), bucket).withColumn("kind", intervals.occupancy_class(spec.keep_occupancy))
    marked = kinds.join(intervals.window_boundaries(grid, actions.select("source_id", "a", "b")).drop("s", "e"), ["source_id", "window_index"])
    capped = [even_cap(marked.where(F.col("kind") == k), ["source_id"], ["s", "e", "window_index"], cap) for k, cap in zip(("KEEP", "REVIEW", "REJECT"), spec.caps, strict=True)]
    out = capped[0].unionByName(capped[1]).unionByName(capped[2])
    return out.withColumn("occupancy", F.round("occupancy", 8)), bad


def episode_windows(episodes: DataFrame, frames: DataFrame, labels: list[str], fps: float) -> tuple[DataFrame, DataFrame]:
    """Label spans of episodes (episode_index, length, offset_s, until_s) on their packed video, and violations.

    frames: episode_index, frame_index, timestamp, labels.  Frames must be
    0..length-1 with strictly increasing times.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("episode_index").orderBy("frame_index")
    steps = frames.withColumns({"at": F.row_number().over(w) - 1, "before": F.lag("timestamp").over(w)})
    seen = steps.groupBy("episode_index").agg(F.count("*").alias("n"), F.bool_and(F.col("at") == F.col("frame_index")).alias("dense"), F.bool_and(F.coalesce(F.col("before") < F.col("timestamp"), F.lit(True))).alias("rising"))
    both = episodes.join(seen, "episode_index", "left")
    bad = audit.check(both, "episode", F.col("episode_index"), {"length": (~F.coalesce(F.col("n") == F.col("length"), F.lit(False)), F.col("n")), "contiguous": (~F.col("dense"), F.lit(None)), "increasing": (~F.col("rising"), F.lit(None)), "range": (F.col("until_s") <= F.col("offset_s"), F.concat_ws("-", "offset_s", "until_s"))})
    spans = intervals.frame_spans(frames.select(F.col("episode_index").alias("source_id"), F.col("frame_index").alias("frame"), F.col("timestamp").alias("timestamp_s"), *labels), fps, labels)
    last = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("span"))) == 1
    placed = spans.withColumn("__last", last).join(episodes.withColumnRenamed("episode_index", "source_id"), "source_id")
    end = F.when(F.col("__last"), F.greatest(F.col("until_s") - F.col("offset_s"), F.col("s") + 1 / fps)).otherwise(F.col("e"))
    cut = F.round(F.least(end + F.col("offset_s"), "until_s"), 6)
    return placed.withColumn("e", cut).withColumn("s", F.round(F.col("s") + F.col("offset_s"), 6)).drop("__last", "length", "offset_s", "until_s"), bad


def corpus(windows: DataFrame, events: DataFrame, caps: tuple[int, int, int] = (12, 12, 6), visibility_cap: int = 6) -> DataFrame:
    """Readiness, visibility and control rows of one corpus: id, source_id, s, e, task, label, value.

    windows: source_id, window_index, s, e, kind, occupancy; events: source_id, s, e, text.
    """
    parts = [even_cap(windows.where(F.col("kind") == k), ["source_id"], ["s", "e", "window_index"], cap) for k, cap in zip(("KEEP", "REVIEW", "REJECT"), caps, strict=True)]
    ready = parts[0].unionByName(parts[1]).unionByName(parts[2])
    row = lambda task, label, value: [F.lit(task).alias("task"), label.alias("label"), value.alias("value")]
    name = lambda task: F.concat_ws(":", F.col("source_id"), F.lit(task), F.format_string("%.6f", "s"), F.format_string("%.6f", "e")).alias("id")
    readiness = ready.select(name("readiness"), "source_id", "s", "e", *row("readiness", F.col("kind"), F.lit(True)))
    activity = ready.select(name("activity"), "source_id", "s", "e", *row("issue", F.lit("low_hand_activity"), curation.low_activity(F.col("kind"), F.col("occupancy"))))
    seen = events.withColumn("v", curation.visibility(F.col("text"))).where("v is not null")
    visible = even_cap(seen, ["source_id", "v"], ["s", "e", "text"], visibility_cap).select(name("visibility"), "source_id", "s", "e", *row("issue", F.lit("acting_hand_not_visible"), F.col("v")))
    issues = F.explode(F.array(*map(F.lit, ("camera_instability", "blur", "exposure", "scene_cut", "duplicate_frames")))).alias("label")
    control = curation.top_control(ready).select("source_id", "s", "e", issues).select(F.concat_ws(":", F.col("source_id"), F.lit("control"), "label").alias("id"), "source_id", "s", "e", *row("issue", F.col("label"), F.lit(False)))
    return readiness.unionByName(activity).unionByName(visible).unionByName(control)


def split_corpus(
    rows: DataFrame, group: str, label: str, issue: str | Sequence[str], spec: SplitSpec, least: int = splits.LEAST, seeds: int = splits.SEEDS, boundaries: Sequence[str] = (), issue_kind: str | None = None
) -> tuple[int, DataFrame]:
    """The first seed whose splits are all supported (see splits.first_supported_seed), and its assignment.

    A release names all issues, both boundaries and issue_kind.
    """
    found = splits.first_supported_seed(rows, group, label, issue, spec, seeds, least, 0, boundaries, issue_kind).first()
    if found is None:
        raise audit.ContractError(f"no seed below {seeds} supports every split")
    return found["seed"], splits.group_assignments(rows, group, SplitSpec(found["seed"], spec.fractions, spec.names))


def evaluate(rows: DataFrame) -> dict[str, DataFrame]:
    """All reports of predictions: y, pred, confidence, correct, source."""
    matrix = metrics.confusion(rows, "y", "pred", 3)
    bins = metrics.calibration_bins(rows, "confidence", "correct", 15)
    curve = metrics.selective_risk(rows, "confidence", "correct")
    by_source = metrics.class_scores(metrics.confusion(rows, "y", "pred", 3, ["source"]), ["source"])
    return {"confusion": matrix, "classes": metrics.class_scores(matrix), "macro": metrics.macro(metrics.class_scores(matrix)), "bins": bins, "ece": metrics.expected_calibration_error(bins), "risk": curve, "aurc": metrics.area_under_risk(curve), "by_source": metrics.macro(by_source, ["source"])}


HUMAN = ("human", "human-derived")


def release_violations(splits_doc: DataFrame, predictions: DataFrame) -> DataFrame:
    """Leakage, coverage, provenance and support of a release.

    splits_doc: id, group_id, split; predictions: id, group_id, readiness_kind,
    readiness_valid, issue_kind, issue_valid, boundary_kind, boundary_valid, review_count, rubric.
    """
    row = lambda d, entity, key, rule: d.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("key"), F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("detail"))
    out = row(splits.leaked_groups(splits_doc, "group_id", "split"), "group", "group_id", "in_several_splits")
    out = out.unionByName(audit.duplicates(splits_doc, "example", F.col("id")))
    out = out.unionByName(audit.check(splits_doc, "example", F.col("id"), {"split": (~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False)), F.col("split"))}))
    test = splits_doc.where("split = 'test'")
    out = out.unionByName(audit.coverage(test, predictions, "id", "prediction"))
    both = predictions.join(test.select("id", F.col("group_id").alias("__g")), "id")
    human = lambda c: F.coalesce(F.col(c).isin(*HUMAN), F.lit(False))
    rules = {
        "group": (F.col("group_id") != F.col("__g"), F.col("group_id")),
        "readiness_provenance": (F.col("readiness_valid") & ~human("readiness_kind"), F.col("readiness_kind")),
        "readiness_controlled": (~F.col("readiness_valid") & (F.col("readiness_kind") == "programmatic-controlled-corruption"), F.col("readiness_kind")),
        "issue_provenance": (F.col("issue_valid") == (F.coalesce("issue_kind", F.lit("unlabeled")) == "unlabeled"), F.col("issue_kind")),
        "boundary_provenance": ((F.col("boundary_valid") & ~human("boundary_kind")) | (~F.col("boundary_valid") & (F.coalesce("boundary_kind", F.lit("unlabeled")) != "unlabeled")), F.col("boundary_kind")),
        "review": (human("readiness_kind") & (F.coalesce("review_count", F.lit(0)) < 2), F.col("review_count")),
        "rubric": (human("readiness_kind") & F.col("rubric").isNull(), F.lit(None)),
    }
    return out.unionByName(audit.check(both, "prediction", F.col("id"), rules))
