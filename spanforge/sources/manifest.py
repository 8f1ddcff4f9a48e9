"""Scan manifests: a header, window and segment records as JSON lines of one tagged union."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import READINESS, ROUTE_DECISION
from ..operators import audit
from . import jsonl

SCHEMA, VERSION = "spanforge.manifest", 1
_PROBABILITIES = "map<string,double>"
RECORD = f"record_type string, schema string, version int, index int, start_s double, end_s double, score double, uncertainty double, decision string, route string, reason string, readiness {_PROBABILITIES}, issues {_PROBABILITIES}, reported_issues array<string>, window_indices array<int>, mean_score double, window_count int, segment_count int, duration_s double"


def build(windows: DataFrame, segments: DataFrame, duration: DataFrame) -> DataFrame:
    """source_id, kind (0 header, 1 window, 2 segment), index and value: canonical JSON of all records.

    windows: source_id, idx, s, e, score, u; segments: of compile_segments; duration: source_id, duration.
    """
    counts = duration.join(windows.groupBy("source_id").agg(F.count("*").alias("w")), "source_id", "left").join(segments.groupBy("source_id").agg(F.count("*").alias("g")), "source_id", "left")
    tag = lambda kind: [F.lit(kind).alias("record_type"), F.lit(SCHEMA).alias("schema"), F.lit(VERSION).alias("version")]
    decision = F.create_map(*[F.lit(x) for kv in ROUTE_DECISION.items() for x in kv])
    parts = [
        counts.select("source_id", F.lit(0).alias("kind"), F.lit(0).alias("index"), F.to_json(F.struct(*tag("header"), F.col("duration").alias("duration_s"), F.coalesce("w", F.lit(0)).alias("window_count"), F.coalesce("g", F.lit(0)).alias("segment_count"))).alias("value")),
        windows.select("source_id", F.lit(1).alias("kind"), F.col("idx").alias("index"), F.to_json(F.struct(*tag("window"), F.col("idx").alias("index"), F.col("s").alias("start_s"), F.col("e").alias("end_s"), "score", F.col("u").alias("uncertainty"))).alias("value")),
        segments.select("source_id", F.lit(2).alias("kind"), F.col("segment_index").alias("index"), F.to_json(F.struct(*tag("segment"), F.col("segment_index").alias("index"), F.col("s").alias("start_s"), F.col("e").alias("end_s"), "route", "reason", F.element_at(decision, F.col("route")).alias("decision"), "mean_score", "window_indices")).alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("value", jsonl.canonical_text(F.col("value")))


def write(manifest: DataFrame, path: str) -> None:
    """One folder per source, in record order; never overwrites."""
    ordered = manifest.repartition("source_id").sortWithinPartitions("source_id", "kind", "index")
    ordered.select("source_id", "value").write.mode("errorifexists").partitionBy("source_id").text(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records (path, line, and the fields of RECORD) and violations of the file format."""
    lines = jsonl.with_line_rank(jsonl.read_lines(spark, path)).withColumn("r", F.from_json("value", RECORD))
    key = F.concat_ws(":", "path", "line")
    rules = {
        "header_first": ((F.col("n") == 0) & ~F.coalesce(F.col("r.record_type") == "header", F.lit(False)), F.col("r.record_type")),
        "schema": ((F.col("n") == 0) & ~F.coalesce(F.col("r.schema") == SCHEMA, F.lit(False)), F.col("r.schema")),
        "version": (~F.coalesce(F.col("r.version") == VERSION, F.lit(False)), F.col("r.version")),
        "record_type": (~F.coalesce(F.col("r.record_type").isin("header", "window", "segment"), F.lit(False)), F.col("r.record_type")),
        "interval": (F.col("r.record_type").isin("window", "segment") & ~F.coalesce((F.col("r.start_s") >= 0) & (F.col("r.end_s") > F.col("r.start_s")), F.lit(False)), F.concat_ws("-", "r.start_s", "r.end_s")),
        "probability": (F.exists(F.coalesce(F.map_values("r.readiness"), F.array().cast("array<double>")), lambda x: (x < 0) | (x > 1)), F.lit(None)),
    }
    records = lines.select("path", "line", "r.*")
    bad = audit.check(lines, "manifest", key, rules)
    return records, bad.unionByName(audit.duplicates(records.where("record_type = 'window'"), "manifest", F.concat_ws(":", "path", "index"), "duplicate_window"))


def warnings(records: DataFrame) -> DataFrame:
    """What does not make a manifest invalid: counts that differ, members without a window, readiness that doesn't sum to 1, late evidence."""
    header = records.where("record_type = 'header'").select("path", "window_count", "segment_count", "duration_s")
    seen = records.groupBy("path").agg(F.count_if(F.col("record_type") == "window").alias("w"), F.count_if(F.col("record_type") == "segment").alias("g"), F.max("end_s").alias("last"))
    both = header.join(seen, "path")
    out = audit.check(both, "manifest", F.col("path"), {"window_count": (F.col("w") != F.col("window_count"), F.col("w")), "segment_count": (F.col("g") != F.col("segment_count"), F.col("g")), "beyond_duration": (F.col("last") > F.col("duration_s") + 0.05, F.col("last"))})
    total = F.aggregate(F.map_values("readiness"), F.lit(0.0), lambda a, x: a + x)
    sums = audit.check(records.where("readiness is not null"), "manifest", F.concat_ws(":", "path", "line"), {"readiness_sum": (F.abs(total - 1) > 0.02, total)})
    return out.unionByName(sums).unionByName(dangling(records))


def dangling(records: DataFrame) -> DataFrame:
    """Members of segments that no window record has."""
    members = records.where("record_type = 'segment'").select("path", F.explode("window_indices").alias("index"))
    lost = members.join(records.where("record_type = 'window'").select("path", "index"), ["path", "index"], "left_anti")
    return lost.select(F.lit("manifest").alias("entity"), F.concat_ws(":", "path", "index").alias("key"), F.lit("dangling_member").alias("rule"), F.lit(None).cast("string").alias("detail"))


def with_decision(records: DataFrame) -> DataFrame:
    """decision: its own, else its route's, else REVIEW."""
    by_route = F.element_at(F.create_map(*[F.lit(x) for kv in ROUTE_DECISION.items() for x in kv]), F.col("route"))
    return records.withColumn("decision", F.coalesce(F.when(F.col("decision").isin(*READINESS), F.col("decision")), by_route, F.lit("REVIEW")))


def summary(records: DataFrame) -> DataFrame:
    """path, record_type, decision, n, seconds (of segments)."""
    return with_decision(records.where("record_type <> 'header'")).groupBy("path", "record_type", "decision").agg(F.count("*").alias("n"), F.sum(F.when(F.col("record_type") == "segment", F.col("end_s") - F.col("start_s"))).alias("seconds"))


def issue_summary(records: DataFrame) -> DataFrame:
    """path, issue, top, mean, reports, samples: of segments where a file has any, else of windows."""
    kinds = records.groupBy("path").agg(F.max(F.col("record_type") == "segment").alias("has"))
    use = records.join(kinds, "path").where(F.col("record_type") == F.when(F.col("has"), "segment").otherwise("window"))
    long = use.select("path", F.coalesce("reported_issues", F.array().cast("array<string>")).alias("r"), F.explode("issues").alias("issue", "p"))
    return long.groupBy("path", "issue").agg(F.max("p").alias("top"), F.avg("p").alias("mean"), F.count_if(F.array_contains("r", F.col("issue"))).alias("reports"), F.count("*").alias("samples"))


def select_segments(records: DataFrame, chosen: DataFrame) -> DataFrame:
    """The segment records whose (path, index) are chosen."""
    return records.where("record_type = 'segment'").join(chosen, ["path", "index"], "left_semi")
