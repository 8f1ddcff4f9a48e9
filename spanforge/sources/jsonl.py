"""Training records as JSON lines: schema'd reading, flattening, canonical writing."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import audit

#: Record schema names are namespace/version; the namespace is a setting.
DEFAULT_NAMESPACE = "spanforge.training/v1"

WINDOW = "start_s double, end_s double, readiness string, readiness_valid boolean, issues map<string,boolean>, issue_valid map<string,boolean>, boundary struct<start_s:double,end_s:double>, boundary_valid string, extra string"
RECORD = f"schema string, id string, group_id string, video string, license string, source string, dataset string, windows array<struct<{', '.join(x.replace(' ', ':', 1) for x in WINDOW.split(', '))}>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1), value of every non-blank line. A file is one task: its lines need their numbers."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\n", -1).alias("lines"))
    lines = whole.select("path", F.posexplode("lines").alias("line", "value"))
    return lines.where("trim(value) <> ''").select("path", (F.col("line") + 1).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def parse_records(lines: DataFrame, namespace: str = DEFAULT_NAMESPACE) -> tuple[DataFrame, DataFrame]:
    """Records, and violations: bad JSON, missing fields, foreign schema, duplicate ids."""
    parsed = lines.withColumn("r", F.from_json("value", RECORD, {"mode": "PERMISSIVE"}))
    key = F.concat_ws(":", "path", "line")
    rules = {
        "json": (F.try_parse_json("value").isNull() | ~F.startswith(F.ltrim("value"), F.lit("{")), F.lit("not an object")),
        "schema": (F.col("r.schema").isNull() | (F.col("r.schema") != namespace), F.col("r.schema")),
        "missing_field": (F.col("r.id").isNull() | F.col("r.group_id").isNull() | F.col("r.video").isNull() | F.col("r.license").isNull() | F.col("r.windows").isNull(), F.lit("id, group_id, video, license, windows")),
    }
    bad = audit.check(parsed, "record", key, rules)
    records = parsed.select("path", "line", "r.*")
    twice = records.where("id is not null").groupBy("id").agg(F.min("line").alias("line"), F.count("*").alias("n")).where("n > 1")
    again = twice.select(F.lit("record").alias("entity"), F.col("id").alias("key"), F.lit("duplicate_id").alias("rule"), F.concat(F.lit("first on line "), F.col("line").cast("string")).alias("detail"))
    return records, bad.unionByName(again)


def boundary_flags(text: Column, boundary: Column) -> tuple[Column, Column]:
    """Validity of start and end from a scalar, a map, or nothing (then: whether the value is there)."""
    as_map = F.from_json(text, "map<string,boolean>")
    scalar = F.lower(F.trim(text))
    one = lambda k: F.when(text.isNull(), boundary[f"{k}_s"].isNotNull()).when(scalar == "true", boundary[f"{k}_s"].isNotNull()).when(scalar == "false", False).otherwise(F.coalesce(F.element_at(as_map, F.lit(k)), F.lit(False)))
    return one("start"), one("end")


def flatten(records: DataFrame) -> DataFrame:
    """One row per window, example_id = id:index; missing validity flags mean that the value is there."""
    rows = records.select("id", "group_id", "video", "license", F.coalesce(F.nullif("source", F.lit("")), F.nullif("dataset", F.lit("")), F.col("license")).alias("source"), F.posexplode("windows").alias("window_index", "w"))
    start, end = boundary_flags(F.col("w.boundary_valid"), F.col("w.boundary"))
    flags = F.coalesce(F.col("w.issue_valid"), F.transform_values(F.col("w.issues"), lambda _, v: v.isNotNull()))
    return rows.select(
        F.concat_ws(":", "id", "window_index").alias("example_id"), "id", "group_id", "video", "license", "source", "window_index",
        "w.start_s", "w.end_s", "w.readiness", F.coalesce("w.readiness_valid", F.col("w.readiness").isNotNull()).alias("readiness_valid"),
        "w.issues", flags.alias("issue_valid"),
        F.col("w.boundary.start_s").alias("boundary_start"), F.col("w.boundary.end_s").alias("boundary_end"), start.alias("boundary_start_valid"), end.alias("boundary_end_valid"),
    )


def encode(flat: DataFrame) -> DataFrame:
    """Long form of all labels: example_id, task, label, value (null where not valid), valid."""
    from ..config import ISSUES, READINESS

    one = lambda task, label, value, ok: F.struct(F.lit(task).alias("task"), F.lit(label).alias("label"), value.cast("double").alias("v"), F.coalesce(ok, F.lit(False)).alias("ok"))
    rank = F.coalesce(*[F.when(F.col("readiness") == r, F.lit(i)) for i, r in enumerate(READINESS)])
    cells = [one("readiness", "readiness", rank, F.col("readiness_valid"))]
    cells += [one("issue", k, F.element_at("issues", F.lit(k)).cast("int"), F.element_at("issue_valid", F.lit(k))) for k in ISSUES]
    cells += [one("boundary", k, F.col(f"boundary_{k}"), F.col(f"boundary_{k}_valid")) for k in ("start", "end")]
    long = flat.select("example_id", F.explode(F.array(*cells)).alias("c")).select("example_id", "c.*")
    valid = F.col("ok") & F.col("v").isNotNull()
    return long.select("example_id", "task", "label", F.when(valid, F.col("v")).alias("value"), valid.alias("valid"))


def allowed_licenses(flat: DataFrame, allowed: list[str]) -> DataFrame:
    """Violations: windows whose license is not exactly one of those allowed."""
    return audit.check(flat, "training_window", F.col("example_id"), {"license": (~F.coalesce(F.col("license").isin(*allowed), F.lit(False)), F.col("license"))})


def canonical(value: object) -> str:
    """JSON with sorted keys and no blanks; NaN and infinities are errors."""

    def plain(x: object) -> object:
        if isinstance(x, float) and not math.isfinite(x):
            raise ValueError("not a finite number")
        if hasattr(x, "asDict"):
            return {k: plain(v) for k, v in x.asDict().items() if v is not None}
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items() if v is not None}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return x.item() if hasattr(x, "item") else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), allow_nan=False)


def canonical_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """order columns and value: each row as canonical JSON, without its nulls; a number that is not finite fails the job.

    Python's float text differs from Spark's, so this runs over Arrow batches;
    values keep their types, whatever else is in a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [canonical(x) for x in batch.column(len(order)).to_pylist(maps_as_pydicts="strict")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=[*order, "value"])

    whole = rows.select(*order, F.struct(*rows.columns).alias("__row"))
    return whole.mapInArrow(run, StructType([*whole.schema.fields[:-1], StructField("value", StringType())]))


def canonical_text(text: Column) -> Column:
    """A JSON text in canonical form; null stays null."""

    @F.pandas_udf("string")
    def again(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else canonical(json.loads(t)))

    return again(text)


def write_lines(rows: DataFrame, path: str, order: list[str]) -> None:
    """Range-partitioned by order and sorted, so part files concatenate to one ordered file; never overwrites."""
    lines = canonical_lines(rows, order)
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("errorifexists").text(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """rows (id, split, ...) as data/{split}, each sorted by id."""
    rows.repartition("split").sortWithinPartitions("split", "id").write.mode("errorifexists").partitionBy("split").json(path)


def with_line_rank(lines: DataFrame) -> DataFrame:
    """lines with n, the count of non-blank lines before each in its file."""
    return lines.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1)
