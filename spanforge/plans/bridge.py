"""The driver's tables as domain tables, in DataFrames and, for the oracle, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(x: Column) -> Column:
    """To six decimals by double arithmetic that both engines share."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def sql6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    w = Window.partitionBy("user_id")
    idx = F.row_number().over(w.orderBy("us", "event_id")) - 1
    return ev.select("event_id", F.col("user_id").alias("source_id"), idx.alias("idx"), ((F.col("us") - F.min("us").over(w)) / 3.6e9).alias("s"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


TIMED = """t as (select event_id, user_id source_id, row_number() over (partition by user_id order by epoch_us(ts), event_id) - 1 idx,
  (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 3.6e9 s, event_type, value, json_extract_string(props, '$.k')::int k from events)"""


def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timed_events(spark, sf_dir)
    return t.select("source_id", "idx", "s", (F.col("s") + 12).alias("e"), (F.col("value") / (F.col("value") + 20)).alias("score"), (F.col("k") / 150.0).alias("u"))


SCORES = TIMED + ", w as (select source_id, idx, s, s + 12 e, value / (value + 20) score, k / 150.0::double u from t)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timed_events(spark, sf_dir).groupBy("source_id").agg((F.ceil(F.max("s")) + 12).cast("double").alias("duration"))
    return t.withColumn("start_time", (F.col("source_id") % 5).cast("double"))


SOURCES = TIMED + ", src as (select source_id, (ceil(max(s)) + 12)::double duration, (source_id % 5)::double start_time from t group by source_id)"


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timed_events(spark, sf_dir).where("event_type in ('click', 'purchase')")
    return t.select("source_id", "event_id", F.col("s").alias("a"), (F.col("s") + 1 + F.col("value") / 50).alias("b"))


ACTIONS = SOURCES + ", act as (select source_id, event_id, s a, s + 1 + value / 50 b from t where event_type in ('click', 'purchase'))"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timed_events(spark, sf_dir)
    return t.select("source_id", F.col("idx").alias("frame"), (F.col("idx") * 0.5).alias("timestamp_s"), "event_type", F.expr("k div 25").alias("hand"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, source, grp, y (null where unknown), z0..z2, probabilities k v x, issue long columns."""
    e = read(spark, sf_dir, "embeddings")
    z = [(F.element_at("embedding", i + 1).cast("double") * 8).alias(f"z{i}") for i in range(3)]
    return e.select("vec_id", F.col("label").alias("grp"), (F.col("vec_id") % 4).alias("source"), F.when(F.col("vec_id") % 7 != 0, F.col("label") % 3).alias("y"), "label", *z, "embedding")


PREDICTIONS = """e as (select vec_id, label grp, vec_id % 4 source, case when vec_id % 7 <> 0 then label % 3 end y, label, embedding[1]::double * 8 z0, embedding[2]::double * 8 z1, embedding[3]::double * 8 z2, embedding from embeddings),
 p0 as (select *, exp(z0 - greatest(z0, z1, z2)) a0, exp(z1 - greatest(z0, z1, z2)) a1, exp(z2 - greatest(z0, z1, z2)) a2 from e),
 p as (select *, a0 / (a0 + a1 + a2) k, a1 / (a0 + a1 + a2) v, a2 / (a0 + a1 + a2) x from p0)"""


def issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, issue (0..6), score (to 4 decimals, so that ties occur), truth (null where unknown)."""
    e = read(spark, sf_dir, "embeddings")
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("issue"), F.element_at("embedding", i + 4).cast("double").alias("v"), (F.shiftright("label", i % 3) % 2 == 1).alias("truth")) for i in range(7)]))
    x = e.select("vec_id", one.alias("x")).select("vec_id", "x.*")
    score = F.floor((F.col("v") + 1) * 200 + 0.5) / 400
    return x.select("vec_id", "issue", score.alias("score"), F.when((F.col("vec_id") + F.col("issue")) % 7 != 0, F.col("truth")).alias("truth"))


ISSUE_ROWS = """ir as (select vec_id, i issue, floor((embedding[i + 4]::double + 1) * 200 + 0.5) / 400 score,
  case when (vec_id + i) % 7 <> 0 then (label >> (i % 3)) % 2 = 1 end truth from embeddings, (select unnest(range(7))::int i))"""


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score in (0, 1), quality and toxic as booleans (null: unknown)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") / (F.col("n_chars") + 1000)).alias("score"))
    l = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic"))
    return d.join(l, "doc_id", "left")


DOC_LABELS = "dl as (select doc_id, source, n_chars / (n_chars + 1000)::double score, quality = 1 quality, toxic = 1 toxic from documents left join labels using (doc_id))"
