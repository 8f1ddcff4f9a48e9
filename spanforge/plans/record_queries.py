"""Queries of training records, gathers and window audits with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import audit
from ..sources import jsonl
from . import bridge
from .bridge import r6, sql6

#: Licenses that the query admits.
ALLOWED = ("en", "fr")


def _records(spark, sf):
    """A training record for each document: its language is the license, its windows follow from its id and length."""
    d = bridge.read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    i = F.col("doc_id")
    window = lambda k: F.struct(
        F.lit(2.0 * k).alias("start_s"), F.lit(2.0 * k + 2).alias("end_s"),
        F.when((i + k) % 4 < 3, F.element_at(F.array(*map(F.lit, ("KEEP", "REVIEW", "REJECT"))), ((i + k) % 4 + 1).cast("int"))).alias("readiness"),
        F.when(i % 5 == 0, False).alias("readiness_valid"),
        F.create_map(F.lit("blur"), i % 2 == 0, F.lit("exposure"), F.when(i % 3 == 0, (i + k) % 2 == 0)).alias("issues"),
        F.lit(None).cast("map<string,boolean>").alias("issue_valid"),
        F.struct(F.when(i % 2 == 0, 2.0 * k + 0.5).alias("start_s"), F.lit(None).cast("double").alias("end_s")).alias("boundary"),
        F.element_at(F.array(F.lit("true"), F.lit("false"), F.lit('{"start": true}'), F.lit(None).cast("string")), (i % 4 + 1).cast("int")).alias("boundary_valid"),
    )
    return d.select(F.concat(F.lit("r"), i).alias("id"), F.col("source").alias("group_id"), F.lit("v").alias("video"), F.col("lang").alias("license"), F.when(i % 7 == 0, "").otherwise(F.col("source")).alias("source"), F.lit(None).cast("string").alias("dataset"), F.array(window(0), window(1)).alias("windows"))


def flatten_records(spark, sf):
    return jsonl.flatten(_records(spark, sf)).select("example_id", "source", F.col("window_index").cast("long").alias("window_index"), "start_s", "end_s", "readiness", "readiness_valid", "boundary_start", "boundary_start_valid", "boundary_end_valid")


def encode_labels(spark, sf):
    long = jsonl.encode(jsonl.flatten(_records(spark, sf)))
    return long.groupBy("task", "label").agg(F.count("*").alias("n"), F.count_if("valid").alias("known"), F.sum("value").alias("total"))


def license_violations(spark, sf):
    bad = jsonl.allowed_licenses(jsonl.flatten(_records(spark, sf)), list(ALLOWED))
    return bad.groupBy("rule", "detail").agg(F.count("*").alias("n"))


def canonical_rows(spark, sf):
    c = bridge.read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("nation"), F.col("c_mktsegment").alias("Segment"))
    return jsonl.canonical_lines(c, ["c_custkey"])


def duration_texts(spark, sf):
    o = bridge.read(spark, sf, "orders").select((F.col("o_orderkey") % 9000 * 0.5).alias("t"))
    return o.groupBy("t").agg(F.first(exprs.duration_text(F.col("t"))).alias("shown"), F.count("*").alias("n"))


def optional_labels(spark, sf):
    t = F.element_at(F.array(F.lit("  a b "), F.lit(" \t"), F.lit(""), F.lit(None).cast("string"), F.lit("x")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return bridge.read(spark, sf, "orders").select(exprs.optional_label(t).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def repeated_ids(spark, sf):
    e = bridge.read(spark, sf, "events").select((F.col("event_id") % 700).alias("id"))
    return audit.duplicates(e, "event", F.col("id").cast("string"), "repeated_id").groupBy("rule").agg(F.count("*").alias("n"))


def boundary_targets(spark, sf):
    flat = jsonl.flatten(_records(spark, sf))
    return flat.where("boundary_start_valid").groupBy("window_index").agg(F.count("*").alias("n"), r6(F.avg("boundary_start")).alias("mean")).select(F.col("window_index").cast("long").alias("window_index"), "n", "mean")


_FLAT = """fl as (select 'r' || doc_id || ':' || k example_id, coalesce(nullif(case when doc_id % 7 = 0 then '' else source end, ''), lang) source, lang, doc_id, k,
  case (doc_id + k) % 4 when 0 then 'KEEP' when 1 then 'REVIEW' when 2 then 'REJECT' end readiness, case when doc_id % 5 = 0 then false else (doc_id + k) % 4 < 3 end readiness_valid,
  case when doc_id % 2 = 0 then 2.0::double * k + 0.5 end boundary_start,
  case doc_id % 4 when 1 then false else doc_id % 2 = 0 or doc_id % 4 = 2 end boundary_start_valid
  from documents, (select unnest(range(2)) k))"""

_CELLS = f"""with {_FLAT}, cells as (
  select 'readiness' task, 'readiness' label, case readiness when 'KEEP' then 0 when 'REVIEW' then 1 when 'REJECT' then 2 end::double v, readiness_valid ok from fl
  union all select 'issue', 'blur', (doc_id % 2 = 0)::int::double, true from fl
  union all select 'issue', 'exposure', case when doc_id % 3 = 0 then ((doc_id + k) % 2 = 0)::int::double end, doc_id % 3 = 0 from fl
  union all select 'issue', x, null, false from fl, (values ('acting_hand_not_visible'), ('low_hand_activity'), ('camera_instability'), ('scene_cut'), ('duplicate_frames')) t(x)
  union all select 'boundary', 'start', boundary_start, boundary_start_valid from fl
  union all select 'boundary', 'end', null, false from fl)
 select task, label, count(*) n, count(*) filter (ok and v is not null) known, sum(v) filter (ok and v is not null) total from cells group by task, label"""

QUERIES = {
    "flatten_records": (flatten_records, f"with {_FLAT} select example_id, source, k::bigint window_index, 2.0::double * k start_s, 2.0::double * k + 2 end_s, readiness, readiness_valid, boundary_start, boundary_start_valid, false boundary_end_valid from fl"),
    "encode_labels": (encode_labels, _CELLS),
    "license_violations": (license_violations, f"with {_FLAT} select 'license' AS rule, lang detail, count(*) n from fl where lang is null or lang not in {ALLOWED!r} group by lang"),
    "canonical_rows": (canonical_rows, """select c_custkey, '{"Segment":"' || c_mktsegment || '","c_custkey":' || c_custkey || case when c_custkey % 3 > 0 then ',"nation":' || c_nationkey else '' end || '}' "value" from customer"""),
    "duration_texts": (duration_texts, "with t as (select o_orderkey % 9000 * 0.5::double t from orders) select t, case when t >= 3600 then printf('%d:%02d:%04.1f', floor(t / 3600)::int, floor(t / 60)::int % 60, t % 60) else printf('%d:%04.1f', floor(t / 60)::int, t % 60) end shown, count(*) n from t group by t"),
    "optional_labels": (optional_labels, "select case o_orderkey % 5 when 0 then 'a b' when 4 then 'x' end AS label, count(*) n from orders group by 1"),
    "repeated_ids": (repeated_ids, "select 'repeated_id' AS rule, count(*) n from (select event_id % 700 id from events group by 1 having count(*) > 1)"),
    "boundary_targets": (boundary_targets, f"with {_FLAT} select k::bigint window_index, count(*) n, {sql6('avg(boundary_start)')} mean from fl where boundary_start_valid group by k"),
}
