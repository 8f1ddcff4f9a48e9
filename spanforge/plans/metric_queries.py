"""Queries of metrics, calibration, splits and curation with their DuckDB counterparts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..config import SplitSpec
from ..functions import exprs
from ..operators import calibrate, curation, metrics, planning, splits, targets
from . import bridge
from .bridge import r6, sql6

SPLIT = SplitSpec()
SEARCH = SplitSpec(fractions=(0.7, 0.15, 0.15))


def _probabilities(spark, sf):
    p = bridge.predictions(spark, sf)
    k, v, x = metrics.softmax([F.col(f"z{i}") for i in range(3)])
    # Rounded, so that no comparison hangs on the last bit of exp().
    p = p.withColumns({"k": F.floor(k * 1e6 + 0.5) / 1e6, "v": F.floor(v * 1e6 + 0.5) / 1e6, "x": F.floor(x * 1e6 + 0.5) / 1e6})
    best = F.when((F.col("k") >= F.col("v")) & (F.col("k") >= F.col("x")), 0).when(F.col("v") >= F.col("x"), 1).otherwise(2)
    p = p.withColumn("pred", best).withColumn("confidence", F.greatest("k", "v", "x"))
    return p.withColumn("correct", F.when(F.col("y").isNotNull(), F.col("pred") == F.col("y")))


_P = f"""{bridge.PREDICTIONS}, q0 as (select vec_id, grp, source, y, label, floor(k * 1e6 + 0.5) / 1e6 k, floor(v * 1e6 + 0.5) / 1e6 v, floor(x * 1e6 + 0.5) / 1e6 x, z0, z1, z2 from p),
 q as (select *, case when k >= v and k >= x then 0 when v >= x then 1 else 2 end pred, greatest(k, v, x) confidence, case when y is not null then (case when k >= v and k >= x then 0 when v >= x then 1 else 2 end) = y end correct from q0)"""


def softmax_entropy(spark, sf):
    p = bridge.predictions(spark, sf)
    ps = metrics.softmax([F.col(f"z{i}") for i in range(3)], 1.5)
    h = metrics.normalized_entropy(ps)
    return p.select("vec_id", *[r6(x).alias(n) for n, x in zip(("keep", "review", "reject"), ps, strict=True)], r6(h).alias("entropy"), r6(F.greatest(h, ps[1])).alias("uncertainty"))


_SOFT = f"""with e as (select vec_id, embedding[1]::double * 8 z0, embedding[2]::double * 8 z1, embedding[3]::double * 8 z2 from embeddings),
 x as (select vec_id, exp(z0 / 1.5) a, exp(z1 / 1.5) b, exp(z2 / 1.5) c from e), y as (select vec_id, a / (a + b + c) k, b / (a + b + c) v, c / (a + b + c) r from x),
 h as (select *, -(k * ln(k) + v * ln(v) + r * ln(r)) / ln(3) h from y)
 select vec_id, {sql6("k")} keep, {sql6("v")} review, {sql6("r")} reject, {sql6("h")} entropy, {sql6("greatest(h, v)")} uncertainty from h"""


def argmax_decision(spark, sf):
    p = _probabilities(spark, sf)
    return p.select("vec_id", metrics.decision([F.col("k"), F.col("v"), F.col("x")]).alias("decision"))


def confusion(spark, sf):
    c = metrics.confusion(_probabilities(spark, sf), "y", "pred", 3)
    return c.select("true", "pred", "n")


def prf(spark, sf):
    s = metrics.class_scores(metrics.confusion(_probabilities(spark, sf), "y", "pred", 3))
    return s.select("class", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


def prf_by_source(spark, sf):
    s = metrics.macro(metrics.class_scores(metrics.confusion(_probabilities(spark, sf), "y", "pred", 3, ["source"]), ["source"]), ["source"])
    return s.select("source", *[r6(F.col(f"macro_{c}")).alias(c) for c in ("precision", "recall", "f1")])


def _scores_sql(keys: str) -> str:
    g = f"{keys}, " if keys else ""
    return f"""sc as (select {g}c "class", sum((y = c and pred = c)::int) tp, sum((y = c)::int) s, sum((pred = c)::int) m from q, (values (0), (1), (2)) v(c) where y is not null group by {g}c),
 pr as (select {g}"class", tp / nullif(m, 0) "precision", tp / nullif(s, 0) recall, 2 * tp / nullif(s + m, 0) f1, s::bigint support from sc)"""


def auroc_by_issue(spark, sf):
    a = metrics.auroc(bridge.issue_rows(spark, sf), ["issue"], "score", "truth")
    return a.select("issue", r6(F.col("auroc")).alias("auroc"), "positives", "negatives")


def auroc_documents(spark, sf):
    d = bridge.doc_labels(spark, sf)
    long = d.select("score", F.explode(F.array(*[F.struct(F.lit(c).alias("task"), F.col(c).alias("truth")) for c in ("quality", "toxic")])).alias("x")).select("score", "x.*")
    return metrics.auroc(long, ["task"], "score", "truth").select("task", r6(F.col("auroc")).alias("auroc"))


def average_precision(spark, sf):
    a = metrics.average_precision(bridge.issue_rows(spark, sf), ["issue"], "score", "truth")
    return a.select("issue", r6(F.col("average_precision")).alias("average_precision"))


def calibration_bins(spark, sf):
    return metrics.calibration_bins(_probabilities(spark, sf), "confidence", "correct", 15).select("bin", "n", r6(F.col("confidence")).alias("confidence"), r6(F.col("accuracy")).alias("accuracy"))


def ece(spark, sf):
    return metrics.expected_calibration_error(metrics.calibration_bins(_probabilities(spark, sf), "confidence", "correct", 15)).select(r6(F.col("ece")).alias("ece"))


def selective_risk(spark, sf):
    return metrics.selective_risk(_probabilities(spark, sf), "confidence", "correct").select("confidence", r6(F.col("coverage")).alias("coverage"), r6(F.col("risk")).alias("risk"))


def aurc(spark, sf):
    return metrics.area_under_risk(metrics.selective_risk(_probabilities(spark, sf), "confidence", "correct")).select(r6(F.col("aurc")).alias("aurc"))


def _events(spark, sf, kind):
    t = bridge.timed_events(spark, sf).where(F.col("event_type") == kind)
    day = t.groupBy("source_id", F.floor(F.col("s") / 24).alias("d")).agg(F.min("s").alias("t"))
    return day.select("source_id", F.lit("start").alias("boundary"), "t")


def boundary_matches(spark, sf):
    return metrics.event_matches(_events(spark, sf, "signup"), _events(spark, sf, "click"), 6.0).select("source_id", "n_ref", "n_pred", "tp")


def boundary_f1(spark, sf):
    m = metrics.event_matches(_events(spark, sf, "signup"), _events(spark, sf, "click"), 6.0)
    return metrics.event_scores(m, ["boundary"]).select("boundary", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def class_weights(spark, sf):
    return metrics.class_weights(bridge.predictions(spark, sf), "y", 3).select("class", "n", r6(F.col("weight")).alias("weight"))


def positive_weights(spark, sf):
    return metrics.positive_weights(bridge.issue_rows(spark, sf), ["issue"], "truth").select("issue", r6(F.col("weight")).alias("weight"), "positives", "negatives")


def issue_thresholds(spark, sf):
    sweep = calibrate.threshold_sweep(bridge.issue_rows(spark, sf), ["issue"], "score", "truth")
    return calibrate.best_thresholds(sweep, ["issue"]).select("issue", r6(F.col("threshold")).alias("threshold"))


_FIXED = ", ".join(f"({x!r}::double)" for x in sorted({0.05, 0.95, *np.linspace(0.1, 0.9, 17).tolist()}))
_THRESHOLDS = f"""with {bridge.ISSUE_ROWS}, kn as (select * from ir where truth is not null), cand as (select distinct issue, score t from kn union select distinct issue, f from kn, (values {_FIXED}) v(f)),
 f1 as (select c.issue, c.t, coalesce(2 * sum((truth and score >= t)::int) / nullif(sum((score >= t)::int) + sum(truth::int), 0), 0) f, sum(truth::int) pos, count(*) n from cand c join kn on c.issue = kn.issue group by c.issue, c.t)
 select issue, {sql6("case when pos = 0 or pos = n then 0.5 else t end")} threshold from f1 qualify row_number() over (partition by issue order by f desc, abs(t - 0.5), t desc) = 1"""


def routing_grid(spark, sf):
    p = _probabilities(spark, sf)
    h = metrics.normalized_entropy([F.col(c) / (F.col("k") + F.col("v") + F.col("x")) for c in "kvx"])
    rows = p.withColumn("h", F.floor(h * 1e6 + 0.5) / 1e6)
    return calibrate.routing_grid(rows, "k", "v", "h", "y").select(r6(F.col("uncertainty")).alias("uncertainty"), r6(F.col("enter")).alias("enter"), r6(F.col("macro_f1")).alias("macro_f1"))


_CELLS = ", ".join(f"({float(u)!r}::double, {float(e)!r}::double)" for u in np.linspace(0.35, 0.85, 11) for e in np.linspace(0.35, 0.9, 12))
_ROUTING = f"""with {_P}, hh as (select y, k, v, k / (k + v + x) a, v / (k + v + x) b, x / (k + v + x) c from q where y is not null),
 h2 as (select y, k, greatest(v, floor((-((case when a > 0 then a * ln(a) else 0 end) + (case when b > 0 then b * ln(b) else 0 end) + (case when c > 0 then c * ln(c) else 0 end)) / ln(3)) * 1e6 + 0.5) / 1e6) w from hh),
 cell as (select u, en, y, case when w >= u then 1 when k >= en then 0 else 2 end p from h2, (values {_CELLS}) g(u, en)),
 cs as (select u, en, c, 2 * sum((y = c and p = c)::int) / nullif(sum((y = c)::int) + sum((p = c)::int), 0) f from cell, (values (0), (1), (2)) v(c) group by u, en, c)
 select {sql6("u")} uncertainty, {sql6("en")} enter, {sql6("coalesce(avg(f), 0)")} macro_f1 from cs group by u, en"""


def temperature(spark, sf):
    return spark.createDataFrame([(calibrate.fit_temperature(bridge.predictions(spark, sf), ["z0", "z1", "z2"], "y"),)], "temperature double")


def _examples(spark, sf):
    o = bridge.read(spark, sf, "orders")
    return o.select("o_orderkey", F.col("o_custkey").alias("grp"), F.col("o_orderpriority").alias("source"), (F.col("o_orderkey") % 3).alias("label"), (F.col("o_orderkey") % 2 == 0).alias("issue"))


def group_split(spark, sf):
    return splits.group_assignments(_examples(spark, sf), "grp", SPLIT)


_SPLIT = f"""g as (select distinct o_custkey grp from orders where o_custkey is not null), h as (select grp, row_number() over (order by sha256(encode('{SPLIT.seed}') || '\\x00'::blob || encode(grp::varchar)), grp) r, count(*) over () n from g),
 c as (select n, floor(n * 0.8) a, floor(n * 0.1) b, floor(n * 0.1) d, n * 0.8 - floor(n * 0.8) ra, n * 0.1 - floor(n * 0.1) rb from (select max(n) n from h)),
 al as (select a + case when left_ >= 1 and ra >= rb then 1 when left_ >= 3 then 1 else 0 end a, left_, b, ra, rb from (select *, n - a - b - d left_ from c)),
 sp as (select grp, r, n from h)"""


def group_split_counts(spark, sf):
    a = splits.group_assignments(_examples(spark, sf), "grp", SPLIT)
    return _examples(spark, sf).join(a, F.col("grp") == F.col("group")).groupBy("split").agg(F.countDistinct("group").alias("groups"), F.count("*").alias("examples"))


def split_leakage(spark, sf):
    rows = bridge.read(spark, sf, "documents").select("source", F.when(F.col("doc_id") % 7 == 0, "test").otherwise("train").alias("split"))
    return splits.leaked_groups(rows, "source", "split")


def split_support(spark, sf):
    e = _examples(spark, sf).withColumn("split", F.when(F.col("grp") % 10 == 0, "test").otherwise("train"))
    return splits.support(e, "split", "grp", "label", "issue")


def seed_search(spark, sf):
    d = bridge.doc_labels(spark, sf).select(F.col("source").alias("grp"), (F.col("doc_id") % 3).alias("label"), F.col("toxic").alias("issue"))
    return splits.first_supported_seed(d, "grp", "label", "issue", SEARCH, least=1)


def event_conflicts(spark, sf):
    return curation.conflicts(bridge.read(spark, sf, "events").select("user_id", "event_type"), "user_id", ["event_type"])


def coverage_missing(spark, sf):
    o = bridge.read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return curation.missing(bridge.read(spark, sf, "customer").select("c_custkey"), o, "c_custkey")


def coverage_extra(spark, sf):
    l = bridge.read(spark, sf, "labels").select("doc_id")
    return curation.missing(bridge.read(spark, sf, "documents").select("doc_id"), l, "doc_id")


def build_counters(spark, sf):
    return curation.counters(bridge.read(spark, sf, "documents").select("lang", "source"), ["lang", "source"])


def dataset_table(spark, sf):
    return bridge.read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


def visibility_proxy(spark, sf):
    o = bridge.read(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 4 == 0, " Hand not visible ").when(F.col("o_orderkey") % 4 == 1, "LEFT hand").when(F.col("o_orderkey") % 4 == 2, "both hands")
    return o.select(curation.visibility(text).alias("hidden")).where("hidden is not null").groupBy("hidden").agg(F.count("*").alias("n"))


def transform_plan_skips(spark, sf):
    s = bridge.read(spark, sf, "orders").select(F.col("o_orderkey").alias("source_id"), ((F.col("o_orderkey") % 40) / 10.0).alias("duration"), F.lit(5.0).alias("fps"), (F.col("o_orderkey") % 3 == 0).alias("has_boxes"), (F.col("o_orderkey") % 5 == 0).alias("positive"), F.lit("human").alias("issue_kind"))
    return curation.transform_plan(s).groupBy("transform", F.coalesce("skip", F.lit("planned")).alias("code")).agg(F.count("*").alias("n"))


_T = ", ".join(f"('{t}', {str(f).lower()})" for t, _, f in curation.TRANSFORMS)
_SKIPS = f"""with s as (select o_orderkey % 40 / 10.0::double d, o_orderkey % 3 = 0 boxes, o_orderkey % 5 = 0 pos, transform, faithful from orders, (values {_T}) t(transform, faithful)),
 f as (select *, greatest(1, floor(d * 5.0 + 1e-9))::int fr from s), z as (select *, greatest(1, floor(fr * 0.35::double))::int a, least(fr - 1, ceil(fr * 0.68::double)::int - 1) b, greatest(2, round_even(fr * 0.16::double, 0)::int) gap from f)
 select transform, case when faithful and not pos then 'source_positive_required' when transform = 'camera_instability' and d < 0.5 then 'window_too_short' when transform = 'freeze' and (fr < 6 or b <= a) then 'window_too_short'
  when transform = 'scene_cut' and (fr < 10 or (fr - gap) // 2 < 3) then 'window_too_short' when transform = 'hand_occlusion' and not boxes then 'hand_regions_missing' else 'planned' end code, count(*) n from z group by all"""


def box_union(spark, sf):
    e = bridge.read(spark, sf, "embeddings")
    at = lambda i: F.abs(F.element_at("embedding", i).cast("double"))
    b = e.select(F.col("label").alias("source_id"), at(1).alias("x0"), at(2).alias("y0"), (at(1) + at(3)).alias("x1"), (at(2) + at(4)).alias("y1"))
    return curation.box_union(b, 0.02).select("source_id", *[r6(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def boundary_raster(spark, sf):
    from .segment_queries import grid

    g = grid(spark, sf).withColumns({"times": planning.sample_times(F.col("s"), F.col("e"), 6, "center"), "start_s": F.col("s") + F.col("source_id") % 9, "end_s": F.col("e") - 1, "start_valid": F.lit(True), "end_valid": F.col("window_index") % 2 == 0})
    r = targets.rasterize(g, 3.0)
    return r.groupBy("source_id", "boundary").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("ones"), F.sum(F.when(F.col("valid"), 1).otherwise(0)).alias("cells"), F.count("*").alias("frames"))


def _raster_sql():
    from .segment_queries import _GRID

    return f"""with {_GRID}, c as (select source_id, window_index, s, e, 'start' boundary, s + source_id % 9 t from g union all select source_id, window_index, s, e, 'end', case when window_index % 2 = 0 then e - 1 end from g),
 f as (select *, abs(s + (j + 0.5) * (e - s) / 6 - t) d, j from c, (select unnest(range(6)) j)), m as (select *, min(d) over (partition by source_id, window_index, boundary) md from f),
 k as (select *, coalesce(md <= 3 + 1e-9, false) ok, row_number() over (partition by source_id, window_index, boundary order by round(d, 9), j) r from m)
 select source_id, boundary, coalesce(sum(case when ok then (r = 1)::int end), 0)::bigint ones, sum(ok::int)::bigint cells, count(*) frames from k group by source_id, boundary"""


def contrastive_loss(spark, sf):
    e = bridge.read(spark, sf, "embeddings").withColumn("batch", F.expr("vec_id div 16"))
    shifted = F.transform("embedding", lambda x: x * 0.5)
    return targets.contrastive_loss(e.withColumn("other", shifted), "batch", "vec_id", "label", "embedding", "other", 0.1).select("batch", (F.floor(F.col("loss") * 1e4 + 0.5) / 1e4).alias("loss"))


_CONTRASTIVE = """with e as (select vec_id, vec_id // 16 batch, label, [x::double for x in embedding] a, [(x * 0.5::float)::double for x in embedding] b from embeddings),
 z as (select l.batch, l.vec_id i, r.vec_id j, list_dot_product(l.a, r.b) / 0.1 z from e l join e r on l.batch = r.batch and (l.vec_id = r.vec_id or l.label <> r.label)),
 x as (select batch, ln(sum(exp(z))) - max(case when i = j then z end) x from z group by batch, i union all select batch, ln(sum(exp(z))) - max(case when i = j then z end) from z group by batch, j)
 select batch, floor(case when count(*) > 2 then avg(x) else 0 end * 1e4 + 0.5) / 1e4 loss from x group by batch"""


def masked_bce(spark, sf):
    r = bridge.issue_rows(spark, sf).withColumn("logit", (F.col("score") - 0.5) * 8)
    return r.groupBy("issue").agg(targets.masked_bce(F.col("logit"), F.col("truth"), 2.0).alias("loss")).select("issue", r6(F.col("loss")).alias("loss"))


def parse_rate(spark, sf):
    o = bridge.read(spark, sf, "orders").select("o_orderkey")
    text = F.element_at(F.array(*map(F.lit, ("30000/1001", "25", "0/0", "N/A", "24/0", "-5", "29.97", "60/1"))), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return o.select(text.alias("text")).groupBy("text").agg(r6(F.first(exprs.parse_rate(F.col("text")))).alias("rate"), F.count("*").alias("n"))


def rotation_display(spark, sf):
    o = bridge.read(spark, sf, "orders").select("o_orderkey")
    tag = F.element_at(F.array(*map(F.lit, ("90", "-90", "n/a", "450", "180", ""))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    side = F.when(F.col("o_orderkey") % 5 == 0, F.lit(270.0))
    turned = exprs.rotation(tag, side)
    w, h = exprs.display_size(F.lit(1920), F.lit(1080), turned)
    return o.select(turned.alias("rotation"), w.alias("w"), h.alias("h")).groupBy("rotation", "w", "h").agg(F.count("*").alias("n"))


def clock_parse(spark, sf):
    o = bridge.read(spark, sf, "orders").select("o_orderkey")
    k = F.col("o_orderkey") % 90
    text = F.format_string("%02d:%02d:%02d.5", F.expr("o_orderkey % 3"), k, k)
    return o.select(text.alias("text")).groupBy("text").agg(F.first(exprs.clock_seconds(F.col("text"))).alias("seconds"), F.count("*").alias("n"))


def path_validate(spark, sf):
    p = bridge.read(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://[^/]+(/.*)", 1).alias("p"))
    return p.select("page_id", exprs.safe_path(F.expr("case when page_id % 3 = 0 then p when page_id % 3 = 1 then substr(p, 2) else concat('a/../', p) end")).alias("ok")).groupBy("ok").agg(F.count("*").alias("n"))


def uniform_indices(spark, sf):
    n = spark.range(1, 40).select(F.col("id").alias("n"))
    return n.select("n", F.array_join(F.transform(planning.uniform_indices(F.col("n"), 8), lambda x: x.cast("string")), ",").alias("picked"))


def learning_rate(spark, sf):
    return spark.range(0, 100).select(F.col("id").alias("step"), r6(exprs.learning_rate(F.col("id"), 100, 10, 1.0)).alias("rate"))


def issue_summary(spark, sf):
    r = bridge.issue_rows(spark, sf)
    return r.groupBy("issue").agg(F.max("score").alias("top"), r6(F.avg("score")).alias("mean"), F.sum(F.when(F.col("score") >= 0.6, 1).otherwise(0)).alias("reports"), F.count("*").alias("samples"))


def reported_issues(spark, sf):
    r = bridge.issue_rows(spark, sf).where(F.col("score") >= 0.6).groupBy("vec_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("issue")), lambda x: x.cast("string")), ",").alias("reported"))
    return r


def window_violations(spark, sf):
    from ..operators import audit

    w = bridge.window_scores(spark, sf).withColumns({"e": F.when(F.col("idx") % 17 == 0, F.col("s")).otherwise(F.col("e")), "score": F.when(F.col("idx") % 11 == 0, F.col("score") + 1).otherwise(F.col("score"))})
    return audit.window_scores(w).groupBy("rule").agg(F.count("*").alias("n"))


def best_boundary_frame(spark, sf):
    e = bridge.read(spark, sf, "embeddings")
    p = F.transform(F.slice("embedding", 1, 12), lambda x: F.floor((x.cast("double") + 1) * 10 + 0.5) / 20)
    return e.select("vec_id", F.coalesce(targets.best_frame(p, 0.6).cast("long"), F.lit(-1)).alias("frame"))


def duration_text(spark, sf):
    o = bridge.read(spark, sf, "orders").select(F.floor("o_totalprice").cast("double").alias("x"))
    return o.groupBy(exprs.duration_text(F.col("x") / 10).alias("text")).agg(F.count("*").alias("n"))


def local_paths(spark, sf):
    o = bridge.read(spark, sf, "orders").select("o_orderkey", F.to_json(F.struct(F.lit("a/b").alias("ok"), F.array(F.struct(F.when(F.col("o_orderkey") % 3 == 0, F.lit("/abs/x")).when(F.col("o_orderkey") % 3 == 1, F.lit("~/x")).otherwise(F.lit("rel/x")).alias("p"))).alias("deep"))).alias("doc"))
    bad = F.exists(exprs.json_strings(F.col("doc")), lambda x: exprs.local_path(x))
    return o.groupBy(bad.alias("local")).agg(F.count("*").alias("n"))


def recompute_audit(spark, sf):
    from ..operators import audit

    o = bridge.read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("v"))
    stated = o.withColumn("v", F.when(F.col("o_custkey") % 50 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return audit.recomputed(stated, o, "o_custkey", "v", "metric").select("key", "rule")


def release_audit(spark, sf):
    from . import adapters

    e = _examples(spark, sf)
    split = e.select(F.col("o_orderkey").alias("id"), F.col("grp").alias("group_id"), F.when(F.col("grp") % 10 == 0, "test").when(F.col("grp") % 10 == 1, "validation").otherwise("train").alias("split"))
    p = split.where("split = 'test' and id % 7 <> 0").select("id", "group_id", F.when(F.col("id") % 2 == 0, "human").otherwise("unlabeled").alias("readiness_kind"), (F.col("id") % 4 == 0).alias("readiness_valid"), F.lit("human").alias("issue_kind"), F.lit(True).alias("issue_valid"), F.lit(None).cast("string").alias("boundary_kind"), F.lit(False).alias("boundary_valid"), (F.col("id") % 5).alias("review_count"), F.lit("r").alias("rubric"))
    return adapters.release_violations(split, p).groupBy("rule").agg(F.count("*").alias("n"))


QUERIES = {
    "best_boundary_frame": (best_boundary_frame, "with p as (select vec_id, [floor((x::double + 1) * 10 + 0.5) / 20 for x in embedding[1:12]] p from embeddings) select vec_id, case when list_max(p) >= 0.6::double then list_position(p, list_max(p)) - 1 else -1 end::bigint frame from p"),
    "duration_text": (duration_text, "with t as (select floor(o_totalprice)::bigint t from orders) select case when t >= 36000 then printf('%d:%02d:%02d.%d', t // 36000, t // 600 % 60, t % 600 // 10, t % 10) else printf('%d:%02d.%d', t // 600, t % 600 // 10, t % 10) end \"text\", count(*) n from t group by 1"),
    "local_paths": (local_paths, "select o_orderkey % 3 < 2 \"local\", count(*) n from orders group by 1"),
    "recompute_audit": (recompute_audit, "select distinct o_custkey::varchar key, 'recompute' rule from orders where o_custkey % 50 = 0"),
    "release_audit": (release_audit, "select 'missing' rule, count(*) n from orders where o_custkey % 10 = 0 and o_orderkey % 7 = 0 union all select 'review', count(*) from orders where o_custkey % 10 = 0 and o_orderkey % 7 <> 0 and o_orderkey % 2 = 0 and o_orderkey % 5 < 2"),
    "softmax_entropy": (softmax_entropy, _SOFT),
    "argmax_decision": (argmax_decision, f"with {_P} select vec_id, ['KEEP', 'REVIEW', 'REJECT'][pred + 1] decision from q"),
    "confusion": (confusion, f"with {_P}, d as (select * from (values (0), (1), (2)) a(t), (values (0), (1), (2)) b(p)) select t \"true\", p pred, count(q.vec_id) n from d left join q on q.y = t and q.pred = p group by t, p"),
    "prf": (prf, f"with {_P}, {_scores_sql('')} select \"class\", {sql6(chr(34) + 'precision' + chr(34))} \"precision\", {sql6('recall')} recall, {sql6('f1')} f1, support from pr"),
    "prf_by_source": (prf_by_source, f"with {_P}, {_scores_sql('source')} select source, {sql6('avg(' + chr(34) + 'precision' + chr(34) + ')')} \"precision\", {sql6('avg(recall)')} recall, {sql6('avg(f1)')} f1 from pr group by source"),
    "auroc_by_issue": (auroc_by_issue, f"""with {bridge.ISSUE_ROWS}, k as (select * from ir where truth is not null), a as (select p.issue, sum(case when p.score > n.score then 1 when p.score = n.score then 0.5 else 0 end) / count(*) a from k p join k n on p.issue = n.issue and p.truth and not n.truth group by p.issue),
 c as (select issue, sum(truth::int)::bigint positives, sum((not truth)::int)::bigint negatives from k group by issue) select issue, {sql6('a')} auroc, positives, negatives from c left join a using (issue)"""),
    "auroc_documents": (auroc_documents, f"""with {bridge.DOC_LABELS}, k as (select 'quality' task, score, quality truth from dl where quality is not null union all select 'toxic', score, toxic from dl where toxic is not null)
 select p.task, {sql6("sum(case when p.score > n.score then 1 when p.score = n.score then 0.5 else 0 end) / count(*)")} auroc from k p join k n on p.task = n.task and p.truth and not n.truth group by p.task"""),
    "average_precision": (average_precision, f"""with {bridge.ISSUE_ROWS}, k as (select * from ir where truth is not null), c as (select p.issue, p.vec_id, sum(case when n.score >= p.score then n.truth::int end) / sum((n.score >= p.score)::int) pr from k p join k n on p.issue = n.issue where p.truth group by p.issue, p.vec_id)
 select issue, {sql6('avg(pr)')} average_precision from c group by issue"""),
    "calibration_bins": (calibration_bins, f"with {_P} select least(floor(confidence * 15), 14)::int bin, count(*) n, {sql6('avg(confidence)')} confidence, {sql6('avg(correct::int)')} accuracy from q where correct is not null group by 1"),
    "ece": (ece, f"with {_P}, b as (select count(*) n, abs(avg(confidence) - avg(correct::int)) g from q where correct is not null group by least(floor(confidence * 15), 14)) select {sql6('sum(n * g) / sum(n)')} ece from b"),
    "selective_risk": (selective_risk, f"with {_P}, k as (select * from q where correct is not null), d as (select distinct confidence c from k) select c confidence, {sql6('count(*) / (select count(*) from k)')} coverage, {sql6('sum((not correct)::int) / count(*)')} risk from d join k on k.confidence >= c group by c"),
    "aurc": (aurc, f"with {_P}, k as (select * from q where correct is not null), r as (select a.vec_id, avg((not b.correct)::int) risk from k a join k b on b.confidence >= a.confidence group by a.vec_id) select {sql6('avg(risk)')} aurc from r"),
    "boundary_matches": (boundary_matches, None),
    "boundary_f1": (boundary_f1, None),
    "class_weights": (class_weights, "with y as (select label % 3 c from embeddings where vec_id % 7 <> 0), n as (select c, count(*) n from y group by c) select c \"class\", n, " + sql6("(1.0::double / n) / ((select sum(1.0::double / n) from n) / 3)") + " weight from n"),
    "positive_weights": (positive_weights, f"with {bridge.ISSUE_ROWS}, k as (select issue, sum(truth::int)::bigint p, sum((not truth)::int)::bigint n from ir where truth is not null group by issue) select issue, {sql6('least(20.0::double, greatest(0.25::double, n / nullif(p, 0)))')} weight, p positives, n negatives from k"),
    "issue_thresholds": (issue_thresholds, _THRESHOLDS),
    "routing_grid": (routing_grid, _ROUTING),
    "temperature": (temperature, None),
    "group_split": (group_split, "with g as (select distinct o_custkey grp from orders where o_custkey is not null), h as (select grp, row_number() over (order by sha256(encode('17') || '\\x00'::blob || encode(grp::varchar)), grp) r, count(*) over () n from g), c as (select n, (n * 8) // 10 a, n // 10 b from (select max(n) n from h)), k as (select a + case when n % 10 in (0) then 0 when (n * 8) % 10 > 0 and (n * 8) % 10 >= n % 10 then 1 when n - a - 2 * b >= 3 then 1 else 0 end a, b, n, n - a - 2 * b rest, (n * 8) % 10 fa, n % 10 fb from c) select grp \"group\", case when r <= k.a then 'train' when r <= k.a + k.b + case when rest - (k.a - (k.n * 8) // 10) >= 1 then 1 else 0 end then 'validation' else 'test' end split from h, k"),
    "group_split_counts": (group_split_counts, None),
    "split_leakage": (split_leakage, "select source, count(distinct doc_id % 7 = 0) n_splits from documents group by source having count(distinct doc_id % 7 = 0) > 1"),
    "split_support": (split_support, "select case when o_custkey % 10 = 0 then 'test' else 'train' end split, count(distinct o_custkey) \"groups\", count(*) examples, count(*) filter (o_orderkey % 3 = 0) class_0, count(*) filter (o_orderkey % 3 = 1) class_1, count(*) filter (o_orderkey % 3 = 2) class_2, count(*) filter (o_orderkey % 2 = 0) positives, count(*) filter (o_orderkey % 2 <> 0) negatives from orders group by 1"),
    "seed_search": (seed_search, """with d as (select source grp, doc_id % 3 label, toxic = 1 issue from documents left join labels using (doc_id) where source is not null), per as (select grp, sum((label = 0)::int) c0, sum((label = 1)::int) c1, sum((label = 2)::int) c2, coalesce(sum(issue::int), 0) pos, coalesce(sum((not issue)::int), 0) neg from d group by grp),
 r as (select seed, per.*, row_number() over (partition by seed order by sha256(encode(seed::varchar) || '\\x00'::blob || encode(grp)), grp) r from per, (select unnest(range(64)) seed)),
 s as (select seed, case when r <= 14 then 0 when r <= 17 then 1 else 2 end split, count(*) g, sum(c0) c0, sum(c1) c1, sum(c2) c2, sum(pos) p, sum(neg) n from r group by 1, 2)
 select min(seed) seed from (select seed from s group by seed having bool_and(least(g, c0, c1, c2, p, n) >= 1) and count(*) = 3)"""),
    "event_conflicts": (event_conflicts, "select user_id, count(*) n, count(distinct event_type) variants from events group by user_id having count(distinct event_type) > 1"),
    "coverage_missing": (coverage_missing, "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_orderstatus = 'F')"),
    "coverage_extra": (coverage_extra, "select doc_id from documents except select doc_id from labels"),
    "build_counters": (build_counters, "select 'lang' field, lang \"value\", count(*) n from documents group by lang union all select 'source', source, count(*) from documents group by source"),
    "dataset_table": (dataset_table, "select source, lang, count(*) n from documents group by source, lang"),
    "visibility_proxy": (visibility_proxy, "select o_orderkey % 4 = 0 hidden, count(*) n from orders where o_orderkey % 4 < 2 group by 1"),
    "transform_plan_skips": (transform_plan_skips, _SKIPS),
    "box_union": (box_union, "with b as (select label source_id, abs(embedding[1]::double) x0, abs(embedding[2]::double) y0, abs(embedding[3]::double) w, abs(embedding[4]::double) h from embeddings) select source_id, " + ", ".join([sql6("greatest(0.0::double, min(x0) - 0.02::double)") + " x0", sql6("greatest(0.0::double, min(y0) - 0.02::double)") + " y0", sql6("least(1.0::double, max(x0 + w) + 0.02::double)") + " x1", sql6("least(1.0::double, max(y0 + h) + 0.02::double)") + " y1"]) + " from b group by source_id"),
    "boundary_raster": (boundary_raster, _raster_sql()),
    "contrastive_loss": (contrastive_loss, _CONTRASTIVE),
    "masked_bce": (masked_bce, f"with {bridge.ISSUE_ROWS}, l as (select issue, (score - 0.5::double) * 8 z, truth from ir where truth is not null) select issue, {sql6('avg(case when truth then 2.0::double * ln(1 + exp(-z)) else ln(1 + exp(z)) end)')} loss from l group by issue"),
    "parse_rate": (parse_rate, "with t as (select ['30000/1001', '25', '0/0', 'N/A', '24/0', '-5', '29.97', '60/1'][o_orderkey % 8 + 1] \"text\" from orders) select \"text\", floor((case \"text\" when '30000/1001' then 30000 / 1001::double when '25' then 25 when '29.97' then 29.97::double when '60/1' then 60 end) * 1e6 + 0.5) / 1e6 rate, count(*) n from t group by \"text\""),
    "rotation_display": (rotation_display, "with t as (select ['90', '-90', 'n/a', '450', '180', ''][o_orderkey % 6 + 1] x, case when o_orderkey % 5 = 0 then 270.0::double end s from orders), r as (select ((coalesce(try_cast(nullif(x, '') as double), s, 0) % 360) + 360) % 360 rotation from t) select rotation, case when rotation in (90, 270) then 1080 else 1920 end w, case when rotation in (90, 270) then 1920 else 1080 end h, count(*) n from r group by all"),
    "clock_parse": (clock_parse, "with t as (select o_orderkey % 3 h, o_orderkey % 90 k from orders) select printf('%02d:%02d:%02d.5', h, k, k) \"text\", case when k < 60 then h * 3600 + k * 60 + k + 0.5::double end \"seconds\", count(*) n from t group by all"),
    "path_validate": (path_validate, "with p as (select page_id, regexp_extract(url, '://[^/]+(/.*)', 1) p from pages) select case page_id % 3 when 1 then p not like '%?%' and p not like '%#%' else false end ok, count(*) n from p group by 1"),
    "uniform_indices": (uniform_indices, "select n, case when n <= 8 then array_to_string(range(n), ',') else array_to_string([round_even(i * ((n - 1) / 7.0::double), 0)::bigint for i in range(8)], ',') end picked from (select unnest(range(1, 40)) n)"),
    "learning_rate": (learning_rate, f"select s step, {sql6('case when s < 10 then (s + 1) / 10.0::double else (100 - s) / 90.0::double end')} rate from (select unnest(range(100)) s)"),
    "issue_summary": (issue_summary, f"with {bridge.ISSUE_ROWS} select issue, max(score) top, {sql6('avg(score)')} mean, sum((score >= 0.6::double)::int)::bigint reports, count(*) samples from ir group by issue"),
    "reported_issues": (reported_issues, f"with {bridge.ISSUE_ROWS} select vec_id, string_agg(issue::varchar, ',' order by issue) reported from ir where score >= 0.6::double group by vec_id"),
    "window_violations": (window_violations, f"with {bridge.SCORES} select 'interval' rule, count(*) n from w where idx % 17 = 0 union all select 'score_range', count(*) from w where idx % 11 = 0 and score > 0"),
}
