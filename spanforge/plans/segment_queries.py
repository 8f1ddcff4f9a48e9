"""Queries of the temporal algebra with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AdapterSpec, CompilerPolicy, PlanSpec
from ..functions import exprs
from ..operators import compiler, curation, intervals, planning
from ..operators.islands import even_cap, interval_union
from . import bridge
from .bridge import r6, sql6

POLICY = CompilerPolicy(gap=3.0, min_duration=16.0)
PLAN = PlanSpec(window=48.0, stride=24.0, frames=6)
GRID = AdapterSpec(window=48.0, stride=24.0, keep_occupancy=0.1)


# Oracle text ---------------------------------------------------------------

def _routed(p: CompilerPolicy) -> str:
    return f"""{bridge.SCORES},
 f as (select *, coalesce(last_value(case when score >= {p.enter} then true when score < {p.exit} then false end ignore nulls) over (partition by source_id order by s, e, idx rows between unbounded preceding and current row), false) active from w),
 rt as (select *, case when (score > {p.exit} and score < {p.enter}) or u >= {p.uncertainty} then '{p.uncertain_route}' when active then 'keep' else 'discard' end route,
  case when (score > {p.exit} and score < {p.enter}) or u >= {p.uncertainty} then 'uncertain' when active then 'hysteresis' else 'below_threshold' end reason from f)"""


def _islands(name: str, of: str, keys: str, gap: float, order: str) -> str:
    return f"""{name} as (select *, sum(fresh) over (partition by {keys} order by {order} rows unbounded preceding) island from
  (select *, case when s > max(e) over (partition by {keys} order by {order} rows between unbounded preceding and 1 preceding) + {gap} then 1 else 0 end fresh from {of}))"""


def _merged(p: CompilerPolicy) -> str:
    return f"""{_routed(p)},
 {_islands("i1", "rt", "source_id, route, reason", p.gap, "s, e, idx")},
 s1 as (select source_id, route, reason, island i1, min(s) s, max(e) e, count(*) n, sum(score) total from i1 group by all),
 {_islands("i2", "s1", "source_id, route", p.gap, "s, e, reason")},
 s2 as (select source_id, route, island i2, case when min(reason) = max(reason) then min(reason) else 'merged' end reason, min(s) s, max(e) e, sum(n) n from i2 group by source_id, route, island),
 mem as (select i1.source_id, i1.route, i2.island i2, i1.idx, i1.s, i1.e, i1.score from i1 join i2 on i1.source_id = i2.source_id and i1.route = i2.route and i1.reason = i2.reason and i1.island = i2.i1)"""


def _parts(p: CompilerPolicy) -> str:
    return f"""{_merged(p)},
 pts as (select distinct source_id, s t from s2 union select distinct source_id, e from s2),
 atoms as (select * from (select source_id, t s, lead(t) over (partition by source_id order by t) e from pts) where e is not null),
 cov as (select a.source_id, a.s, a.e, s2.route, s2.reason, s2.i2, row_number() over (partition by a.source_id, a.s order by case s2.route when 'review' then 0 when 'keep' then 1 else 2 end) r
  from atoms a join s2 on a.source_id = s2.source_id and s2.s <= a.s and s2.e >= a.e),
 won as (select * from cov where r = 1),
 sup as (select won.source_id, won.s, won.e, won.route, won.reason, mem.idx, mem.s ms, mem.e me, mem.score, mem.s < won.e and mem.e > won.s hit from won join mem on won.source_id = mem.source_id and won.route = mem.route and won.i2 = mem.i2),
 part as (select * from (select *, bool_or(hit) over (partition by source_id, s) anyhit from sup) where hit or not anyhit)"""


def _coalesced(name: str, parts: str, members: str) -> str:
    """parts: source_id, s, e, route, reason; members: source_id, s (of the part), idx, ms, me, score."""
    return f"""{name}_r as (select *, sum(fresh) over (partition by source_id order by s rows unbounded preceding) run from (select *, case when lag(route) over (partition by source_id order by s) = route
   and abs(lag(e) over (partition by source_id order by s) - s) <= 1e-9 then 0 else 1 end fresh from {parts})),
 {name} as (select source_id, run, any_value(route) route, case when min(reason) = max(reason) then min(reason) else 'merged' end reason, min(s) s, max(e) e from {name}_r group by source_id, run),
 {name}_m as (select distinct r.source_id, g.s, m.idx, m.ms, m.me, m.score from {name}_r r join {name} g on r.source_id = g.source_id and r.run = g.run join {members} m on m.source_id = r.source_id and m.s = r.s)"""


def _compiled(p: CompilerPolicy) -> str:
    return f"""with {_parts(p)},
 pa as (select distinct source_id, s, e, route, reason from part),
 pm as (select source_id, s, idx, ms, me, score from part),
 {_coalesced("c1", "pa", "pm")},
 sh as (select source_id, s, e, case when route = 'keep' and e - s < {p.min_duration} then '{p.short_route}' else route end route, case when route = 'keep' and e - s < {p.min_duration} then 'short' else reason end reason from c1),
 {_coalesced("c2", "sh", "c1_m")},
 st as (select source_id, s, avg(score) mean_score, min(score) min_score, max(score) max_score, count(*) n_windows, string_agg(idx::varchar, ',' order by ms, me, idx) members from c2_m group by source_id, s),
 done as (select c2.source_id, row_number() over (partition by c2.source_id order by c2.s, c2.e, route) - 1 segment_index, route, reason, c2.s, c2.e, mean_score, min_score, max_score, n_windows, members
  from c2 join st on c2.source_id = st.source_id and c2.s = st.s {"" if p.include_discard else "where route <> 'discard'"})"""


def _segment_sql(p: CompilerPolicy) -> str:
    return f"""{_compiled(p)} select source_id, segment_index::int segment_index, route, reason, {sql6("s")} s, {sql6("e")} e, {sql6("mean_score")} mean_score, {sql6("min_score")} min_score, {sql6("max_score")} max_score, n_windows, members from done"""


_GRID = f"""{bridge.ACTIONS},
 gw as (select source_id, unnest(range(case when duration > {GRID.window} + 1e-12 then floor((duration - {GRID.window} + 1e-12) / {GRID.stride})::int + 1 else 1 end)) i, duration from src),
 g0 as (select source_id, i window_index, i * {GRID.stride}::double s, least(duration, i * {GRID.stride}::double + {GRID.window}) e, duration from gw),
 tl as (select source_id, max(window_index) + 1 window_index, max(duration) - {GRID.window} s, max(duration) e, max(duration) duration from g0 group by source_id
   having max(duration) > {GRID.window} + 1e-12 and max(e) < max(duration) - 1e-12 and abs(max(duration) - {GRID.window} - max(s)) > 1e-12),
 g as (select *, false tail from g0 union all select *, true from tl),
 ua as (select *, sum(fresh) over (partition by source_id order by a, b rows unbounded preceding) blk from (select *, case when a > max(b) over (partition by source_id order by a, b rows between unbounded preceding and 1 preceding) then 1 else 0 end fresh from act)),
 un as (select source_id, blk, min(a) a, max(b) b, count(*) n from ua group by source_id, blk),
 oc as (select g.source_id, g.window_index, g.s, g.e, coalesce(sum(case when a is not null then least(b, e) - greatest(a, s) end), 0) / (max(g.e) - max(g.s)) occupancy from g left join un on g.source_id = un.source_id and a < e and b > s group by g.source_id, g.window_index, g.s, g.e)"""


def grid(spark, sf):
    return planning.sliding_windows(bridge.sources(spark, sf), PlanSpec(window=GRID.window, stride=GRID.stride)).select("source_id", "window_index", "s", "e")


# Queries ---------------------------------------------------------------------

def window_scores(spark, sf):
    return bridge.window_scores(spark, sf).select("source_id", "idx", r6(F.col("s")).alias("s"), r6(F.col("score")).alias("score"), r6(F.col("u")).alias("u"))


def hysteresis(spark, sf):
    return compiler.route_windows(bridge.window_scores(spark, sf), POLICY).select("source_id", "idx", "active")


def route_windows(spark, sf):
    return compiler.route_windows(bridge.window_scores(spark, sf), POLICY).select("source_id", "idx", "route", "reason")


def _merged_windows(spark, sf):
    return compiler.merge_windows(compiler.route_windows(bridge.window_scores(spark, sf), POLICY), POLICY.gap)


def gap_islands(spark, sf):
    return _merged_windows(spark, sf).select("source_id", "route", "reason", r6(F.col("s")).alias("s"), r6(F.col("e")).alias("e"), F.size("members").cast("long").alias("n"))


def merge_same_route(spark, sf):
    return compiler.merge_segments(_merged_windows(spark, sf), POLICY.gap).select("source_id", "route", "reason", r6(F.col("s")).alias("s"), r6(F.col("e")).alias("e"), F.size("members").cast("long").alias("n"))


def weighted_merge(spark, sf):
    segments = compiler.with_stats(_merged_windows(spark, sf)).select("source_id", "route", "s", "e", F.col("mean_score").alias("mean"), F.size("members").alias("n"))
    return compiler.weighted_merge(segments, POLICY.gap).select("source_id", "route", r6(F.col("s")).alias("s"), r6(F.col("mean")).alias("mean"), F.col("n").cast("long").alias("n"))


def atoms(spark, sf):
    return compiler.atoms(compiler.merge_segments(_merged_windows(spark, sf), POLICY.gap)).select("source_id", r6(F.col("s")).alias("s"), r6(F.col("e")).alias("e"))


def exclusive_partition(spark, sf):
    parts = compiler.exclusive_partition(compiler.merge_segments(_merged_windows(spark, sf), POLICY.gap))
    return parts.select("source_id", r6(F.col("s")).alias("s"), r6(F.col("e")).alias("e"), "route", "reason", F.size("members").cast("long").alias("n"))


def _segments(policy):
    def query(spark, sf):
        d = compiler.compile_segments(bridge.window_scores(spark, sf), policy)
        members = F.array_join(F.transform("window_indices", lambda i: i.cast("string")), ",")
        return d.select("source_id", "segment_index", "route", "reason", *[r6(F.col(c)).alias(c) for c in ("s", "e", "mean_score", "min_score", "max_score")], F.size("window_indices").cast("long").alias("n_windows"), members.alias("members"))

    return query


def segment_members(spark, sf):
    d = compiler.compile_segments(bridge.window_scores(spark, sf), POLICY)
    return d.select("source_id", "segment_index", F.explode("window_indices").alias("idx"))


def decision_counts(spark, sf):
    routed = compiler.route_windows(bridge.window_scores(spark, sf), POLICY).groupBy("route").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([("keep", "KEEP"), ("review", "REVIEW"), ("discard", "REJECT")], "route string, decision string")
    return names.join(routed, "route", "left").select("decision", F.coalesce("n", F.lit(0)).alias("n"))


def routed_seconds(spark, sf):
    d = compiler.compile_segments(bridge.window_scores(spark, sf), POLICY)
    return d.groupBy("route").agg(F.count("*").alias("segments"), (F.floor(F.sum(F.col("e") - F.col("s")) * 1e3 + 0.5) / 1e3).alias("seconds"))


def segment_ids(spark, sf):
    d = bridge.window_scores(spark, sf).select("source_id", F.floor("s").alias("s"))
    one = d.groupBy("source_id").agg(F.max("s").cast("double").alias("e"))
    return one.select("source_id", exprs.segment_id(F.col("source_id"), "model@1", F.lit(0.0), F.col("e"), F.lit("keep")).alias("segment_id"))


def window_plan(spark, sf):
    return planning.sliding_windows(bridge.sources(spark, sf), PlanSpec(window=GRID.window, stride=GRID.stride)).select("source_id", F.col("window_index").cast("long").alias("window_index"), "s", "e", "tail")


def _sample_times(strategy, count):
    def query(spark, sf):
        g = grid(spark, sf)
        t = planning.sample_times(F.col("s"), F.col("e"), count, strategy)
        return g.select("source_id", F.col("window_index").cast("long").alias("window_index"), F.posexplode(t).alias("pos", "t")).select("source_id", "window_index", F.col("pos").cast("long").alias("pos"), r6(F.col("t")).alias("t"))

    return query


def _sample_sql(expression, count):
    return f"with {_GRID} select source_id, window_index, j pos, {sql6(expression)} t from g, (select unnest(range({count})) j)"


def unique_samples(spark, sf):
    samples, refs = planning.plan_samples(bridge.sources(spark, sf), PLAN)
    a = samples.groupBy("source_id").agg(F.count("*").alias("n_unique"), r6(F.max("source_timestamp_s")).alias("last"))
    return a.join(refs.groupBy("source_id").agg(F.count("*").alias("n_refs")), "source_id")


def interval_blocks(spark, sf):
    u = interval_union(bridge.actions(spark, sf), ["source_id"], "a", "b", ["event_id"])
    return u.select("source_id", r6(F.col("a")).alias("a"), r6(F.col("b")).alias("b"), "n")


def _occupied(spark, sf):
    return intervals.occupancy(grid(spark, sf), bridge.actions(spark, sf).select("source_id", "a", "b"), bucket=GRID.window)


def occupancy_windows(spark, sf):
    o = _occupied(spark, sf).withColumn("kind", intervals.occupancy_class(GRID.keep_occupancy))
    return o.select("source_id", F.col("window_index").cast("long").alias("window_index"), r6(F.col("occupancy")).alias("occupancy"), "kind")


def occupancy_boundaries(spark, sf):
    b = intervals.window_boundaries(grid(spark, sf), bridge.actions(spark, sf).select("source_id", "a", "b"))
    return b.select("source_id", F.col("window_index").cast("long").alias("window_index"), r6(F.col("first_start")).alias("first_start"), r6(F.col("last_end")).alias("last_end"), "start_valid", "end_valid")


def capped_windows(spark, sf):
    o = _occupied(spark, sf).withColumn("kind", intervals.occupancy_class(GRID.keep_occupancy))
    return even_cap(o, ["source_id", "kind"], ["s", "e", "window_index"], 5).select("source_id", "kind", F.col("window_index").cast("long").alias("window_index"))


def top_control(spark, sf):
    o = _occupied(spark, sf).withColumn("kind", intervals.occupancy_class(GRID.keep_occupancy)).withColumn("occupancy", r6(F.col("occupancy")))
    return curation.top_control(o).select("source_id", F.col("window_index").cast("long").alias("window_index"), "occupancy")


def low_activity_proxy(spark, sf):
    o = _occupied(spark, sf).withColumn("kind", intervals.occupancy_class(GRID.keep_occupancy))
    return o.groupBy(F.coalesce(curation.low_activity(F.col("kind"), F.col("occupancy")).cast("string"), F.lit("unknown")).alias("issue")).agg(F.count("*").alias("n"))


def nearest_window(spark, sf):
    points = bridge.actions(spark, sf).groupBy("source_id").agg(F.max("a").alias("t"))
    return intervals.nearest_window(points, grid(spark, sf)).select("source_id", F.col("window_index").cast("long").alias("window_index"))


def frame_spans(spark, sf):
    f = intervals.frame_spans(bridge.frames(spark, sf), 2.0, ["event_type", "hand"])
    return f.select("source_id", F.col("span").cast("long").alias("span"), "event_type", F.col("hand").cast("long").alias("hand"), r6(F.col("s")).alias("s"), r6(F.col("e")).alias("e"))


_KIND = f"case when occupancy >= {GRID.keep_occupancy} then 'KEEP' when occupancy > 0 then 'REVIEW' else 'REJECT' end"
_REVIEWED = CompilerPolicy(gap=3.0, min_duration=16.0, short_route="review")
_ALL = CompilerPolicy(gap=3.0, min_duration=16.0, include_discard=True)

QUERIES = {
    "window_scores": (window_scores, f"with {bridge.SCORES} select source_id, idx::int idx, {sql6('s')} s, {sql6('score')} score, {sql6('u')} u from w"),
    "hysteresis": (hysteresis, f"with {_routed(POLICY)} select source_id, idx::int idx, active from rt"),
    "route_windows": (route_windows, f"with {_routed(POLICY)} select source_id, idx::int idx, route, reason from rt"),
    "gap_islands": (gap_islands, f"with {_merged(POLICY)} select source_id, route, reason, {sql6('s')} s, {sql6('e')} e, n from s1"),
    "merge_same_route": (merge_same_route, f"with {_merged(POLICY)} select source_id, route, reason, {sql6('s')} s, {sql6('e')} e, n::bigint n from s2"),
    "weighted_merge": (weighted_merge, f"with {_merged(POLICY)}, {_islands('i3', 's1', 'source_id, route', POLICY.gap, 's, e')} select source_id, route, {sql6('min(s)')} s, {sql6('sum(total) / sum(n)')} mean, sum(n)::bigint n from i3 group by source_id, route, island"),
    "atoms": (atoms, f"with {_parts(POLICY)} select source_id, {sql6('s')} s, {sql6('e')} e from atoms"),
    "exclusive_partition": (exclusive_partition, f"with {_parts(POLICY)} select source_id, {sql6('s')} s, {sql6('e')} e, route, reason, count(*) n from part group by part.source_id, part.s, part.e, route, reason"),
    "compile_segments": (_segments(POLICY), _segment_sql(POLICY)),
    "compile_with_discard": (_segments(_ALL), _segment_sql(_ALL)),
    "short_to_review": (_segments(_REVIEWED), _segment_sql(_REVIEWED)),
    "segment_members": (segment_members, f"{_compiled(POLICY)} select d.source_id, segment_index::int segment_index, idx::int idx from done d join c2_m m on d.source_id = m.source_id and d.s = m.s"),
    "decision_counts": (decision_counts, f"with {_routed(POLICY)} select decision, count(rt.route) n from (values ('keep', 'KEEP'), ('review', 'REVIEW'), ('discard', 'REJECT')) v(route, decision) left join rt using (route) group by decision"),
    "routed_seconds": (routed_seconds, f"{_compiled(POLICY)} select route, count(*) segments, floor(sum(e - s) * 1e3 + 0.5) / 1e3 AS seconds from done group by route"),
    "segment_ids": (segment_ids, f"with {bridge.SCORES}, m as (select source_id, max(floor(s)) e from w group by source_id) select source_id, sha256(encode(source_id::varchar) || '\\x00'::blob || encode('model@1') || '\\x00'::blob || encode('0.000000000') || '\\x00'::blob || encode(printf('%.9f', e)) || '\\x00'::blob || encode('keep')) segment_id from m"),
    "window_plan": (window_plan, f"with {_GRID} select source_id, window_index::bigint window_index, s, e, tail from g"),
    "sample_times_center": (_sample_times("center", 6), _sample_sql("s + (j + 0.5) * (e - s) / 6", 6)),
    "sample_times_start": (_sample_times("start", 4), _sample_sql("s + j::double * (e - s) / 4", 4)),
    "sample_times_inclusive": (_sample_times("inclusive", 5), _sample_sql("s + j::double * (e - s) / 4", 5)),
    "unique_samples": (unique_samples, f"with {_GRID}, x as (select source_id, round(s + (j + 0.5) * (e - s) / 6, 9) t from g, (select unnest(range(6)) j)) select x.source_id, count(distinct t) n_unique, {sql6('max(t) + max(start_time)')} \"last\", count(*) n_refs from x join src using (source_id) group by x.source_id"),
    "interval_union": (interval_blocks, f"with {_GRID} select source_id, {sql6('a')} a, {sql6('b')} b, n from un"),
    "occupancy_windows": (occupancy_windows, f"with {_GRID} select source_id, window_index::bigint window_index, {sql6('occupancy')} occupancy, {_KIND} kind from oc"),
    "occupancy_boundaries": (occupancy_boundaries, f"with {_GRID}, b as (select g.source_id, g.window_index, min(case when a between s and e then a end) x, max(case when b between s and e then b end) y from g left join act on g.source_id = act.source_id group by all) select source_id, window_index::bigint window_index, {sql6('x')} first_start, {sql6('y')} last_end, x is not null and coalesce(y >= x, true) start_valid, y is not null and coalesce(y >= x, true) end_valid from b"),
    "even_cap": (capped_windows, f"with {_GRID}, k as (select *, {_KIND} kind from oc), r as (select *, row_number() over (partition by source_id, kind order by s, e, window_index) - 1 i, count(*) over (partition by source_id, kind) n from k) select source_id, kind, window_index::bigint window_index from r where n <= 5 or list_contains([(n - 1) * q // 4 for q in range(5)], i)"),
    "top_control": (top_control, f"with {_GRID}, k as (select source_id, window_index, s, {sql6('occupancy')} o, {_KIND} kind from oc) select source_id, window_index::bigint window_index, o occupancy from k where kind = 'KEEP' qualify row_number() over (partition by source_id order by o desc, s, window_index) = 1"),
    "low_activity_proxy": (low_activity_proxy, f"with {_GRID}, k as (select occupancy, {_KIND} kind from oc) select case when kind = 'KEEP' then 'false' when kind = 'REJECT' and occupancy = 0 then 'true' else 'unknown' end issue, count(*) n from k group by 1"),
    "nearest_window": (nearest_window, f"with {_GRID}, pt as (select source_id, max(a) t from act group by source_id) select source_id, window_index::bigint window_index from pt join g using (source_id) qualify row_number() over (partition by source_id order by abs((s + e) / 2 - t), s, window_index) = 1"),
    "frame_spans": (frame_spans, f"""with {bridge.TIMED}, fr as (select source_id, idx, idx * 0.5 ts, event_type, k // 25 hand from t),
 ch as (select *, sum(c) over (partition by source_id order by idx rows unbounded preceding) span from (select *, case when lag(idx) over w is not null and lag(event_type) over w is not distinct from event_type and lag(hand) over w is not distinct from hand then 0 else 1 end c from fr window w as (partition by source_id order by idx))),
 sp as (select source_id, span, any_value(event_type) event_type, any_value(hand) hand, min(ts) s, max(ts) z from ch group by source_id, span),
 en as (select *, coalesce(lead(s) over (partition by source_id order by span), z) e0 from sp)
 select source_id, span::bigint span, event_type, hand::bigint hand, {sql6('s')} s, {sql6('case when e0 <= s then s + 0.5 else e0 end')} e from en"""),
}
