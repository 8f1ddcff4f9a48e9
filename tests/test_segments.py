"""Segments against stated values and against a plain state machine."""

import random

import pytest

from spanforge.config import CompilerPolicy, PlanSpec, resolve_scan
from spanforge.operators import compiler, islands, planning

SCHEMA = "source_id long, idx int, s double, e double, score double, u double"


def windows(spark, scores, step=2.0, unsure=None):
    return spark.createDataFrame([(1, i, i * step, (i + 1) * step, x, unsure) for i, x in enumerate(scores)], SCHEMA)


def compiled(df, policy):
    rows = compiler.compile_segments(df, policy).orderBy("source_id", "segment_index").collect()
    return [(r["route"], r["s"], r["e"], r["window_indices"]) for r in rows]


def test_hysteresis(spark):
    df = windows(spark, [0.1, 0.71, 0.6, 0.5, 0.49, 0.69, 0.7])
    got = [r["active"] for r in compiler.route_windows(df, CompilerPolicy()).orderBy("idx").collect()]
    assert got == [False, True, True, True, False, False, True]


def test_gap_bridges_a_contradicting_window(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.0, 0.9, None), (1, 1, 1.0, 2.0, 0.1, None), (1, 2, 2.5, 3.5, 0.9, None)], SCHEMA)
    assert compiled(df, CompilerPolicy(gap=1.5, min_duration=0)) == [("keep", 0.0, 3.5, [0, 2])]


def test_overlap_precedence(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 10.0, 0.9, None), (1, 1, 2.0, 8.0, 0.6, None)], SCHEMA)
    assert compiled(df, CompilerPolicy(gap=0, min_duration=0)) == [("keep", 0.0, 2.0, [0]), ("review", 2.0, 8.0, [1]), ("keep", 8.0, 10.0, [0])]


def test_short_segments(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.5, 0.9, None)], SCHEMA)
    assert compiled(df, CompilerPolicy()) == []
    assert compiled(df, CompilerPolicy(short_route="review")) == [("review", 0.0, 0.5, [0])]


def test_weighted_merge(spark):
    df = spark.createDataFrame([(1, "keep", 0.0, 2.0, 0.8, 2), (1, "keep", 2.0, 3.0, 0.5, 1)], "source_id long, route string, s double, e double, mean double, n int")
    r = compiler.weighted_merge(df, 0.0).first()
    assert (round(r["mean"], 9), r["n"]) == (0.7, 3)


def model(rows, p):
    """One source's segments by plain loops, as routes of elementary intervals."""
    rows = sorted(rows, key=lambda r: (r[2], r[3], r[1]))
    active, routed = False, []
    for _, i, s, e, x, u in rows:
        active = x >= p.enter or (active and x >= p.exit)
        unsure = p.exit < x < p.enter or (u is not None and p.uncertainty is not None and u >= p.uncertainty)
        routed.append((p.uncertain_route if unsure else "keep" if active else "discard", s, e, i))
    spans = []
    for route in {r[0] for r in routed}:
        blocks = []
        for _, s, e, _ in sorted((r for r in routed if r[0] == route), key=lambda r: r[1:]):
            if blocks and s <= blocks[-1][1] + p.gap:
                blocks[-1][1] = max(blocks[-1][1], e)
            else:
                blocks.append([s, e])
        spans += [(route, a, b) for a, b in blocks]
    times = sorted({t for _, a, b in spans for t in (a, b)})
    out = []
    for a, b in zip(times, times[1:], strict=False):
        over = [r for r in ("review", "keep", "discard") if any(x == r and s <= a and e >= b for x, s, e in spans)]
        if over and out and out[-1][0] == over[0] and out[-1][2] == a:
            out[-1][2] = b
        elif over:
            out.append([over[0], a, b])
    return [tuple(x) for x in out]


def test_against_plain_loops(spark):
    rng = random.Random(5)
    rows = []
    for source in range(60):
        for i in range(rng.randint(1, 25)):
            s = rng.randint(0, 30) / 2
            rows.append((source, i, s, s + rng.choice([0.5, 1.0, 2.0, 4.0]), rng.choice([0.2, 0.49, 0.5, 0.6, 0.69, 0.7, 0.9]), rng.choice([None, 0.1, 0.5, 0.9])))
    p = CompilerPolicy(gap=0.5, min_duration=0, include_discard=True)
    want = {k: model([r for r in rows if r[0] == k], p) for k in range(60)}
    rng.shuffle(rows)
    got = {}
    for r in compiler.compile_segments(spark.createDataFrame(rows, SCHEMA).repartition(7), p).orderBy("source_id", "segment_index").collect():
        got.setdefault(r["source_id"], []).append((r["route"], r["s"], r["e"]))
    assert got == want


@pytest.mark.parametrize(("duration", "want"), [(10.0, [(0, 4), (3, 7), (6, 10)]), (11.0, [(0, 4), (3, 7), (6, 10), (7, 11)]), (2.0, [(0, 2)])])
def test_sliding_windows(spark, duration, want):
    src = spark.createDataFrame([(1, duration)], "source_id long, duration double")
    got = [(r["s"], r["e"]) for r in planning.sliding_windows(src, PlanSpec(window=4, stride=3)).orderBy("window_index").collect()]
    assert got == want


def test_unique_samples(spark):
    src = spark.createDataFrame([(1, 8.0, 2.5)], "source_id long, duration double, start_time double")
    samples, refs = planning.plan_samples(src, PlanSpec(window=4, stride=1, frames=4))
    assert (samples.count(), refs.count()) == (8, 20)
    assert samples.orderBy("sample_index").first()["source_timestamp_s"] == 3.0


@pytest.mark.parametrize("cap", [1, 2, 3, 7])
def test_even_cap(spark, cap):
    for n in (1, 2, 5, 20):
        df = spark.range(n).selectExpr("1 as k", "id")
        got = [r["id"] for r in islands.even_cap(df, ["k"], ["id"], cap).orderBy("id").collect()]
        want = list(range(n)) if n <= cap else [(n - 1) // 2] if cap == 1 else sorted({i * (n - 1) // (cap - 1) for i in range(cap)})
        assert got == want


def test_settings():
    assert resolve_scan({"issue_thresholds": 0.5}, {"temperature": 2.0})["temperature"] == 2.0
    assert set(resolve_scan({"issue_thresholds": 0.5}, {})["issue_thresholds"].values()) == {0.5}
    with pytest.raises(ValueError, match="thresholds"):
        CompilerPolicy(enter=0.4, exit=0.5)
