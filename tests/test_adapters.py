from spanforge.config import AdapterSpec, SplitSpec
from spanforge.plans import adapters


def test_occupancy_adapter(spark):
    acts = spark.createDataFrame([(1, 0.0, 9.0), (1, 8.0, 12.0), (1, 20.0, 21.0)], "source_id long, a double, b double")
    v = spark.createDataFrame([(1, 30.0), (2, 10.0)], "source_id long, duration double")
    rows, bad = adapters.occupancy_windows(v, acts, AdapterSpec())
    kinds = [r["kind"] for r in rows.where("source_id = 1").orderBy("window_index").collect()]
    assert kinds == ["KEEP"] * 4 + ["REJECT", "REVIEW", "REVIEW", "REJECT", "REJECT"]
    assert {(r["key"], r["rule"]) for r in bad.collect()} == {("2", "no_action")}
    few, _ = adapters.occupancy_windows(v, acts, AdapterSpec(caps=(1, 1, 1)))
    assert few.where("source_id = 1").groupBy("kind").count().where("count > 1").count() == 0


def test_episodes(spark):
    ep = spark.createDataFrame([(0, 4, 0.0, 2.0), (1, 3, 2.0, 3.5)], "episode_index long, length int, offset_s double, until_s double")
    fr = [(0, i, i * 0.5, "a" if i < 2 else "b") for i in range(4)] + [(1, i, i * 0.5, "c") for i in range(3)]
    kind = "episode_index long, frame_index int, timestamp double, task string"
    spans, bad = adapters.episode_windows(ep, spark.createDataFrame(fr, kind), ["task"], 2.0)
    assert [(r["s"], r["e"]) for r in spans.orderBy("source_id", "span").collect()] == [(0.0, 1.0), (1.0, 2.0), (2.0, 3.5)]
    assert bad.count() == 0
    _, bad = adapters.episode_windows(ep, spark.createDataFrame(fr[:3] + fr[5:], kind), ["task"], 2.0)
    assert {r["rule"] for r in bad.collect()} == {"length", "contiguous"}


def test_corpus_and_seed(spark):
    w = spark.createDataFrame([(s, i, i * 3.0, i * 3.0 + 6, k, {"KEEP": 0.9, "REVIEW": 0.2, "REJECT": 0.0}[k]) for s in range(12) for i, k in enumerate(["KEEP", "REVIEW", "REJECT"])], "source_id long, window_index int, s double, e double, kind string, occupancy double")
    ev = spark.createDataFrame([(s, k, k + 1.0, t) for s in range(12) for k, t in enumerate( ("Hand not visible", "left hand", "other"))], "source_id long, s int, e double, text string")
    c = adapters.corpus(w, ev)
    n = {(r["task"], r["label"]): r["count"] for r in c.groupBy("task", "label").count().collect()}
    assert n["readiness", "KEEP"] == 12 and n["issue", "acting_hand_not_visible"] == 24 and n["issue", "blur"] == 12
    rows = w.selectExpr("source_id as grp", "window_index % 3 as label", "window_index = 0 as issue")
    seed, split = adapters.split_corpus(rows, "grp", "label", "issue", SplitSpec(fractions=(0.5, 0.25, 0.25)), 3)
    assert seed == 0 and split.count() == 12


def test_release(spark):
    s = spark.createDataFrame([("a", "g1", "train"), ("b", "g1", "test"), ("c", "g2", "test"), ("d", "g3", "nowhere")], "id string, group_id string, split string")
    p = spark.createDataFrame([("b", "g1", "human", True, "unlabeled", False, "unlabeled", False, 1, "r"), ("x", "g9", "human", True, "human", True, None, False, 2, "r")], "id string, group_id string, readiness_kind string, readiness_valid boolean, issue_kind string, issue_valid boolean, boundary_kind string, boundary_valid boolean, review_count int, rubric string")
    got = {(r["key"], r["rule"]) for r in adapters.release_violations(s, p).collect()}
    assert got == {("g1", "in_several_splits"), ("d", "split"), ("c", "missing"), ("x", "extra"), ("b", "review")}
