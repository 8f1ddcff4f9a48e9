import hashlib
import random

import pytest

from spanforge.config import SplitSpec
from spanforge.operators import calibrate, metrics, splits, targets


def test_confusion_and_scores(spark):
    rows = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (None, 1), (0, None)], "y int, p int")
    s = {r["class"]: r for r in metrics.class_scores(metrics.confusion(rows, "y", "p", 3)).collect()}
    assert [s[k]["f1"] for k in range(3)] == [0.0, 0.0, 0.0]
    assert [s[k]["support"] for k in range(3)] == [1, 1, 1]
    only = spark.createDataFrame([(0, 0), (2, 2)], "y int, p int")
    s = {r["class"]: r["f1"] for r in metrics.class_scores(metrics.confusion(only, "y", "p", 3)).collect()}
    assert s == {0: 1.0, 1: None, 2: 1.0}
    assert metrics.macro(metrics.class_scores(metrics.confusion(only, "y", "p", 3))).first()["macro_f1"] == 1.0


def test_auroc_and_average_precision_against_pairs(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 9) / 10, rng.choice([True, False, None])) for k in range(4) for _ in range(40)] + [(9, 0.5, True)]
    df = spark.createDataFrame(rows, "k int, s double, t boolean")
    auc = {r["k"]: r["auroc"] for r in metrics.auroc(df, ["k"], "s", "t").collect()}
    ap = {r["k"]: r["average_precision"] for r in metrics.average_precision(df, ["k"], "s", "t").collect()}
    assert auc[9] is None
    for k in range(4):
        pos = [s for q, s, t in rows if q == k and t]
        neg = [s for q, s, t in rows if q == k and t is False]
        assert auc[k] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
        assert ap[k] == pytest.approx(sum(sum(b >= a for b in pos) / sum(b >= a for b in pos + neg) for a in pos) / len(pos))


def test_duplicate_predictions_match_once(spark):
    ref = spark.createDataFrame([(1, "start", 2.0)], "source_id long, boundary string, t double")
    pred = spark.createDataFrame([(1, "start", 2.1), (1, "start", 2.2)], "source_id long, boundary string, t double")
    m = metrics.event_matches(ref, pred, 0.3)
    r = m.first()
    assert (r["tp"], r["n_pred"] - r["tp"]) == (1, 1)
    assert metrics.event_scores(m, ["boundary"]).first()["f1"] == pytest.approx(2 / 3)


def test_event_matches_against_merge(spark):
    rng = random.Random(8)
    a = [(s, "start", rng.randint(0, 60) / 4) for s in range(30) for _ in range(rng.randint(0, 12))]
    b = [(s, "start", rng.randint(0, 60) / 4) for s in range(30) for _ in range(rng.randint(0, 12))]
    kind = "source_id long, boundary string, t double"
    got = {r["source_id"]: r["tp"] for r in metrics.event_matches(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 0.5).collect()}
    for s, tp in got.items():
        left, right = (sorted(t for q, _, t in some if q == s) for some in (a, b))
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]  # most pairs of the first i and the first j
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (abs(x - y) <= 0.5))
        assert tp == best[-1][-1]


def test_calibration(spark):
    rows = spark.createDataFrame([(0.95, True), (0.95, False), (0.55, True), (1.0, True), (0.3, None)], "c double, ok boolean")
    bins = metrics.calibration_bins(rows, "c", "ok", 10)
    assert {r["bin"]: r["n"] for r in bins.collect()} == {9: 3, 5: 1}
    assert metrics.expected_calibration_error(bins).first()["ece"] == pytest.approx((3 * abs(2.9 / 3 - 2 / 3) + 0.45) / 4)


def test_thresholds(spark):
    rows = spark.createDataFrame([(0, 0.2, False), (0, 0.6, True), (0, 0.7, True), (1, 0.4, True)], "k int, s double, t boolean")
    best = {r["k"]: r["threshold"] for r in calibrate.best_thresholds(calibrate.threshold_sweep(rows, ["k"], "s", "t"), ["k"]).collect()}
    assert best == {0: pytest.approx(0.5), 1: 0.5}


def test_temperature(spark):
    rng = random.Random(1)
    rows = [(4.0, 0.0, 0.0, 0 if rng.random() < 0.6 else rng.choice([1, 2])) for _ in range(500)]
    t = calibrate.fit_temperature(spark.createDataFrame(rows, "a double, b double, c double, y int"), ["a", "b", "c"], "y")
    import math

    p = sum(r[3] == 0 for r in rows) / 500
    assert t == pytest.approx(4.0 / math.log(2 * p / (1 - p)), rel=0.02)


def test_allocation():
    assert splits.allocate(10, (0.8, 0.1, 0.1)) == [8, 1, 1]
    assert splits.allocate(3, (0.8, 0.1, 0.1)) == [1, 1, 1]
    assert sum(splits.allocate(7, (0.7, 0.15, 0.15))) == 7


def test_group_split_does_not_depend_on_order(spark):
    import hashlib

    groups = [f"g{i}" for i in range(50)]
    df = spark.createDataFrame([(g,) for g in groups for _ in range(3)], "g string")
    spec = SplitSpec(seed=5)
    got = {r["group"]: r["split"] for r in splits.group_assignments(df.repartition(5), "g", spec).collect()}
    order = sorted(groups, key=lambda g: (hashlib.sha256(b"5\0" + g.encode()).hexdigest(), g))
    n = splits.allocate(50, spec.fractions)
    assert got == {g: "train" if i < n[0] else "validation" if i < n[0] + n[1] else "test" for i, g in enumerate(order)}


def test_raster(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0], 1.5, 3.9, True, True)], "source_id long, window_index int, times array<double>, start_s double, end_s double, start_valid boolean, end_valid boolean")
    got = {(r["boundary"], r["frame"]): (r["value"], r["valid"]) for r in targets.rasterize(rows, 0.5).collect()}
    assert [got["start", f] for f in range(3)] == [(1, True), (0, True), (0, True)]
    assert [got["end", f] for f in range(3)] == [(None, False)] * 3


def test_rotation_display_reads_every_order(spark, tmp_path):
    from spanforge.plans import catalog

    spark.range(99_990, 100_020).selectExpr("id as o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert sum(r["n"] for r in catalog.queries()["rotation_display"](spark, str(tmp_path)).collect()) == 30


def brute_seed(rows, least, wanted):
    """First seed, over plain rows (group, ...), whose 0.7/0.15/0.15 splits have `least` of every wanted test."""
    groups = sorted({r[0] for r in rows})
    first, second, _ = splits.allocate(len(groups), (0.7, 0.15, 0.15))
    for seed in range(3000):
        order = sorted(groups, key=lambda g: (hashlib.sha256(f"{seed}\0{g}".encode()).hexdigest(), g))
        parts = order[:first], order[first : first + second], order[first + second :]
        if all(len(p) >= least and all(sum(bool(w(r)) for r in rows if r[0] in p) >= least for w in wanted) for p in parts):
            return seed


SHARES = SplitSpec(fractions=(0.7, 0.15, 0.15))
CLASSES = [lambda r, k=k: r[1] == k for k in range(3)]


def test_seed_search_goes_on_until_found(spark):
    from spanforge.plans import adapters

    rows = [(f"n{g}", y, g % 4 == 1) for g in range(12) for y in ((0, 1, 2) if g % 4 == 0 else (0, 1))]
    want = brute_seed(rows, 1, [*CLASSES, lambda r: r[2], lambda r: not r[2]])
    assert want > 256
    df = spark.createDataFrame(rows, "grp string, label int, issue boolean")
    assert [r["seed"] for r in splits.first_supported_seed(df, "grp", "label", "issue", SHARES, least=1).collect()] == [want]
    assert adapters.split_corpus(df, "grp", "label", "issue", SHARES, 1)[0] == want
    assert splits.first_supported_seed(df, "grp", "label", "issue", SHARES, want, 1).count() == 0
    assert splits.first_supported_seed(df.where("label < 2"), "grp", "label", "issue", SHARES, least=1).count() == 0


def test_seed_search_wants_every_kind_of_evidence(spark):
    made = "programmatic-controlled-corruption"
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    rows = [(f"g{g}", y, pick(True, False), pick(True, False, None), pick(True, False), pick(True, False), pick(made, "human", None)) for g in range(20) for y in (0, 1, 2)]
    df = spark.createDataFrame(rows, "grp string, label int, blur boolean, cut boolean, start_valid boolean, end_valid boolean, kind string")
    issues = [lambda r, c=c, v=v: r[c] is v for c in (2, 3) for v in (True, False)]
    bounds = [lambda r: r[4], lambda r: r[5]]
    controlled = [lambda r: r[6] == made and (r[2] is not None or r[3] is not None)]
    seeds = []
    for wanted, more in ((issues[:2], {"issue": "blur"}), (issues, {}), (issues + bounds, {"boundaries": ["start_valid", "end_valid"]}), (issues + bounds + controlled, {"boundaries": ["start_valid", "end_valid"], "issue_kind": "kind"})):
        got = splits.first_supported_seed(df, "grp", "label", more.pop("issue", ["blur", "cut"]), SHARES, least=3, **more).first()["seed"]
        assert got == brute_seed(rows, 3, [*CLASSES, *wanted])
        seeds.append(got)
    assert seeds[0] < seeds[-1]
