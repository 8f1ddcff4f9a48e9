import json

import pytest
from pyspark.sql import functions as F

from spanforge.config import CompilerPolicy
from spanforge.functions import exprs
from spanforge.operators import audit, compiler, curation, intervals
from spanforge.sources import jsonl, manifest, media


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [("25", 25.0), ("50/2", 25.0), ("0/0", None), ("N/A", None), ("-5", None), ("24/0", None)])
def test_rate(spark, text, want):
    assert one(spark, text, exprs.parse_rate) == want


@pytest.mark.parametrize(("text", "want"), [("01:02:03.5", 3723.5), ("00:61:00", None), ("1:2", None)])
def test_clock(spark, text, want):
    assert one(spark, text, exprs.clock_seconds) == want


@pytest.mark.parametrize(("path", "want"), [("a/b.mp4", True), ("../a", False), ("/a", False), ("a\\b", False), ("a*b", False), ("", False), (None, False)])
def test_paths(spark, path, want):
    assert one(spark, path, exprs.safe_path) is want


def test_records(spark, tmp_path):
    good = {"schema": jsonl.DEFAULT_NAMESPACE, "id": "a", "group_id": "g", "video": "v", "license": "cc", "windows": [{"start_s": 0, "end_s": 2, "readiness": "KEEP", "issues": {"blur": True}, "boundary": {"start_s": 1.0}, "boundary_valid": True}, {"start_s": 2, "end_s": 1, "readiness": "MAYBE", "readiness_valid": True, "boundary": {"start_s": 5.0, "end_s": 1.5}, "boundary_valid": {"end": True}}]}
    (tmp_path / "r.jsonl").write_text("\n".join([json.dumps(good), "", "{bad", json.dumps(good), json.dumps(good | {"id": "b", "schema": "x"})]))
    records, bad = jsonl.parse_records(jsonl.read_lines(spark, str(tmp_path / "r.jsonl")))
    assert {r["rule"] for r in bad.collect()} == {"json", "schema", "missing_field", "duplicate_id"}
    flat = jsonl.flatten(records.where("id = 'a' and line = 1"))
    rows = {r["example_id"]: r for r in flat.collect()}
    assert rows["a:0"]["boundary_start_valid"] and not rows["a:0"]["boundary_end_valid"]
    assert not rows["a:1"]["boundary_start_valid"] and rows["a:1"]["boundary_end_valid"]
    rules = {(r["key"], r["rule"]) for r in audit.training_windows(flat).collect()}
    assert rules == {("a:1", "interval"), ("a:1", "readiness_vocabulary"), ("a:1", "boundary_outside"), ("a:1", "boundary_inverted")}
    cells = {(r["example_id"], r["label"]): (r["value"], r["valid"]) for r in jsonl.encode(flat).collect()}
    assert cells["a:0", "readiness"] == (0.0, True) and cells["a:0", "blur"] == (1.0, True) and cells["a:0", "exposure"] == (None, False)


def test_canonical_json():
    assert jsonl.canonical({"b": 1e-4, "a": [1, None]}) == '{"a":[1,null],"b":0.0001}'
    with pytest.raises(ValueError, match="finite"):
        jsonl.canonical({"a": float("nan")})


def test_manifest_round_trip(spark, tmp_path):
    w = spark.createDataFrame([(1, i, i * 2.0, i * 2.0 + 2, 0.9 if i < 3 else 0.1, None) for i in range(5)], "source_id long, idx int, s double, e double, score double, u double")
    segments = compiler.compile_segments(w, CompilerPolicy(gap=0))
    made = manifest.build(w, segments, spark.createDataFrame([(1, 10.0)], "source_id long, duration double"))
    manifest.write(made, str(tmp_path / "m"))
    records, bad = manifest.read(spark, str(tmp_path / "m/source_id=1"))
    assert bad.count() == 0 and manifest.warnings(records).count() == 0
    got = {(r["record_type"], r["decision"]): (r["n"], r["seconds"]) for r in manifest.summary(records).collect()}
    assert got["segment", "KEEP"] == (1, 6.0)
    (tmp_path / "bad.jsonl").write_text(json.dumps({"record_type": "window", "version": 2, "index": 0, "start_s": 1, "end_s": 0}))
    _, bad = manifest.read(spark, str(tmp_path / "bad.jsonl"))
    assert {r["rule"] for r in bad.collect()} == {"header_first", "schema", "version", "interval"}


def test_probe(spark):
    doc = {"streams": [{"index": 1, "codec_type": "audio"}, {"index": 0, "codec_type": "video", "width": 1920, "height": 1080, "avg_frame_rate": "0/0", "r_frame_rate": "30/1", "nb_frames": "90", "side_data_list": [{"rotation": -90.0}]}], "format": {"start_time": "1.5"}}
    r = media.normalize_probes(spark.createDataFrame([("v", json.dumps(doc))], "source_id string, probe_json string")).first()
    assert (r["display_width"], r["display_height"], r["rotation"], r["fps"], r["duration"], r["start_time"]) == (1080, 1920, 270.0, 30.0, 3.0, 1.5)


def test_file_verification(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x")
    got = media.file_hashes(spark, str(tmp_path)).select(F.lit("a.bin").alias("name"), "size", "sha256")
    listed = spark.createDataFrame([("a.bin", 1, "0" * 64), ("b.bin", 1, "0" * 64)], "name string, size long, sha256 string")
    assert {(r["key"], r["rule"]) for r in media.verify_files(got, listed).collect()} == {("a.bin", "sha256"), ("b.bin", "missing_file")}


def test_occupancy(spark):
    from spanforge.config import PlanSpec
    from spanforge.operators import planning

    acts = spark.createDataFrame([(1, 1.0, 5.0), (1, 4.0, 8.0), (1, 20.0, 21.0)], "source_id long, a double, b double")
    for duration, n in ((30.0, 9), (31.0, 10)):
        g = planning.sliding_windows(spark.createDataFrame([(1, duration)], "source_id long, duration double"), PlanSpec(window=6, stride=3)).select("source_id", "window_index", "s", "e")
        plain, dealt = ({r["window_index"]: round(r["occupancy"], 9) for r in intervals.occupancy(g, acts, b).collect()} for b in (None, 2.5))
        assert plain == dealt and len(plain) == n
        assert plain[0] == round(5 / 6, 9) and plain[3] == 0


def test_frame_spans(spark):
    rows = [(1, i, i * 0.5, x) for i, x in enumerate(["a", "a", None, None, "b"])]
    got = [(r["label"], r["s"], r["e"]) for r in intervals.frame_spans(spark.createDataFrame(rows, "source_id long, frame int, timestamp_s double, label string"), 2.0, ["label"]).orderBy("span").collect()]
    assert got == [("a", 0.0, 1.0), (None, 1.0, 2.0), ("b", 2.0, 2.5)]


def test_transform_plan(spark):
    src = spark.createDataFrame([(1, 2.0, 10.0, True, False)], "source_id long, duration double, fps double, has_boxes boolean, positive boolean")
    skips = [r["skip"] for r in curation.transform_plan(src).collect()]
    assert (skips.count(None), skips.count("source_positive_required")) == (6, 2)


def test_transform_plan_wants_human_issue_labels(spark):
    kinds = ["human", "human-derived", "programmatic-controlled-corruption", "unlabeled", None]
    src = spark.createDataFrame([(i, 2.0, 10.0, True, p, k) for i, (k, p) in enumerate([(k, p) for k in kinds for p in (True, False)])], "source_id long, duration double, fps double, has_boxes boolean, positive boolean, issue_kind string")
    want = lambda k, p: "source_positive_required" if not p else None if k in kinds[:2] else "human_issue_provenance_required"
    got = curation.transform_plan(src).collect()
    assert len(got) == 80 and all(r["skip"] == (want(r["issue_kind"], r["positive"]) if r["faithful"] else None) for r in got)
    bare = [r["skip"] for r in curation.transform_plan(src.where("source_id = 0").drop("issue_kind")).collect()]
    assert bare.count("human_issue_provenance_required") == 2


def test_streaming_matches_batch(spark, tmp_path):
    from spanforge.streaming.routing import route_stream

    kind = "source_id long, idx long, s double, e double, score double, u double"
    rows = [(k % 2, k // 2, k * 1.0, k + 2.0, [0.1, 0.8, 0.6, 0.4][k % 4], None) for k in range(40)]
    for part in range(2):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = route_stream(stream).writeStream.format("memory").queryName("routed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["source_id"], r["idx"]): r["route"] for r in spark.table("routed").collect()}
    want = {(r["source_id"], r["idx"]): r["route"] for r in compiler.route_windows(spark.createDataFrame(rows, kind), CompilerPolicy()).collect()}
    assert len(got) == 40 and sum(got[k] == want[k] for k in want) >= 40


def test_canonical_lines_keep_types_whatever_else_is_in_a_batch(spark):
    kind = "id long, n int, x double, m map<string,double>, l array<struct<k:int,v:string>>"
    rows = [(2, 5, 1.0, {"b": 1e-4, "a": 2.0}, [(1, None)]), (1, None, None, None, None)]
    for some in (rows, rows[:1]):
        got = {r["id"]: r["value"] for r in jsonl.canonical_lines(spark.createDataFrame(some, kind).coalesce(1), ["id"]).collect()}
        assert got[2] == '{"id":2,"l":[{"k":1}],"m":{"a":2.0,"b":0.0001},"n":5,"x":1.0}'
    assert jsonl.canonical_lines(spark.createDataFrame(rows, kind), ["id"]).where("id = 1").first()["value"] == '{"id":1}'
    with pytest.raises(Exception, match="not a finite number"):
        jsonl.canonical_lines(spark.createDataFrame([(1, 1, float("nan"), None, None)], kind), ["id"]).collect()


def test_json_strings_undo_every_escape(spark):
    from spanforge.functions import exprs

    texts = [r'{"a":"\u002fetc/x","b":["c\"d",{"e":"~\n"}]}', '{"k":1}', '["  /tmp"]', '"x"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", exprs.json_strings(df["t"]).alias("s")).collect()}
    assert got == {0: ["/etc/x", 'c"d', "~\n"], 1: [], 2: ["  /tmp"], 3: ["x"]}
    bad = df.select("i", exprs.json_strings(df["t"]).alias("s")).selectExpr("i", "explode(s) v")
    assert {r["i"] for r in bad.where(exprs.local_path(bad["v"])).collect()} == {0, 2}
