"""Media at the boundary: probe documents as tables, file hashes, and command planners.

Nothing here runs a decoder. Planners give the argument lists that one would run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import audit

PROBE = "streams array<struct<index:int,codec_type:string,codec_name:string,width:int,height:int,pix_fmt:string,avg_frame_rate:string,r_frame_rate:string,nb_frames:string,duration:string,start_time:string,time_base:string,tags:map<string,string>,side_data_list:array<struct<rotation:double>>>>, format struct<format_name:string,duration:string,start_time:string,size:string>"


def normalize_probes(probes: DataFrame) -> DataFrame:
    """Video metadata from probe documents (source_id, probe_json): the first video stream of each."""
    p = probes.select("source_id", F.from_json("probe_json", PROBE).alias("p"))
    v = p.select("source_id", F.element_at(F.filter("p.streams", lambda s: s["codec_type"] == "video"), 1).alias("v"), F.col("p.format").alias("f"))
    turned = exprs.rotation(F.element_at("v.tags", F.lit("rotate")), F.element_at(F.filter(F.transform("v.side_data_list", lambda x: x["rotation"]), lambda x: x.isNotNull()), 1))
    fps = F.coalesce(exprs.parse_rate(F.col("v.avg_frame_rate")), exprs.parse_rate(F.col("v.r_frame_rate")))
    frames = exprs.optional_integer(F.col("v.nb_frames"))
    r = v.withColumns({"rotation": turned, "fps": fps, "frame_count": frames})
    w, h = exprs.display_size(F.col("v.width"), F.col("v.height"), F.col("rotation"))
    seconds = exprs.duration_of(exprs.optional_number(F.col("v.duration")), exprs.optional_number(F.col("f.duration")), F.col("frame_count"), F.col("fps"))
    start = F.coalesce(exprs.optional_number(F.col("v.start_time")), exprs.optional_number(F.col("f.start_time")), F.lit(0.0))
    return r.select("source_id", F.col("v.index").alias("stream_index"), F.col("v.width").alias("width"), F.col("v.height").alias("height"), w.alias("display_width"), h.alias("display_height"), "rotation", "fps", "frame_count", seconds.alias("duration"), start.alias("start_time"), F.col("v.codec_name").alias("codec"), F.col("v.pix_fmt").alias("pixel_format"), F.col("v.time_base").alias("time_base"), F.col("f.format_name").alias("format"), exprs.optional_integer(F.col("f.size")).alias("size"))


def probe_violations(metadata: DataFrame) -> DataFrame:
    rules = {"no_video": (F.col("width").isNull(), F.lit(None)), "duration": (F.col("width").isNotNull() & F.col("duration").isNull(), F.lit(None)), "size": ((F.col("width") < 1) | (F.col("height") < 1), F.concat_ws("x", "width", "height"))}
    return audit.check(metadata, "video", F.col("source_id"), rules)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of every file; a file of up to 2 GB is read whole by one task."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify_files(files: DataFrame, listed: DataFrame, key: str = "name") -> DataFrame:
    """Violations between files (key, size, sha256) and a manifest's list of them."""
    both = listed.select(key, F.col("size").alias("a"), F.col("sha256").alias("x")).join(files.select(key, F.col("size").alias("b"), F.col("sha256").alias("y")), key, "full")
    rules = {
        "missing_file": (F.col("b").isNull(), F.lit(None)),
        "unlisted_file": (F.col("a").isNull(), F.lit(None)),
        "size": (F.col("a") != F.col("b"), F.concat_ws(" <> ", "a", "b")),
        "sha256": (F.col("x") != F.col("y"), F.concat_ws(" <> ", "x", "y")),
        "unsafe_path": (~exprs.safe_path(F.col(key)), F.col(key)),
    }
    return audit.check(both, "file", F.col(key), rules)


def probe_command(path: str, tool: str = "ffprobe") -> list[str]:
    return [tool, "-v", "error", "-show_streams", "-show_format", "-of", "json", path]


def clip_commands(segments: DataFrame, routes: tuple[str, ...] = ("keep",), tool: str = "ffmpeg") -> DataFrame:
    """segments (source_id, path, segment_index, route, s, e) of the routes with file name and argument list."""
    name = F.format_string("%s_%04d_%s.mp4", F.regexp_replace(F.col("source_id").cast("string"), r"[^A-Za-z0-9._-]", "_"), F.col("segment_index"), F.col("route"))
    argv = F.array(F.lit(tool), F.lit("-v"), F.lit("error"), F.lit("-ss"), exprs.timestamp_text(F.col("s")), F.lit("-i"), F.col("path"), F.lit("-t"), exprs.timestamp_text(F.col("e") - F.col("s")), name)
    return segments.where(F.col("route").isin(*routes)).withColumns({"file_name": name, "argv": argv})


def sheet_layout(n, columns: int):
    """Rows and columns of a contact sheet of n frames."""
    wide = F.least(F.lit(columns), n)
    return F.struct(F.ceil(n / wide).cast("int").alias("rows"), wide.cast("int").alias("columns"))


def cache_misses(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Feature keys to compute: wanted ones that the cache table lacks."""
    return wanted.select("feature_key").distinct().join(cached.select("feature_key"), "feature_key", "left_anti")
