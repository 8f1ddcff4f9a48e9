"""Scalar expressions: parsing, formatting and checks, all as built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def optional_number(text: Column) -> Column:
    """A finite number, else null."""
    x = F.when(text.rlike(_NUMBER), F.trim(text)).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def optional_integer(text: Column) -> Column:
    """A whole number, else null."""
    x = optional_number(text)
    return F.when(x == F.floor(x), x.cast("long"))


def parse_rate(text: Column) -> Column:
    """`a/b` or a decimal; null unless finite and positive."""
    over = F.regexp_extract(text, r"^\s*([0-9.]+)\s*/\s*([0-9.]+)\s*$", 1)
    under = F.regexp_extract(text, r"^\s*([0-9.]+)\s*/\s*([0-9.]+)\s*$", 2)
    x = F.when(over != "", optional_number(over) / F.nullif(optional_number(under), F.lit(0.0))).otherwise(optional_number(text))
    return F.when(x > 0, x)


def rotation(tag: Column, side: Column) -> Column:
    """Degrees in [0, 360): the tag's, else the side data's, else 0."""
    return F.pmod(F.coalesce(optional_number(tag), side, F.lit(0.0)), F.lit(360.0))


def display_size(width: Column, height: Column, turned: Column) -> tuple[Column, Column]:
    """Width and height as shown: swapped on odd quarter turns."""
    odd = (F.abs(turned - 90) <= 1e-6) | (F.abs(turned - 270) <= 1e-6)
    return F.when(odd, height).otherwise(width), F.when(odd, width).otherwise(height)


def duration_of(stream: Column, container: Column, frames: Column, rate: Column) -> Column:
    """The first positive of: stream, container, frames over rate."""
    positive = lambda x: F.when(x > 0, x)
    return F.coalesce(positive(stream), positive(container), positive(frames / F.nullif(rate, F.lit(0.0))))


def clock_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS[.f] with minutes and seconds below 60, else null."""
    p = r"^(\d+):([0-5]\d):([0-5]\d(?:\.\d+)?)$"
    part = lambda k: F.regexp_extract(text, p, k).try_cast("double")
    return F.when(text.rlike(p), part(1) * 3600 + part(2) * 60 + part(3))


def timestamp_text(x: Column) -> Column:
    """Nine decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.9f", x), r"\.?0+$", "")


def duration_text(x: Column) -> Column:
    """m:ss.s, or h:mm:ss.s from an hour on; a dash for what is no duration."""
    tenths = F.floor(x * 10 + 0.5)
    h = F.floor(tenths / 36000)
    m = F.floor(tenths / 600) % 60
    s = (tenths % 600) / 10.0
    short = F.format_string("%d:%04.1f", m, s)
    return F.when(x.isNull() | F.isnan(x) | (x < 0), "-").when(h > 0, F.format_string("%d:%02d:%04.1f", h, m, s)).otherwise(short)


def optional_label(text: Column) -> Column:
    """Trimmed of ASCII white space; empty is null."""
    return F.nullif(F.regexp_replace(text, r"^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$", ""), F.lit(""))


def safe_path(path: Column) -> Column:
    """Whether a relative path stays below its root and has no pattern or query characters."""
    bad = path.rlike(r"[\\*?\[\]{}#]") | path.startswith("/") | path.startswith("~") | path.rlike(r"(^|/)\.\.(/|$)") | path.rlike(r"^[A-Za-z]:") | path.startswith("file://") | (path == "")
    return F.coalesce(~bad, F.lit(False))


def segment_id(source: Column, model: str, start: Column, end: Column, route: Column) -> Column:
    """sha256 of source, model, times with nine decimals and route, separated by zero bytes."""
    nul = F.unhex(F.lit("00"))
    parts = [source.cast("string"), F.lit(model), F.format_string("%.9f", start), F.format_string("%.9f", end), route]
    joined = [parts[0].cast("binary")]
    for p in parts[1:]:
        joined += [nul, p.cast("binary")]
    return F.sha2(F.concat(*joined), 256)


def learning_rate(step: Column, total: int, warmup: int, peak: float) -> Column:
    """Linear rise to the peak, then linear decay to zero."""
    rise = (step + 1) / float(max(1, warmup))
    fall = (total - step) / float(max(1, total - warmup))
    return F.lit(peak) * F.when(step < warmup, rise).otherwise(F.greatest(F.lit(0.0), fall))


def local_path(text: Column) -> Column:
    """Whether a string names a place on one machine: absolute, home, file URL or drive."""
    return F.coalesce(text.rlike(r"^\s*(/|~|file://|[A-Za-z]:[\\/])"), F.lit(False))


def json_strings(document: Column) -> Column:
    """All string values of a JSON text, at any depth (escapes undone)."""
    quoted = F.regexp_extract_all(document, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    values = F.filter(quoted, lambda x: x.endswith('"'))
    return F.from_json(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>")
