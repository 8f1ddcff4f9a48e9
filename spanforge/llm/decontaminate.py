"""Benchmark decontamination: a broadcast set of test n-grams against every window of every document.

Words are runs of ASCII letters and digits (lower-cased) and characters beyond
ASCII.  A window is `n` consecutive words of a benchmark item; a shorter item,
unless empty, is one window.  A document's windows are hashed by one running
sum; those whose hash is in the set are verified word by word.

The set is broadcast in slices of at most `slice_windows` windows; a larger
benchmark takes one pass over the documents per slice, with the hits so far
written in between, so no executor ever holds more than one slice.

Defined results: null and empty texts have no words, no hits and are clean; an
empty benchmark leaves every document clean; items without words never occur;
items that share a window all count; the windows of an item without id hit like
others, but it is not in the item list; ids of any type are named as strings;
repeated rows each get their own result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans, work

WORDS = 13
#: Windows broadcast at once (about 200 bytes each in a worker).
SLICE_WINDOWS = 500_000
_FILTER_BITS = 20
_STEP = 0xB5297A4D3F84D5B5


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = spans.lower_ascii(buf)
    starts, ends, at = spans.word_spans(low, offsets, alphanumeric=True)
    return low, starts, ends, at


def _window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, the same wherever it stands."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = (np.full(n + 1, m, np.uint64) for m in (_STEP, pow(_STEP, -1, 1 << 64)))
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n])])
    return spans.mix((total[size:] - total[:-size]) * down[: n - size + 1])


class WindowSet:
    """Windows of some items by length: a bit filter, and the words of each with its items."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str | None]]):
        self.items = {b" ".join(w): sorted({x for x in i if x is not None}) for w, i in windows.items()}
        by_size = defaultdict(list)
        for w in windows:
            by_size[len(w)].append(w)
        self.filters = {}
        for size, some in by_size.items():
            flat = [x for w in some for x in w]
            ends = np.cumsum(np.array([len(x) for x in flat], np.int64))
            buf = np.frombuffer(b"".join(flat), np.uint8)
            h = spans.hash_spans(buf, ends - np.array([len(x) for x in flat]), ends)
            bits = np.zeros(1 << _FILTER_BITS, bool)
            own = _window_hashes(h, size)[::size]
            bits[(own & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
            self.filters[size] = (bits, np.unique(own))

    def hits(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, list[str]]]:
        """(document, first word, number of words, items) of each window that occurs."""
        h = spans.hash_spans(low, starts, ends)
        data = None
        doc_of = None
        for size, (bits, known) in self.filters.items():
            own = _window_hashes(h, size)
            maybe = np.flatnonzero(bits[(own & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
            maybe = maybe[known[np.minimum(np.searchsorted(known, own[maybe]), len(known) - 1)] == own[maybe]]
            if not len(maybe):
                continue
            if data is None:
                data = low.tobytes()
            doc_of = np.searchsorted(at, maybe, side="right") - 1
            inside = maybe + size <= at[doc_of + 1]
            for w, d in zip(maybe[inside].tolist(), doc_of[inside].tolist(), strict=True):
                words = b" ".join([data[starts[k] : ends[k]] for k in range(w, w + size)])
                if (items := self.items.get(words)) is not None:
                    yield d, w - int(at[d]), size, items


def windows(benchmark: DataFrame, text: str, item_id: str, n: int) -> DataFrame:
    """Distinct (words, item) of the benchmark's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in spans.chunks(batches, "text"):
            low, starts, ends, at = _words(buf, offsets)
            data = low.tobytes()
            all_words = [data[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            names, made, items = batch.column(1).to_pylist(), [], []
            for name, a, b in zip(names, at.tolist(), at[1:].tolist(), strict=False):
                own = all_words[a:b]
                for k in range(max(1, len(own) - n + 1) if own else 0):
                    made.append(" ".join(own[k : k + n]))
                    items.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array(items, pa.string())], names=["words", "item"])

    rows = benchmark.select(F.col(text).alias("text"), F.col(item_id).cast("string").alias("item"))
    return work.map_arrow(rows, run, "words string, item string").distinct()


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", bench_text: str = "text", item_id: str = "item_id", n: int = WORDS, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """docs with n_words, hit_spans (first word and end of each run of hit words) and hit_items."""
    for c in ("n_words", "hit_spans", "hit_items"):
        if c in docs.columns:
            raise ValueError(f"column {c} would clash with the result")
    spark = docs.sparkSession
    found = windows(benchmark, bench_text, item_id, n)
    slices = max(1, -(-found.count() // slice_windows))
    found = work.table(found) if slices > 1 else found
    rows = docs.withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast("array<long>"), "hit_items": F.array().cast("array<string>")})
    for k in range(slices):
        some = found.where(F.pmod(F.xxhash64("words"), F.lit(slices)) == k) if slices > 1 else found
        sets: dict[tuple[bytes, ...], list[str | None]] = defaultdict(list)
        for r in some.toLocalIterator():
            sets[tuple(r["words"].encode().split(b" "))].append(r["item"])
        shared = spark.sparkContext.broadcast(WindowSet(sets))
        rows = work.map_arrow(rows, _scanner(shared, text), rows.schema)
        if k + 1 < slices:
            rows = work.table(rows)
    return rows


def _scanner(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, buf, offsets in spans.chunks(batches, text):
            low, starts, ends, at = _words(buf, offsets)
            marks: dict[int, list[tuple[int, int]]] = defaultdict(list)
            items: dict[int, set[str]] = defaultdict(set)
            for d, w, size, some in own.hits(low, starts, ends, at) if own.filters else ():
                marks[d].append((w, w + size))
                items[d].update(some)
            names = batch.schema.names
            before_spans, before_items = (batch.column(names.index(c)) for c in ("hit_spans", "hit_items"))
            hit_spans, hit_items = [], []
            for d in range(batch.num_rows):
                if d not in marks:
                    hit_spans.append(before_spans[d].as_py())
                    hit_items.append(before_items[d].as_py())
                    continue
                flat = before_spans[d].as_py()
                joined: list[int] = []
                for a, b in sorted([*zip(flat[::2], flat[1::2], strict=True), *marks[d]]):
                    if joined and a <= joined[-1]:
                        joined[-1] = max(joined[-1], b)
                    else:
                        joined += [a, b]
                hit_spans.append(joined)
                hit_items.append(sorted({*before_items[d].as_py(), *items[d]}))
            new = {"n_words": pa.array(np.diff(at), pa.int64()), "hit_spans": pa.array(hit_spans, pa.list_(pa.int64())), "hit_items": pa.array(hit_items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)

    return run


def judge(scanned: DataFrame, least: int = 20) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated: hit words are at least 1 in `least`."""
    hit = F.aggregate(F.transform("hit_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    listed = F.array_join(F.array_sort("hit_items"), ",")
    made = scanned.withColumns({"n_hit": hit, "n_items": F.size("hit_items").cast("long"), "items_sha256": F.sha2(listed, 256)})
    return made.withColumn("contaminated", (F.col("n_hit") > 0) & (least * F.col("n_hit") >= F.col("n_words")))


def remove_spans(scanned: DataFrame, text: str = "text") -> DataFrame:
    """scanned with the hit words cut out of the text, from each run's first word to its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in spans.chunks(batches, text):
            _, starts, ends, at = _words(buf, offsets)
            data, names = buf.tobytes(), batch.schema.names
            column = batch.column(names.index(text))
            cut = []
            for d, flat in enumerate(batch.column(names.index("hit_spans")).to_pylist()):
                if not flat:
                    cut.append(column[d].as_py())
                    continue
                parts, pos = [], int(offsets[d])
                for a, b in zip(flat[::2], flat[1::2], strict=True):
                    parts.append(data[pos : starts[at[d] + a]])
                    pos = int(ends[at[d] + b - 1])
                cut.append(b"".join([*parts, data[pos : offsets[d + 1]]]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()) if c == text else batch.column(i) for i, c in enumerate(names)], names=names)

    return work.map_arrow(scanned, run, scanned.schema)
