"""Near-duplicates by b-bit MinHash, confirmed on whole shingle sets.

1. One scan gives each document its set of distinct five-word shingles (64-bit
   hashes), the set's size, a 128-bit fingerprint of its words, the minima of
   128 hash functions, band keys of five minima each (20 by default), and a signature of the
   minima's four low bits.  Documents of the same words form a class.
2. Classes that share a band key are candidates.  Within a bucket, signatures
   are compared as arrays; matching bits, corrected for chance, estimate the
   similarity.  Pairs from 0.15 below the limit on join candidate groups.
3. Within a candidate group, similarities are computed exactly from the sets;
   linked classes form components.

Large buckets and groups are cut into chunks and each pair of chunks is a piece
of work of bounded size; a piece returns a spanning star of what it linked,
never its pairs, so results grow with the documents.  A linked pair of
similarity 0.85 shares none of 20 bands with probability 2e-5 (of 0.8: 25 bands,
5e-5) and is underestimated by 0.15 with probability 4e-6 (2e-5); all fall fast
for closer pairs.

Defined results: without words or text the set is empty and links with nothing;
fewer than five words are one shingle; exact copies are always linked; a row
without doc_id links with nothing and stays, without component; rows of one
doc_id are one node, for which, if their words differ, those of the least
fingerprint stand; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans, work
from .components import components

SHINGLE = 5
HASHES = 128
BANDS, ROWS = 20, 5
BITS = 4
#: Percent: least similarity of a link, and how far below it an estimate may lie.
LIMIT, MARGIN = 85, 15
#: Classes, and shingles, of a chunk.
CHUNK, CHUNK_SHINGLES = 512, 1 << 20
#: Bytes of text whose shingles a worker makes at once; bounds its memory.
CHUNK_BYTES = 3 << 18
#: Classes whose ids are broadcast to find their texts: 8 bytes each; beyond, a shuffle finds them.
BROADCAST_CLASSES = 2_000_000

_rng = np.random.default_rng(2010)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MUL = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_STEPS = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTHS = _rng.integers(0, 1 << 63, SHINGLE + 1, dtype=np.uint64)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, the first of each text, and two fingerprints of each text's words."""
    low = spans.lower_ascii(buf)
    starts, ends, at = spans.word_spans(low, offsets)
    n, docs = len(starts), len(offsets) - 1
    h = spans.hash_spans(low, starts, ends)
    size = np.diff(at)
    marks = []
    for k in (0, 1):  # order-sensitive sums over the words
        g = h if k == 0 else spans.hash_spans(low, starts, ends, 1)
        place = (np.arange(n) - np.repeat(at[:-1], size)).astype(np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spans.mix(g + spans.mix(place + np.uint64(7 + k))))])
        marks.append(spans.mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)).view(np.int64))
    doc = np.repeat(np.arange(docs), size)
    width = np.minimum(size, SHINGLE)[doc] if n else np.zeros(0, np.int64)
    first = np.arange(n) + width <= at[1:][doc] if n else np.zeros(0, bool)
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        on = width > k
        total[on] += h[np.minimum(np.arange(n) + k, n - 1)[on]] * _STEPS[k]
    s = spans.mix(total + _LENGTHS[width])[first] if n else total
    doc = doc[first] if n else doc
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.searchsorted(doc[new], np.arange(docs + 1)), marks[0], marks[1]


def sketch(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, f1, f2, bands (long, one each), signature (two minima a byte)."""
    if not 0 < bands * ROWS <= HASHES:
        raise ValueError("more bands than hash functions allow")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in spans.chunks(batches, "__text", CHUNK_BYTES):
            s, at, f1, f2 = shingle_sets(buf, offsets)
            docs = batch.num_rows
            full = np.flatnonzero(np.diff(at))
            minima = np.zeros((HASHES, docs), np.uint32)
            x = (s >> np.uint64(32)).astype(np.uint32)
            for k in range(HASHES):
                if len(full):
                    v = (x ^ _XOR[k]) * _MUL[k]
                    v ^= v >> np.uint32(15)
                    v *= np.uint32(0x2C1B3C6D)
                    minima[k, full] = np.minimum.reduceat(v, at[full])
            keys = np.zeros((docs, bands), np.uint64)
            for b in range(bands):
                key = np.full(docs, b + 1, np.uint64)
                for m in minima[b * ROWS : (b + 1) * ROWS]:
                    key = spans.mix(key * np.uint64(0x9E3779B97F4A7C15) + m)
                keys[:, b] = key
            low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint8)
            packed = np.ascontiguousarray((low[0::2] | low[1::2] << np.uint8(4)).T)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(docs + 1) * bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            made = [pa.array(np.diff(at), pa.int64()), pa.array(f1), pa.array(f2), listed, pa.array([r.tobytes() for r in packed], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_shingles", "f1", "f2", "bands", "signature"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    return work.map_arrow(rows, run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, signature binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows, sorted by the first `keys` columns, that agree in them."""
    held: list[pa.RecordBatch] = []
    last = None

    def cut(batch: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            c = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        at = [0, *cut(batch).tolist(), batch.num_rows]
        key = tuple(batch.column(k)[0].as_py() for k in range(keys))
        if held and key != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(at, at[1:], strict=False):
            if held and a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in range(keys))
    if held:
        yield pa.Table.from_batches(held)


def _stars(nodes: np.ndarray, linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """(least, other) for the components of a symmetric matrix; nodes ascend."""
    label = np.arange(len(nodes))
    while True:
        low = np.where(linked, label[None, :], len(nodes)).min(axis=1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(label != np.arange(len(nodes))).tolist():
        yield int(nodes[label[i]]), int(nodes[i])


_POPCOUNT_SAME = np.array([((x & 15) == 0) + ((x >> 4) == 0) for x in range(256)], np.uint8)


def _estimates(signatures: np.ndarray) -> np.ndarray:
    """Percent similarity of all pairs, corrected for minima whose low bits agree by chance."""
    m = len(signatures)
    same = np.zeros((m, m), np.int32)
    for k in range(signatures.shape[1]):
        column = signatures[:, k]
        same += _POPCOUNT_SAME[column[:, None] ^ column[None, :]]
    chance = 1 / (1 << BITS)
    return 100 * (same / HASHES - chance) / (1 - chance)


def _by_signature(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: set[tuple[int, int]] = set()
        for t in _groups(batches, 3):
            nodes, where = np.unique(t.column("node").to_numpy(), return_index=True)
            if len(nodes) > 1:
                data = b"".join(t.column("signature").take(pa.array(where)).to_pylist())
                edges.update(_stars(nodes, _estimates(np.frombuffer(data, np.uint8).reshape(len(nodes), -1)) >= limit - MARGIN))
            if len(edges) > 50_000:
                yield _edge_batch(edges)
                edges = set()
        yield _edge_batch(edges)
        spans.release()

    return run


def _edge_batch(edges: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (np.array(sorted(edges), np.int64).reshape(-1, 2)).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _linked(sets: list[np.ndarray], limit: int) -> np.ndarray:
    """Which pairs of sets have at least `limit` percent of their union in common; exact."""
    sizes = np.array([len(s) for s in sets])
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        out = np.zeros((2, 2), bool)
        out[0, 1] = out[1, 0] = both > 0 and 100 * both >= limit * (sizes.sum() - both)
        return out
    doc = np.repeat(np.arange(m), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    use = times[column] > 1
    doc, column = doc[use], shared[column[use]]
    common = np.zeros((m, m), np.float64)
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    wide = 2048
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, [low, low + wide])
        part = np.zeros((m, wide), np.float32)
        part[doc[a:b], column[a:b] - low] = 1
        common += part @ part.T
    return (common > 0) & (100 * common >= limit * (sizes[:, None] + sizes[None, :] - common)) & ~np.eye(m, dtype=bool)


def _by_sets(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: set[tuple[int, int]] = set()
        for t in _groups(batches, 3):
            nodes, where = np.unique(t.column("node").to_numpy(), return_index=True)
            if len(nodes) > 1:
                sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").take(pa.array(where)).to_pylist()]
                edges.update(_stars(nodes, _linked(sets, limit)))
            if len(edges) > 50_000:
                yield _edge_batch(edges)
                edges = set()
        yield _edge_batch(edges)
        spans.release()

    return run


def _chunked(members: DataFrame, chunks) -> DataFrame:
    """members (g, node, ...) once for each pair of chunks that the node takes part in: g, i, j, node, ..."""
    c = F.pmod(F.xxhash64("node"), F.col("__chunks"))
    cut = members.withColumn("__chunks", chunks.cast("int")).withColumn("__c", c.cast("int"))
    wide = cut.withColumn("__d", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)))
    return wide.withColumns({"i": F.least("__c", "__d"), "j": F.greatest("__c", "__d")}).drop("__chunks", "__c", "__d")


def _texts_of(docs: DataFrame, nodes: DataFrame, text: str, doc_id: str) -> DataFrame:
    """node, f1, f2 and the shingle set of the rows whose id is among nodes (unique)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("__text"))
    some = rows.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_CLASSES else nodes, "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in spans.chunks(batches, "__text", CHUNK_BYTES):
            s, at, f1, f2 = shingle_sets(buf, offsets)
            made = [s[a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f1), pa.array(f2), pa.array(made, pa.binary())], names=["node", "f1", "f2", "shingles"])

    return work.map_arrow(some, run, "node long, f1 long, f2 long, shingles binary")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links of at least limit percent) and kept of every row."""
    every = work.table(sketch(docs, text, doc_id, bands))
    total = every.count()
    all_rows = every.where("doc_id is not null")
    by_words = all_rows.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"))
    classes = work.table(by_words)
    # The class that stands for each node; more than one only where a doc_id repeats with other words.
    chosen = classes.groupBy("node").agg(F.min(F.struct("f1", "f2", "n")).alias("c")).select("node", "c.*")
    own = all_rows.select(F.col("doc_id").alias("node"), "f1", "f2", "bands", "signature").join(chosen.select("node", "f1", "f2"), ["node", "f1", "f2"], "left_semi").dropDuplicates(["node"])
    heads = work.table(own.select("node", "bands", "signature"))
    # Buckets with more than one class.
    keys = heads.select("node", F.explode("bands").alias("g"))
    buckets = work.table(keys.groupBy("g").agg(F.count("*").alias("size")).where("size > 1"))
    members = work.join_hot(keys, buckets, ["g"], "size", total)
    pieces = _chunked(members.select("g", "node", "size"), F.ceil(F.col("size") / CHUNK)).join(heads.select("node", "signature"), "node")
    close = pieces.select("g", "i", "j", "node", "signature").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    groups = work.table(components(work.map_arrow(close, _by_signature(limit), "a long, b long")))
    # Exact similarities within candidate groups.
    sized = groups.join(chosen, "node")
    sizes = work.table(sized.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("total")))
    placed = work.join_hot(sized, sizes, ["component"], "size", total).withColumnRenamed("component", "g")
    sets = _texts_of(docs, groups.select("node"), text, doc_id).dropDuplicates(["node", "f1", "f2"])
    chunks = F.greatest(F.ceil(F.col("size") / CHUNK), F.ceil(F.col("total") / CHUNK_SHINGLES))
    exact = _chunked(placed.select("g", "node", "f1", "f2", "size", "total").join(sets, ["node", "f1", "f2"]), chunks)
    exact = exact.select("g", "i", "j", "node", "shingles").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    linked = work.table(components(work.map_arrow(exact, _by_sets(limit), "a long, b long")))
    named = classes.join(linked, "node", "left").select("f1", "f2", "copies", F.coalesce("component", "node").alias("component_id"))
    named = work.table(named)
    some = work.join_hot(all_rows.where("n_shingles > 0").select("doc_id", "n_shingles", "f1", "f2"), named, ["f1", "f2"], "copies", total)
    alone = all_rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = some.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    nameless = every.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id")).unionByName(nameless)
