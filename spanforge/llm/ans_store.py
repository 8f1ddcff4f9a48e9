"""Token ids in a binary store: static range asymmetric numeral system (rANS).

A store is a folder of segments in ascending document order.  Each segment is a
self-contained byte stream, committed by Spark as one row of a container file,
so that it needs no file system but Spark's own and a lost task leaves no trace:

    "SFA1", counts (documents, ids, distinct ids, blocks)
    documents: doc_id, number of ids
    frequency table shared by all blocks: distinct ids and 16-bit frequencies
    block directory: first id, number of 16-bit words, states of its lanes
        (checkpoints), CRC-32 of its words, CRC-32 of its ids
    the blocks' words

Defined results: a null or empty text is the end id alone; rows without doc_id
come first; rows of one doc_id are neighbours, in no stated order; an empty
table gives a store without segments; other columns are not read.

A block holds 65,536 ids dealt over 128 interleaved lanes (the last block holds
the rest).  Every block starts from its own checkpoint, so blocks decode
independently; here all lanes of all blocks advance together as one array.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pieces, spans, work

LANES = 128
BLOCK = 1 << 16
SCALE = 16
#: Ids after which a segment ends; bounds the memory of writer and reader.
SEGMENT_IDS = 2 << 20
#: Bytes of text of a part (one task of the writer), and cells of doc_id of which a part is made up.
PART_BYTES = 16 << 20
CELLS = 4
#: Pieces that a worker remembers (in each of two generations).
MEMO = 120_000
SEGMENT = "part int, seq int, n_docs long, n_ids long, payload binary"
#: Segments up to which their offsets are broadcast: 24 bytes each.
BROADCAST_SEGMENTS = 200_000
_LOW = np.uint64(1 << 16)
_HEAD = struct.Struct("<4sqqii")


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their frequencies, at least 1 each, scaled to sum to 2**16."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    total = 1 << SCALE
    if len(symbols) > total:
        raise ValueError("more distinct ids than the table holds")
    freq = np.maximum(1, counts * total // max(1, counts.sum())).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    over = int(freq.sum()) - total
    if over < 0:
        freq[order[0]] -= over
    while over > 0:  # take from the largest, which lose the least by it
        room = freq[order] - 1
        take = np.minimum(room, np.maximum(1, over * freq[order] // freq.sum()))
        take = np.where(np.cumsum(take) <= over, take, np.maximum(0, over - (np.cumsum(take) - take)))
        freq[order] -= take
        over -= int(take.sum())
    return symbols, freq


def _encode_blocks(sym: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """sym: symbol indices by step, block and lane. Final states, and each block's words in reading order."""
    steps, blocks, lanes = sym.shape
    f_real, f_bound = freq.astype(np.float64), freq.astype(np.uint64) << np.uint64(32 - SCALE)
    f_rest, c_of = np.uint64(1 << SCALE) - freq.astype(np.uint64), cum.astype(np.uint64)
    x = np.full((blocks, lanes), _LOW, dtype=np.uint64)
    words = np.empty((steps, blocks, lanes), dtype=np.uint16)
    sent = np.empty((steps, blocks, lanes), dtype=bool)
    for t in range(steps - 1, -1, -1):
        s = sym[t]
        full = np.greater_equal(x, f_bound[s], out=sent[t])
        words[t] = x  # the low 16 bits
        x >>= full.astype(np.uint64) << np.uint64(4)
        # x < 2**32 and f <= 2**16: the double quotient never rounds up to the next whole number.
        q = (x.astype(np.float64) / f_real[s]).astype(np.uint64)
        q *= f_rest[s]
        x += q
        x += c_of[s]
    return x.astype(np.uint32), [words[:, b][sent[:, b]] for b in range(blocks)]


def _decode_blocks(states: np.ndarray, words: np.ndarray, first: np.ndarray, steps: int, freq: np.ndarray, cum: np.ndarray) -> np.ndarray:
    """The inverse of _encode_blocks, by block, step and lane; first: where each block's words begin."""
    blocks, lanes = states.shape
    slot_freq = np.repeat(freq, freq).astype(np.uint64)
    slot_bias = (np.arange(1 << SCALE) - np.repeat(cum, freq)).astype(np.uint64)
    x = states.astype(np.uint64)
    at = first.astype(np.int32)[:, None].copy()
    slots = np.empty((steps, blocks, lanes), dtype=np.uint16)
    padded = np.append(words, np.zeros(lanes, np.uint16)).astype(np.uint64)
    for t in range(steps):
        slots[t] = x  # the low 16 bits
        slot = slots[t].astype(np.intp)
        x >>= np.uint64(SCALE)
        x *= slot_freq[slot]
        x += slot_bias[slot]
        need = x < _LOW
        rank = np.cumsum(need, axis=1, dtype=np.int32)
        word = padded[at + rank - need]
        x = np.where(need, (x << np.uint64(16)) | word, x)
        at += rank[:, -1:]
    return np.repeat(np.arange(len(freq), dtype=np.uint16), freq)[slots.transpose(1, 0, 2)]


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A segment's byte stream. A null doc_id is kept as such."""
    n = len(ids)
    symbols, freq = frequencies(ids) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    cum = np.cumsum(freq) - freq
    of = np.zeros(int(symbols[-1]) + 1 if n else 1, np.uint16)
    of[symbols] = np.arange(len(symbols))
    index = of[ids]
    shapes = [(0, n // BLOCK, BLOCK // LANES)] if n >= BLOCK else []
    if n % BLOCK:
        shapes.append((n - n % BLOCK, 1, -(-(n % BLOCK) // LANES)))
    directory, payload = [], []
    for at, blocks, steps in shapes:
        part = index[at : at + blocks * steps * LANES]
        part = np.concatenate([part, np.full(blocks * steps * LANES - len(part), int(np.argmax(freq)), np.uint16)])
        states, words = _encode_blocks(np.ascontiguousarray(part.reshape(blocks, steps, LANES).transpose(1, 0, 2)), freq, cum)
        for b in range(blocks):
            begin = at + b * BLOCK
            raw = words[b].tobytes()
            own = ids[begin : begin + BLOCK].astype("<u4").tobytes()
            directory.append(struct.pack("<qi", begin, len(words[b])) + states[b].astype("<u4").tobytes() + struct.pack("<II", zlib.crc32(raw), zlib.crc32(own)))
            payload.append(raw)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    names = np.array([d or 0 for d in doc_ids], "<i8")
    head = _HEAD.pack(b"SFA1", len(doc_ids), n, len(symbols), len(directory))
    return b"".join([head, nulls.tobytes(), names.tobytes(), np.array(lengths, "<i8").tobytes(), symbols.astype("<u4").tobytes(), (freq - 1).astype("<u2").tobytes(), *directory, *payload])


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a segment; raises ValueError where a checksum fails."""
    magic, docs, n, distinct, blocks = _HEAD.unpack_from(data)
    if magic != b"SFA1":
        raise ValueError("not a segment")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    nulls, names, lengths = take("u1", docs), take("<i8", docs), take("<i8", docs)
    symbols, freq = take("<u4", distinct), take("<u2", distinct).astype(np.int64) + 1
    cum = np.cumsum(freq) - freq
    begins, sizes, states, sums = [], [], np.zeros((blocks, LANES), np.uint32), []
    for b in range(blocks):
        begin, size = struct.unpack_from("<qi", data, at)
        at += 12
        states[b] = take("<u4", LANES)
        sums.append(struct.unpack_from("<II", data, at))
        at += 8
        begins.append(begin)
        sizes.append(size)
    words = take("<u2", sum(sizes))
    first = np.cumsum([0, *sizes])
    for b in range(blocks):
        if zlib.crc32(words[first[b] : first[b + 1]].tobytes()) != sums[b][0]:
            raise ValueError(f"block {b}: its words are damaged")
    ids = np.empty(n, np.uint32)
    whole = n // BLOCK
    for low, high, steps in ((0, whole, BLOCK // LANES), (whole, blocks, -(-(n % BLOCK) // LANES))):
        if high > low:
            out = _decode_blocks(states[low:high], words, first[low:high], steps, freq, cum).reshape(-1)
            ids[low * BLOCK : min(n, high * BLOCK)] = symbols[out[: min(n, high * BLOCK) - low * BLOCK]]
    for b, begin in enumerate(begins):
        if zlib.crc32(ids[begin : begin + BLOCK].astype("<u4").tobytes()) != sums[b][1]:
            raise ValueError(f"block {b}: its ids are damaged")
    return [None if z else int(d) for z, d in zip(nulls, names, strict=True)], lengths, ids


@dataclass(frozen=True)
class Deal:
    """Where rows go: cells of doc_id (the first holds the null ids), each one's first part and number of parts.

    Small neighbouring cells share a part.  Only a cell of one doc_id, or of the
    null ids, has several; its rows are dealt by a hash of their text.
    """

    edges: np.ndarray  # least doc_id of cells 2, 3, ...; cell 1 has what is below
    first: np.ndarray
    parts: np.ndarray

    def cells(self, names: pa.Array) -> np.ndarray:
        at = np.searchsorted(self.edges, names.fill_null(0).to_numpy(zero_copy_only=False), side="right") + 1
        return np.where(names.is_null().to_numpy(zero_copy_only=False), 0, at)

    def part_of(self, names: pa.Array, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        cell = self.cells(names)
        part = self.first[cell]
        many = np.flatnonzero(self.parts[cell] > 1)
        for row in many.tolist():
            part[row] += zlib.crc32(buf[offsets[row] : offsets[row + 1]]) % int(self.parts[cell[row]])
        return part

    @property
    def total(self) -> int:
        return int(self.first[-1] + self.parts[-1])


def plan_parts(docs: DataFrame, text: str, doc_id: str, part_bytes: int) -> Deal:
    """Parts of about part_bytes of text in ascending order of doc_id, from byte sums of fine quantile cells.

    The driver holds a few numbers a part (a part is megabytes of text).
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    fine = CELLS * max(1, -(-total // part_bytes))
    probs = [k / fine for k in range(1, fine)]
    got = sorted(rows.agg(F.percentile_approx("doc_id", F.lit(probs), 10 * max(fine, 1000)).alias("b")).first()["b"] or []) if total > part_bytes else []
    heavy = {a for a, b in zip(got, got[1:], strict=False) if a == b}  # ids that fill whole cells stand alone
    edges = np.array(sorted({*got, *(x + 1 for x in heavy if x < (1 << 63) - 1)}), np.int64)
    plain = Deal(edges, np.zeros(len(edges) + 2, np.int32), np.ones(len(edges) + 2, np.int32))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(edges) + 2, np.int64)
        for batch in batches:
            np.add.at(sums, plain.cells(batch.column(0)), batch.column(1).to_numpy())
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], names=["cell", "bytes"])

    weight = np.zeros(len(edges) + 2, np.int64)
    if len(edges):
        for r in work.map_arrow(rows, weigh, "cell int, bytes long").groupBy("cell").agg(F.sum("bytes").alias("bytes")).collect():  # CELLS rows a part
            weight[r["cell"]] = r["bytes"]
    first, parts = np.zeros(len(weight), np.int32), np.ones(len(weight), np.int32)
    now, load = 0, 0
    for cell, w in enumerate(weight.tolist()):
        alone = cell == 0 or (cell > 1 and int(edges[cell - 2]) in heavy)
        if load and load + w > part_bytes:
            now, load = now + 1, 0
        first[cell] = now
        load += w
        if alone and w > part_bytes:
            parts[cell] = -(-w // part_bytes)
            now, load = now + int(parts[cell]), 0
    return Deal(edges, first, parts)


def _joined(known: list[bytes], index: np.ndarray, at: np.ndarray, kind: str) -> pa.Array:
    """Each document's ids as one binary value: those of its pieces index[at[d]:at[d + 1]], then the last of known, the end."""
    flat = np.frombuffer(b"".join(known), kind)
    sizes = np.fromiter(map(len, known), np.int64, len(known)) // flat.itemsize
    order = np.insert(index, at[1:], len(known) - 1)
    taken = sizes[order]
    ends = np.cumsum(taken)
    place = np.repeat((np.cumsum(sizes) - sizes)[order] - ends + taken, taken)
    place += np.arange(len(place))
    # A document's end stands behind its pieces and the ends of those before it.
    stops = ends[at[1:] + np.arange(len(at) - 1)] * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(np.append(0, stops)), pa.py_buffer(flat[place])]).cast(pa.binary())


def tokenize(docs: DataFrame, text: str, doc_id: str, deal: Deal, end_id: int, path: str | None) -> DataFrame:
    """part, doc_id and ids (little-endian, of 16 bits, or 32 where the vocabulary needs them) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(deal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces.model(path)
        kind = width(m.size)
        form = "<%d" + ("H" if kind == "<u2" else "I")
        memo = spans.Memo(lambda some: [struct.pack(form % len(x), *x) for x in map(m.ids, some)], most=MEMO)
        end = struct.pack(form % 1, end_id)
        for batch, buf, offsets in spans.chunks(batches, "__text"):
            starts = m.split(buf, offsets)
            distinct, index = spans.distinct_spans(buf, starts, np.append(starts[1:], len(buf)))
            made = _joined([*memo.values_of(distinct), end], index, np.searchsorted(starts, offsets), kind)
            names = batch.column(batch.schema.get_field_index("doc_id"))
            part = shared.value.part_of(names, buf, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), names, made], names=["part", "doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    return work.map_arrow(rows, run, "part int, doc_id long, ids binary")


def width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _packed(names: list[int | None], blobs: list[bytes], kind: str) -> Iterator[tuple[int, int, bytes]]:
    """Documents, ids and byte stream of a segment; two segments or more where its distinct ids overflow the table."""
    lengths = [len(b) // np.dtype(kind).itemsize for b in blobs]
    ids = np.frombuffer(b"".join(blobs), kind)
    if kind == "<u4" and len(names) > 1 and len(ids) > 1 << SCALE and len(np.unique(ids)) > 1 << SCALE:
        half = len(names) // 2
        yield from _packed(names[:half], blobs[:half], kind)
        yield from _packed(names[half:], blobs[half:], kind)
    else:
        yield len(names), len(ids), pack(names, lengths, ids)


def _segments(kind: str):
    """Rows sorted by part and doc_id to segments; a document's ids are never split between segments."""
    most = SEGMENT_IDS * np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, names, blobs, size = None, 0, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, names, blobs, size
            for docs, ids, data in _packed(names, blobs, kind):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([docs], pa.int64()), pa.array([ids], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "payload"])
                seq += 1
            names, blobs, size = [], [], 0

        for batch in batches:
            for p, d, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                b = b.as_py()
                if names and (p != part or size + len(b) > most):
                    yield from flush()
                if p != part:
                    part, seq = p, 0
                names.append(d)
                blobs.append(b)
                size += len(b)
        if names:
            yield from flush()

    return run


def write_store(docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 0, path: str | None = None, part_bytes: int = PART_BYTES) -> None:
    """Encodes every text, appends end_id, and writes the segments in ascending doc_id order.

    Null texts give end_id alone; rows without doc_id come first; rows of one
    doc_id stay next to each other, in parts of their own if they are many.  One
    shuffle, of the ids, brings every part, of about part_bytes of text, to a
    task of its own, so tasks keep their size as the input grows.
    """
    deal = plan_parts(docs, text, doc_id, part_bytes)
    rows = tokenize(docs, text, doc_id, deal, end_id, path)
    dealt = rows.repartitionById(deal.total, F.col("part")).sortWithinPartitions("part", "doc_id")
    work.map_arrow(dealt, _segments(width(pieces.model(path).size)), SEGMENT).write.parquet(folder)


def read_store(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.

    Segments decode in parallel; only one count a part meets in one place.
    """
    store = spark.read.schema(SEGMENT).parquet(folder)
    counts = store.select("part", "seq", "n_ids")
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier("part")), F.lit(0)).alias("before"))
    within = counts.select("part", "seq", F.coalesce(F.sum("n_ids").over(earlier("part", "seq")), F.lit(0)).alias("within"))
    base = within.join(parts, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("base"))
    small = counts.count() <= BROADCAST_SEGMENTS
    rows = store.select("part", "seq", "payload").join(F.broadcast(base) if small else base, ["part", "seq"]).select("base", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, lengths, ids = unpack(data.as_py())
                ends = np.cumsum(lengths)
                words = ids.astype("<u4")
                crcs = [zlib.crc32(words[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                made = [pa.array(names, pa.int64()), pa.array(ends - lengths + base, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    made.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(made)])

    return work.map_arrow(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
