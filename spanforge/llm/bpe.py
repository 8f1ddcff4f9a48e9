"""Byte-level BPE by rank: whole pre-tokens through a minimal perfect hash, the rest by a heap.

Tier one is a minimal perfect hash over the vocabulary's byte strings (hash and
displace): a pre-token that is itself an entry is its own encoding, found with
two array reads and one comparison of bytes.  Tier two merges the bytes of a
miss: its parts form a doubly linked list and a heap yields the pair of lowest
rank, leftmost first, in O(n log n).

Defined results: a null text encodes as the empty text (no ids); an empty text
has no ids; texts of any length are handled in full; repeated rows each get
their own result; other columns of the input are kept beside the new ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from . import spans, work

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces that a worker remembers (in each of two generations), and bytes of text it handles at once: together they bound its memory.
MEMO, CHUNK_BYTES = 100_000, 3 << 18


class PerfectHash:
    """A minimal perfect hash of distinct byte strings to 0..n-1, by hash and displace."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        h, g = self._hashes(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        at = np.concatenate([[0], np.cumsum(sizes)])
        taken = np.zeros(n, dtype=bool)
        self.seed = np.zeros(self.buckets, dtype=np.uint64)
        self.slot_key: list[bytes] = [b""] * n
        self.slot_of = np.zeros(n, dtype=np.int64)
        single: list[int] = []
        for b in np.argsort(-sizes, kind="stable").tolist():
            if sizes[b] <= 1:
                single += [b] if sizes[b] else []
                continue
            members = order[at[b] : at[b + 1]]
            low, tries = 1, 16
            while True:  # many displacements at once
                seeds = np.arange(low, low + tries, dtype=np.uint64)
                slots = self._slots(g[members][None, :], seeds[:, None])
                ordered = np.sort(slots, axis=1)
                good = np.flatnonzero(~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
                if len(good):
                    break
                low, tries = low + tries, min(tries * 8, 1 << 14)
                if low > 1 << 26:
                    raise ValueError("no displacement found")
            slots = slots[good[0]]
            taken[slots] = True
            self.seed[b] = seeds[good[0]]
            self.slot_of[members] = slots
        free = np.flatnonzero(~taken)
        # A bucket of one takes a free slot outright; the top bit tells the two kinds apart.
        for b, slot in zip(single, free.tolist(), strict=True):
            self.seed[b] = np.uint64(slot) | np.uint64(1 << 63)
            self.slot_of[order[at[b]]] = slot
        for k, s in zip(keys, self.slot_of.tolist(), strict=True):
            self.slot_key[s] = k

    @staticmethod
    def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(keys) else ends
        buf = np.frombuffer(b"".join(keys), dtype=np.uint8)
        return spans.hash_spans(buf, starts, ends), spans.hash_spans(buf, starts, ends, 1)

    def _slots(self, g: np.ndarray, seed: np.ndarray) -> np.ndarray:
        return (spans.mix(g + seed * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, keys: list[bytes]) -> list[int]:
        """The slot of each key, -1 for strings outside the set."""
        if not keys or not self.n:
            return [-1] * len(keys)
        h, g = self._hashes(keys)
        seed = self.seed[(h % np.uint64(self.buckets)).astype(np.int64)]
        direct = seed >> np.uint64(63) == 1
        slots = np.where(direct, (seed & np.uint64((1 << 63) - 1)).astype(np.int64), self._slots(g, seed))
        own = self.slot_key
        return [s if own[s] == k else -1 for s, k in zip(slots.tolist(), keys, strict=True)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BytePairCodec:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.table = PerfectHash(list(ranks))
        self.slot_id = [ranks[k] for k in self.table.slot_key]
        self.bytes_of = {i: k for k, i in ranks.items()}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        get = ranks.get
        #: The id that two neighbouring ids merge to, for every split of every entry.
        self.pairs = {a << 20 | b: i for k, i in ranks.items() for c in range(1, len(k)) if (a := get(k[:c])) is not None and (b := get(k[c:])) is not None}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece outside the vocabulary: a heap of pairs over linked bytes."""
        of = self.byte_id
        get = self.pairs.get
        ids = [of[b] for b in piece]
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = right[i]
            a = ids[i]
            if j >= n or a < 0 or get(a << 20 | ids[j]) != r:
                continue  # one of the pair has changed since
            ids[i], ids[j] = r, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (q := get(r << 20 | ids[k])) is not None:
                    heappush(heap, q << 32 | i)
            k = left[i]
            if k >= 0 and (q := get(ids[k] << 20 | r)) is not None:
                heappush(heap, q << 32 | k)
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        ids = self.slot_id
        return [[ids[s]] if s >= 0 else self.merge(p) for s, p in zip(self.table.lookup(pieces), pieces, strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    if path not in _CODECS:
        _CODECS[path] = BytePairCodec(read_ranks(path))
    return _CODECS[path]


def _encoder(path: str | None, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or public_tokenizers.path(VOCABULARY))

        def make(pieces: list[bytes]) -> list[tuple]:
            """Per pre-token: its number of ids, their decimal text, the bytes they decode to, the ids if asked for."""
            return [(len(ids), " ".join(map(str, ids)), c.decode(ids), ids if with_ids else None) for ids in c.encode_pieces(pieces)]

        memo = spans.Memo(make, most=MEMO)
        for batch, buf, offsets in spans.chunks(batches, "__text", CHUNK_BYTES):
            starts = spans.pretoken_starts(buf, offsets)
            pieces, index = spans.distinct_spans(buf, starts, np.append(starts[1:], len(buf)))
            count, text, raw, ids = zip(*memo.values_of(pieces), strict=True) if pieces else ((), (), (), ())
            at = np.searchsorted(starts, offsets).tolist()
            total = np.concatenate([[0], np.cumsum(np.asarray(count, np.int64)[index])]) if pieces else np.zeros(1, np.int64)
            order = index.tolist()
            said, decoded, listed = [], [], []
            for a, b in zip(at, at[1:], strict=False):
                own = order[a:b]
                said.append(hashlib.sha256(" ".join([text[i] for i in own]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([raw[i] for i in own])).hexdigest())
                if with_ids:
                    listed.append([x for i in own for x in ids[i]])
            made = [pa.array(total[at[1:]] - total[at[:-1]], pa.int64()), pa.array(said, pa.string()), pa.array(decoded, pa.string())]
            made += [pa.array(listed, pa.list_(pa.int32()))] if with_ids else []
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(made)]
            keep = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if f.name != "__text"]
            yield pa.RecordBatch.from_arrays([x for _, x in keep] + made, names=[x for x, _ in keep] + names)

    return run


def encode(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Columns `keep` (default doc_id) of every document, its number of ids and digests of ids and decoded bytes.

    path: a rank file on every executor (default: the public 50k vocabulary).
    with_ids adds the ids themselves.  Work is per row: no shuffle, and a lost
    task repeats only its own rows.
    """
    keep = ["doc_id"] if keep is None else keep
    taken = {"n_tokens", "ids_sha256", "decoded_sha256", "ids"} & set(keep)
    if taken:
        raise ValueError(f"columns {sorted(taken)} would clash with the result")
    rows = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"), made])
    return work.map_arrow(rows, _encoder(path, with_ids), schema)


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Adds `decoded` (binary): the bytes that each row's ids stand for; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or public_tokenizers.path(VOCABULARY))
        for batch in batches:
            made = [c.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "decoded"])

    if "decoded" in rows.columns:
        raise ValueError("column decoded would clash with the result")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "decoded binary"])
    return work.map_arrow(rows, run, schema)
