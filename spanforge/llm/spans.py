"""Vectorised splitting and hashing of many texts at once.

A chunk of texts is one UTF-8 byte buffer with document offsets, taken from an
Arrow string column without copying.  Words and BPE pre-tokens are found with
array operations over the bytes and named by two independent 64-bit polynomial
hashes, so that each distinct piece of a chunk is handled once in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the memory of a Python worker.
CHUNK_BYTES = 3 << 19

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_MULTIPLIERS = (0x9E3779B97F4A7C15 | 3, 0xD6E8FEB86659FD93 | 3)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    h = h ^ (h >> _S33)
    h *= _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


def _byte_codes(k: int) -> np.ndarray:
    return mix(np.arange(1 + 1000 * k, 257 + 1000 * k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_CODES = tuple(_byte_codes(k) for k in range(2))


def powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(k)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        p = _MULTIPLIERS[k]
        out = []
        for m in (p, pow(p, -1, 1 << 64)):
            a = np.full(size, m, dtype=np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _POWERS[k] = (out[0], out[1])
    return have


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int = 0) -> np.ndarray:
    """64-bit hashes of buf[starts:ends], the same wherever a span stands; k picks one of two families."""
    n = len(buf)
    power, inverse = powers(k, n + 1)
    prefix = np.empty(n + 1, dtype=np.uint64)
    prefix[0] = 0
    step = _CODES[k][buf]
    step *= power[:n]
    np.cumsum(step, out=prefix[1:])
    h = prefix[ends] - prefix[starts]
    h *= inverse[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return mix(h)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]] if len(offsets) else buf[:0], offsets - (offsets[0] if len(offsets) else 0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Gives memory that is free again back to the system: a Python worker lives on and would hold it through later stages."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of the batches in runs of about `limit` bytes of text, each with its buffer and offsets."""
    release()  # what the worker's last task left
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
    release()


# Words -------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end an alphanumeric word: ASCII other than 0-9, A-Z, a-z.
_MARKS = np.ones(256, dtype=bool)
_MARKS[0x80:] = False
_MARKS[0x30:0x3A] = _MARKS[0x41:0x5B] = _MARKS[0x61:0x7B] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_spans(buf: np.ndarray, offsets: np.ndarray, alphanumeric: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of each document's first word (n + 1 values).

    Words are runs without ASCII white space, or runs of ASCII letters, digits
    and characters beyond ASCII.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~(_MARKS if alphanumeric else _SPACE)[buf]
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    cut = offsets[:-1][offsets[:-1] < n]
    first[cut] = True
    last = np.empty(n, dtype=bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[cut[cut > 0] - 1] = True
    starts = np.flatnonzero(first & inside)
    ends = np.flatnonzero(last & inside) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# Pre-tokens of byte-level BPE ----------------------------------------------

_L, _N, _O, _S = 0, 1, 2, 3
_CLASSES: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, other, white space."""
    global _CLASSES
    if _CLASSES is None:
        import regex

        table = np.full(0x110000, _O, dtype=np.uint8)
        for low in range(0, 0x110000, 0x8000):
            points = [c for c in range(low, low + 0x8000) if not 0xD800 <= c < 0xE000]
            text = "".join(map(chr, points))
            for kind, pattern in ((_L, r"\p{L}+"), (_N, r"\p{N}+"), (_S, r"\p{White_Space}+")):
                for m in regex.finditer(pattern, text):
                    table[points[m.start()] : points[m.end() - 1] + 1] = kind
        _CLASSES = table
    return _CLASSES


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    table = char_classes()
    cls = table[buf]  # right for ASCII
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = buf[lead].astype(np.int32)
        n = len(buf)
        follow = [(buf[np.minimum(lead + k, n - 1)] & 0x3F).astype(np.int32) for k in (1, 2, 3)]
        two, three = b < 0xE0, (b >= 0xE0) & (b < 0xF0)
        point = np.where(two, (b & 0x1F) << 6 | follow[0], np.where(three, (b & 0x0F) << 12 | follow[0] << 6 | follow[1], (b & 7) << 18 | follow[0] << 12 | follow[1] << 6 | follow[2]))
        kinds = table[np.minimum(point, 0x10FFFF)]
        cls[lead] = kinds
        for k, some in ((1, slice(None)), (2, ~two), (3, ~(two | three))):
            cls[np.minimum(lead[some] + k, n - 1)] = kinds[some]
    return cls


def pretoken_starts(buf: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of byte_bpe texts; cuts: where texts begin in the buffer.

    The pieces are those that the public pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    gives, derived from runs of characters of one class.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    cls = byte_classes(buf)
    text_start = np.zeros(n + 1, dtype=bool)
    text_start[cuts] = True
    text_start[[0, n]] = True
    change = np.empty(n, dtype=bool)
    change[0] = True
    np.not_equal(cls[1:], cls[:-1], out=change[1:])
    change |= text_start[:n]
    rs = np.flatnonzero(change)
    re = np.append(rs[1:], n)
    kind = cls[rs]
    mark = np.zeros(n + 1, dtype=bool)
    mark[rs] = True
    # White space: the last character goes with the next run if it is a blank.
    w = (kind == _S) & ~text_start[re]
    last = re[w] - 1
    for _ in range(3):
        last -= (buf[last] & 0xC0) == 0x80
    mark[last] = True
    mark[re[w][buf[last] == 0x20]] = False
    # Contractions: a lone apostrophe that nothing precedes in its piece.
    a = np.flatnonzero((kind == _O) & (re - rs == 1) & (buf[rs] == 0x27) & mark[rs] & ~text_start[re])
    if len(a):
        p = rs[a]
        size = re[np.minimum(a + 1, len(re) - 1)] - re[a]
        ok = kind[np.minimum(a + 1, len(kind) - 1)] == _L
        c1, c2 = buf[np.minimum(p + 1, n - 1)], buf[np.minimum(p + 2, n - 1)]
        one = ok & np.isin(c1, np.frombuffer(b"stmd", np.uint8))
        two = ok & (size >= 2) & (((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l"))))
        mark[p[one | two] + 1] = False
        mark[p[one] + 2] = True
        mark[p[two] + 3] = True
    return np.flatnonzero(mark[:n])


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct byte strings among the spans, and for each span its index in them."""
    if not len(starts):
        return [], np.zeros(0, np.int64)
    h = hash_spans(buf, starts, ends)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    again = hash_spans(buf, starts, ends, 1)
    data = buf.tobytes()
    if (again[first][inverse] != again).any():  # two strings share a hash
        ids: dict[bytes, int] = {}
        inverse = np.fromiter((ids.setdefault(data[s:e], len(ids)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
        return list(ids), inverse
    return [data[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], inverse


class Memo:
    """Values of pieces by their bytes, in two generations of `most` entries: memory is bounded and frequent pieces stay.

    make: values of a list of pieces.
    """

    def __init__(self, make, most: int = 200_000, longest: int = 64):
        self.make, self.most, self.longest = make, most, longest
        self.young: dict = {}
        self.old: dict = {}

    def values_of(self, pieces: list[bytes]) -> list:
        get = self.young.get
        out = [get(p) for p in pieces]
        missing = [i for i, v in enumerate(out) if v is None]
        old, unknown, found = self.old.get, [], []
        for i in missing:
            v = out[i] = old(pieces[i])
            (unknown if v is None else found).append(i)
        for i, v in zip(unknown, self.make([pieces[i] for i in unknown]), strict=True):
            out[i] = v
        if len(self.young) + len(missing) > self.most:
            self.old, self.young = self.young, {}
            missing = range(len(pieces))
        young, longest = self.young, self.longest
        for i in missing:
            if len(pieces[i]) <= longest:
                young[pieces[i]] = out[i]
        return out
