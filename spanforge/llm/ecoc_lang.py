"""Language ID by error-correcting output codes over hashed byte trigrams.

Each language has a codeword of bits; one binary classifier per bit, a linear
log-odds model over byte trigrams of the lower-cased letters, predicts it.
Decoding sums exp(-margin) over the bits, weighted by each classifier's
separation in training, and takes the language of least loss; a small lead over
the runner-up flags the row as ambiguous.

Fitting reads a bounded sample (`train_rows` rows, expected, chosen by a hash of
the row) and keeps only trigram counts per language.  Rows without letters, and
null texts, are `und` with score 0; without any labelled row all rows are.
Texts of any length count in full; repeated rows each get their own result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans, work

BITS = 14
#: Labelled rows to fit on (expected number).
TRAIN_ROWS = 20_000
#: Classes up to which all distinct two-way splits are used as bits.
EXHAUSTIVE = 5
UNDETERMINED = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x80:] = True
_LETTER[0x61:0x7B] = True


def codewords(k: int) -> np.ndarray:
    """k rows of -1/+1; every pair differs in many bits."""
    if k <= EXHAUSTIVE:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=k - 1) if -1 in rest] if k > 1 else []
        return np.array(splits, np.int8).T.reshape(k, len(splits))
    rng = np.random.default_rng(1995)
    length, best, far = 15 * int(np.ceil(np.log2(k))), None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (k, length))
        if (np.abs(m.sum(axis=0)) == k).any():
            continue
        d = min(int((m[i] != m[j]).sum()) for i in range(k) for j in range(i))
        if d > far:
            best, far = m, d
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weight: np.ndarray  # trigram x bit, float32
    bias: np.ndarray
    slope: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of all texts and the index of each text's first one."""
    buf, offsets = spans.text_buffer(pc.utf8_lower(column))
    n = len(buf)
    if n < 3:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    b = np.where(_LETTER[buf], buf, 32).astype(np.uint32)
    t = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    ok = (b[1:-1] != 32) | (b[2:] != 32)  # not two gaps in a row
    ends = offsets[1:-1]
    for back in (1, 2):  # trigrams that would span two texts
        cut = ends - back
        ok[cut[(cut >= 0) & (cut < n - 2)]] = False
    at = np.flatnonzero(ok)
    t = t[at] * np.uint32(2654435761) >> np.uint32(32 - BITS)
    return t, np.searchsorted(at, np.minimum(offsets, n - 2))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS, key: str | Column | None = None) -> Model:
    """A model of labelled documents; key (default: text) decides by its hash whether a row is in the sample."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = labelled.count()
    if rows > train_rows:
        key = F.col(text) if key is None else key
        labelled = labelled.where(F.pmod(F.xxhash64(key, F.lit("ecoc")), F.lit(1 << 30)) < int((1 << 30) * train_rows / rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, _, _ in spans.chunks(batches, "text"):
            grams, at = _features(batch.column(0))
            names = batch.column(1).to_pylist()
            for name, a, b in zip(names, at, at[1:], strict=False):
                if name not in sums:
                    sums[name] = np.zeros(1 << BITS, np.int64)
                np.add.at(sums[name], grams[a:b], 1) if b - a < 64 else sums[name].__iadd__(np.bincount(grams[a:b], minlength=1 << BITS))
        for name, s in sums.items():
            some = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(s[some], pa.int64())], names=["lang", "gram", "n"])

    counted = work.map_arrow(labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")), count, "lang string, gram int, n long")
    got = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # at most languages x 2**BITS rows
    languages = sorted(got["lang"].unique())
    table = np.zeros((len(languages), 1 << BITS))
    for i, name in enumerate(languages):
        own = got[got["lang"] == name]
        table[i, own["gram"].to_numpy()] = own["n"].to_numpy()
    share = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * (1 << BITS))
    code = codewords(len(languages))
    bits = code.shape[1]
    weight = np.zeros((1 << BITS, bits), np.float32)
    bias, slope, trust = np.zeros(bits), np.ones(bits), np.ones(bits)
    for b in range(bits):
        plus, minus = share[code[:, b] > 0], share[code[:, b] < 0]
        weight[:, b] = np.log(plus.mean(axis=0) / minus.mean(axis=0))
        mean = share @ weight[:, b]  # each language's expected margin per trigram
        low, high = mean[code[:, b] > 0].min(), mean[code[:, b] < 0].max()
        bias[b] = (low + high) / 2
        gap = max(low - high, 1e-3)
        slope[b] = 4 / gap
        trust[b] = gap
    return Model(languages, code, weight, bias, slope, trust / trust.sum() if bits else trust)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, lead: float = 0.1) -> DataFrame:
    """Columns `keep` (default doc_id) and lang_pred, score (0 to 1), ambiguous of every row."""
    keep = ["doc_id"] if keep is None else keep
    if {"lang_pred", "score", "ambiguous"} & set(keep):
        raise ValueError("a kept column would clash with the result")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS x bits floats
    body = text if text in keep else "__text"  # a kept text travels once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], dtype=object)
        for batch, _, _ in spans.chunks(batches, body):
            column = batch.column(batch.schema.get_field_index(body)).fill_null("")
            letters = pc.match_substring_regex(column, r"\p{L}").to_numpy(zero_copy_only=False)
            rows = len(column)
            grams, at = _features(column)
            size = np.maximum(1, np.diff(at))
            loss = np.zeros((rows, len(m.languages)))
            for b in range(m.code.shape[1]):
                total = np.concatenate([[0.0], np.cumsum(m.weight[:, b][grams], dtype=np.float64)])
                margin = np.clip(((total[at[1:]] - total[at[:-1]]) / size - m.bias[b]) * m.slope[b], -6, 6)
                margin[np.diff(at) == 0] = 0
                loss += m.trust[b] * np.exp(-margin[:, None] * m.code[None, :, b])
            if m.languages:
                best = np.argmin(loss, axis=1)
                near = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
                score = 1 / near.sum(axis=1)
                two = np.sort(loss, axis=1)[:, :2]
                unsure = two[:, 1] - two[:, 0] < lead if two.shape[1] > 1 else np.zeros(rows, bool)
            else:
                best, score, unsure, letters = np.zeros(rows, np.int64), np.zeros(rows), np.ones(rows, bool), np.zeros(rows, bool)
            best = np.where(letters, best, len(m.languages))
            kept = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if f.name != "__text"]
            made = [pa.array(names[best], pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64()), pa.array(unsure | ~letters, pa.bool_())]
            yield pa.RecordBatch.from_arrays([x for _, x in kept] + made, names=[x for x, _ in kept] + ["lang_pred", "score", "ambiguous"])

    rows = docs.select(*[docs[c] for c in keep], *([] if body == text else [docs[text].alias("__text")]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"), "lang_pred string, score double, ambiguous boolean"])
    return work.map_arrow(rows, run, schema)
