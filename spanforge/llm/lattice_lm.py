"""Subword lattice likelihood: the probability of a text summed over all its segmentations.

Pieces are those of an existing subword vocabulary; their unigram scores are
estimated from the training documents (each distinct training word is segmented
once by the vocabulary's own library, weighted by its count).  A word's
probability is the sum over every way to cut it into pieces, by a forward
recursion in log space; any character can also be spelled by its bytes.  A
document's log-probability is the sum over its words and one end token.

Word counts are gathered from the whole corpus.  In the scoring pass frequent
words (the most frequent, at most `HOT_WORDS`) are looked up in a
broadcast table; each other (document, word) pair is joined to the counts by
one shuffle, in which no key is frequent.

Defined results: a null or empty text is the end token alone; words of any
length are scored in full (bytes that are not UTF-8 as replacement characters);
rows repeat as often as they come; without training documents every token is
unknown.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans, work

VOCABULARY = "piece_bpe_32k.model"
#: Most frequent words whose counts are broadcast: about 30 bytes each.
HOT_WORDS = 200_000
#: Distinct words that a task counts in memory before it hands them on.
COUNTED_WORDS = 300_000
SMOOTHING = 0.1
_LN10 = math.log(10)
_END = "</s>"


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary), c: occurrences in all rows; the empty word counts the ends of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

        for batch, buf, offsets in spans.chunks(batches, "__text"):
            low = spans.lower_ascii(buf)
            starts, ends, _ = spans.word_spans(low, offsets)
            words, index = spans.distinct_spans(low, starts, ends)
            for w, c in zip(words, np.bincount(index, minlength=len(words)).tolist(), strict=True):
                counts[w] = counts.get(w, 0) + c
            counts[b""] = counts.get(b"", 0) + batch.num_rows
            if len(counts) > COUNTED_WORDS:
                yield handed()
                counts.clear()
        yield handed()

    return work.map_arrow(docs.select(F.col(text).alias("__text")), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class Lattice:
    """Natural-log probabilities of pieces, of the bytes, and of the end token."""

    pieces: dict[str, float]
    spell: list[float]
    end: float
    longest: int

    def word(self, word: bytes) -> float:
        """log10 of the summed probability of all segmentations of one word."""
        text = "▁" + word.decode(errors="replace")
        get, longest, spell = self.pieces.get, self.longest, self.spell
        exp, log = math.exp, math.log
        forward = [0.0]
        for j, c in enumerate(text, 1):
            ways = [forward[i] + p for i in range(j - longest if j > longest else 0, j) if (p := get(text[i:j])) is not None]
            ways.append(forward[-1] + (spell[ord(c)] if c < "\x80" else sum([spell[b] for b in c.encode()])))
            if len(ways) == 1:
                forward.append(ways[0])
            else:
                top = max(ways)
                forward.append(top + log(sum([exp(x - top) for x in ways])))
        return forward[-1] / _LN10


class LatticeTable:
    """The same recursion for many words at once, as array operations.

    Pieces of each length are found by the hash of their characters: a bit
    filter, then a sorted array; a second hash confirms, so that scores don't
    hang on a collision.
    """

    BITS = 18

    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        self.by_length = {}
        groups: dict[int, list[str]] = {}
        for p in lattice.pieces:
            groups.setdefault(len(p), []).append(p)
        for size, some in sorted(groups.items()):
            points = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).reshape(len(some), size)
            h, g = (self._prefixes(points, k)[:, -1] for k in (0, 1))
            order = np.argsort(h)
            if (h[order][1:] == h[order][:-1]).any():
                raise ValueError("two pieces share a hash")
            bits = np.zeros(1 << self.BITS, bool)
            bits[self._slot(h)] = True
            self.by_length[size] = (bits, h[order], g[order], np.array([lattice.pieces[p] for p in some])[order])

    @classmethod
    def _slot(cls, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - cls.BITS)).astype(np.int64)

    @staticmethod
    def _prefixes(points: np.ndarray, k: int) -> np.ndarray:
        """Polynomial hashes of the first 0, 1, ... characters of each row."""
        power, _ = spans.powers(k, points.shape[1] + 1)
        out = np.zeros((len(points), points.shape[1] + 1), np.uint64)
        np.cumsum(spans.mix(points.astype(np.uint64) + np.uint64(1 + k * 0x110000)) * power[: points.shape[1]], axis=1, out=out[:, 1:])
        return out

    def _scores(self, first: np.ndarray, second: np.ndarray, m: int, j: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of m rows have a piece of `size` characters that ends at j, and its log-probability."""
        bits, known, confirm, score = self.by_length[size]
        i = j - size
        h = (first[:m, j] - first[:m, i]) * spans.powers(0, j)[1][i]
        rows = np.flatnonzero(bits[self._slot(h)])
        at = np.minimum(np.searchsorted(known, h[rows]), len(known) - 1)
        g = (second[rows, j] - second[rows, i]) * spans.powers(1, j)[1][i]
        sure = (known[at] == h[rows]) & (confirm[at] == g)
        return rows[sure], score[at[sure]]

    def words(self, words: list[bytes], longest: int = 40) -> list[float]:
        """log10 of each word's probability; words over `longest` characters one by one."""
        texts = ["▁" + w.decode(errors="replace") for w in words]
        sizes = np.array([len(t) for t in texts])
        out = np.zeros(len(words))
        spell = np.array(self.lattice.spell)
        for i in np.flatnonzero(sizes > longest).tolist():
            out[i] = self.lattice.word(words[i])
        short = np.flatnonzero(sizes <= longest)
        for low in range(0, len(short), 4096):
            rows = short[low : low + 4096]
            rows = rows[np.argsort(-sizes[rows], kind="stable")]
            n = sizes[rows]
            wide = int(n[0])
            points = np.zeros((len(rows), wide), np.uint32)
            points[np.arange(wide)[None, :] < n[:, None]] = np.frombuffer("".join([texts[i] for i in rows.tolist()]).encode("utf-32-le"), np.uint32)
            first, second = self._prefixes(points, 0), self._prefixes(points, 1)
            byte = np.where(points < 128, spell[np.minimum(points, 127)], 0.0)
            wider, where = np.unique(points[points >= 128], return_inverse=True)
            byte[points >= 128] = np.array([sum(spell[b] for b in chr(c).encode()) for c in wider.tolist()])[where] if len(wider) else 0.0
            forward = np.full((len(rows), wide + 1), -np.inf)
            forward[:, 0] = 0.0
            alive = np.searchsorted(-n, -np.arange(wide + 1), side="right")  # rows of at least j characters
            for j in range(1, wide + 1):
                m = alive[j]
                total = forward[:m, j - 1] + byte[:m, j - 1]
                for size in self.by_length:
                    if size > j:
                        break
                    hit, p = self._scores(first, second, m, j, size)
                    total[hit] = np.logaddexp(total[hit], forward[hit, j - size] + p)
                forward[:m, j] = total
            out[rows] = forward[np.arange(len(rows)), n]
        out[sizes <= longest] /= _LN10
        return out.tolist()


def fit_lattice(counts: DataFrame, path: str | None = None) -> Lattice:
    """Unigram scores of the vocabulary's pieces; counts: of training words, as count_words gives them."""
    import sentencepiece

    place = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sentencepiece.SentencePieceProcessor(model_file=place)
        sums = np.zeros(m.get_piece_size(), np.int64)
        for batch in batches:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            at = [k for k, w in enumerate(words) if w]
            for low in range(0, len(at), 10_000):
                some = at[low : low + 10_000]
                ids = m.encode([words[k].decode() for k in some], num_threads=1)
                flat = np.array([x for i in ids for x in i], np.int64)
                sums += np.bincount(flat, np.repeat(c[some], [len(i) for i in ids]), minlength=len(sums)).astype(np.int64)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some], pa.int64())], names=["id", "n"])

    m = sentencepiece.SentencePieceProcessor(model_file=place)
    size = m.get_piece_size()
    n = np.zeros(size)
    for r in work.map_arrow(counts, run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        n[r["id"]] = r["n"]
    ends = counts.where(F.length("word") == 0).agg(F.sum("c")).first()[0] or 0
    usable = np.array([not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(size)])
    weight = np.where(usable, n + SMOOTHING, 0.0)
    total = weight.sum() + ends + SMOOTHING
    score = np.log(np.maximum(weight, 1e-300) / total)
    pieces, spell = {}, [0.0] * 256
    for i in range(size):
        if m.is_byte(i):
            spell[int(m.id_to_piece(i)[1:-1], 16)] = float(score[i])
        elif usable[i]:
            pieces[m.id_to_piece(i)] = float(score[i])
    return Lattice(pieces, spell, math.log((ends + SMOOTHING) / total), max(map(len, pieces)))


def hot_words(counts: DataFrame) -> DataFrame:
    """The rows of counts with the largest counts, at most HOT_WORDS and the end token; equal counts are in or out together.

    The least count is found first, from the number of words per bucket of
    counts (its six leading bits), so no more than these rows reach the driver.
    """
    low = F.expr("shiftleft(shiftright(c, greatest(length(bin(c)) - 6, 0)), greatest(length(bin(c)) - 6, 0))")
    least, seen = None, 0
    for r in counts.groupBy(low.alias("low")).agg(F.count("*").alias("n")).orderBy(F.desc("low")).collect():  # 64 rows a power of two at most
        seen += r["n"]
        if seen > HOT_WORDS:
            break
        least = r["low"]
    end = F.length("word") == 0
    return counts.where(end if least is None else end | (F.col("c") >= least))


def score(docs: DataFrame, train: Column, text: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Columns `keep` (default doc_id), held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    train: whether to learn from a row.  base_score: an add-0.1 unigram model of
    words; score: the lattice.  Both are log10 probabilities of the text.
    """
    keep = ["doc_id"] if keep is None else keep
    made = {"held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    if made & set(keep):
        raise ValueError("a kept column would clash with the result")
    spark = docs.sparkSession
    rows = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"), F.coalesce(train, F.lit(False)).alias("__train"))
    counts = work.table(count_words(rows.where("__train"), "__text"))
    lattice = spark.sparkContext.broadcast(fit_lattice(counts, path))
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    below = math.log10(tokens + SMOOTHING * (distinct + 1))
    frequent = hot_words(counts).toPandas()
    hot = spark.sparkContext.broadcast(dict(zip(map(bytes, frequent["word"]), frequent["c"].tolist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, m = hot.value, lattice.value
        ends = known.get(b"", 0)  # there are as many ends as texts: always among the frequent, unless there are none

        table = LatticeTable(m)

        def make(words: list[bytes]) -> list[tuple]:
            return [(known.get(w, 0), p) for w, p in zip(words, table.words(words), strict=True)]

        memo = spans.Memo(make, most=150_000)
        for batch, buf, offsets in spans.chunks(batches, "__text"):
            low = spans.lower_ascii(buf)
            starts, stops, at = spans.word_spans(low, offsets)
            words, index = spans.distinct_spans(low, starts, stops)
            c, logp = (np.array(x) for x in zip(*memo.values_of(words), strict=True)) if words else (np.zeros(0, np.int64), np.zeros(0))
            base = np.where(c > 0, np.log10(c + SMOOTHING), 0.0)
            size = np.diff(at)
            doc = np.repeat(np.arange(batch.num_rows), size)
            total = lambda values: np.bincount(doc, values[index], minlength=batch.num_rows) if len(words) else np.zeros(batch.num_rows)  # noqa: E731, B023
            names = batch.schema.names
            row_id = batch.column(names.index("__row"))
            kept = [batch.column(names.index(k)) for k in (*keep, "__train")]
            known_here = total((c > 0).astype(float)).astype(np.int64) + int(ends > 0)
            key = pa.array([b" %d" % r for r in row_id.to_pylist()], pa.binary())  # no word has a blank
            own = [row_id, *kept, key, pa.array(np.ones(batch.num_rows, np.int64))]
            own += [pa.array(size + 1, pa.int64()), pa.array(known_here, pa.int64()), pa.array(total(base) + math.log10(ends + SMOOTHING)), pa.array(total(logp) + m.end / _LN10)]
            yield pa.RecordBatch.from_arrays(own, names=fields)
            cold = np.flatnonzero(c[index] == 0) if words else np.zeros(0, np.int64)
            if len(cold):
                pair, times = np.unique(doc[cold] * len(words) + index[cold], return_counts=True)
                r, w = pair // len(words), pair % len(words)
                n = len(pair)
                blank = [pa.nulls(n, x.type) for x in kept]
                zero = pa.array(np.zeros(n, np.int64))
                cold_words = pa.array(words, pa.binary()).take(pa.array(w))
                yield pa.RecordBatch.from_arrays([row_id.take(pa.array(r)), *blank, cold_words, pa.array(times.astype(np.int64)), zero, zero, pa.array(np.zeros(n)), pa.array(np.zeros(n))], names=fields)

    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    fields = ["__row", *keep, "__train", "word", "times", "n_tokens", "n_known", "base", "score"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(["__row long", *(f"`{k}` {types[k]}" for k in (*keep, "__train")), "word binary, times long, n_tokens long, n_known long, base double, score double"])
    spread = work.map_arrow(rows, run, schema)
    joined = spread.join(counts, "word", "left")
    whole = F.col("n_tokens") > 0
    part = F.when(~whole, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)).otherwise(F.lit(0.0))
    found = F.when(~whole & F.col("c").isNotNull(), F.col("times")).otherwise(F.lit(0))
    out = joined.groupBy("__row").agg(
        *[F.max_by(F.col(k), F.col("n_tokens")).alias(k) for k in keep],
        F.max_by(~F.col("__train"), F.col("n_tokens")).alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(found)).alias("n_known"),
        (F.sum(F.col("base") + part)).alias("base_score"),
        F.sum("score").alias("score"),
    )
    return out.select(*keep, "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("base_score") - F.col("n_tokens") * below).alias("base_score"), "score")
