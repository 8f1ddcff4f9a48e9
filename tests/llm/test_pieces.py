"""Pre-tokens, BPE, token counts and the id store against the libraries."""

import base64
import hashlib
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanforge.llm import ans_store, bpe, pieces, spans, token_counts

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts():
    rng = random.Random(4)
    alphabet = list("abst  '''\n\t re ve ll d m  12½éß漢 　\x85\x1c,.!-_“”😀") + ["<|endoftext|>", "'re", "'s", " the", "tion"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    return [None, "", " ", "\n", "it's we're I'll 'since  's\n's", "x" * 30_000, "<|endoftext|><|endoftext|>", "<|endof", "text|>", "word " * 5000, *made, *made[:5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(3)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=30), max_size=5))
def test_pretokens(some):
    import pyarrow as pa
    import regex

    buf, offsets = spans.text_buffer(pa.array(some, pa.string()))
    starts = spans.pretoken_starts(buf, offsets).tolist()
    data = buf.tobytes()
    got = [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)][: len(starts)], strict=True)]
    assert got == [p.encode() for t in some for p in regex.findall(public_tokenizers.PATTERN, t)]


def test_encode_and_decode(docs):
    rows = bpe.encode(docs, with_ids=True)
    back = {r["doc_id"]: r for r in bpe.decode(rows).collect()}
    for i, t in enumerate(texts()):
        ids = ORACLE.encode_ordinary(t or "")
        r = back[i]
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert bytes(r["decoded"]) == (t or "").encode() and r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_perfect_hash_is_minimal():
    keys = list(RANKS)
    table = bpe.PerfectHash(keys)
    assert sorted(table.lookup(keys)) == list(range(len(keys)))
    assert table.lookup([b"not an entry of it", b""]) == [-1, -1]


def test_counts(docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, limit=50).collect()}
    for i, t in enumerate(texts()):
        n = len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 50)


def test_store_round_trip(spark, docs, tmp_path):
    folder = str(tmp_path / "store")
    ans_store.write_store(docs, folder, part_bytes=40_000)
    got = {r["doc_id"]: r for r in ans_store.read_store(spark, folder, with_ids=True).collect()}
    start = 0
    for i, t in enumerate(texts()):
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i]["ids"] == ids
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 65535, 65536, 65537, 200_000])
def test_segments(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n) - 1, 50256).astype(np.uint16)
    data = ans_store.pack([5, None], [n // 3, n - n // 3], ids)
    names, lengths, back = ans_store.unpack(data)
    assert names == [5, None] and lengths.tolist() == [n // 3, n - n // 3] and (back == ids).all()
    if n > 1000:
        damaged = bytearray(data)
        damaged[-10] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            ans_store.unpack(bytes(damaged))


def test_every_symbol_fits():
    ids = np.random.default_rng(0).integers(0, 50257, 300_000).astype(np.uint16)
    assert (ans_store.unpack(ans_store.pack([1], [len(ids)], ids))[2] == ids).all()


def test_special_strings_split_as_the_library_does():
    import pyarrow as pa

    m = pieces.model()
    for t in texts():
        buf, offsets = spans.text_buffer(pa.array([t or ""]))
        starts = m.split(buf, offsets).tolist()
        data = buf.tobytes()
        ids = [i for a, b in zip(starts, [*starts[1:], len(data)][: len(starts)], strict=True) for i in m.ids(data[a:b])]
        assert ids == LIBRARY.encode(t or "", add_special_tokens=False).ids


def test_store_takes_no_python_step_for_each_token(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ans_store.work, "map_arrow", lambda rows, run, schema: run)
    none = spark.createDataFrame([], "doc_id long, text string")
    run = ans_store.tokenize(none, "text", "doc_id", ans_store.plan_parts(none, "text", "doc_id", 1000), 0, None)

    def steps(n):
        said = [None, "word it's " * n, "", "x<|endoftext|>", "漢 1"]
        count = 0

        def trace(frame, event, arg):
            nonlocal count
            frame.f_trace_opcodes = True
            count += event == "opcode"
            return trace

        before = sys.gettrace()
        sys.settrace(trace)
        try:
            out = list(run(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array([4, None, 3, 2, 1]), "__text": pa.array(said)})])))
        finally:
            sys.settrace(before)
        got = [np.frombuffer(b, "<u2").tolist() for batch in out for b in batch.column(2).to_pylist()]
        assert got == [[*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0] for t in said]
        return count

    steps(1)
    assert steps(20_000) < 2 * steps(20)


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_tokens long, extra string")
    assert bpe.encode(none).count() == token_counts.token_counts(none).count() == 0
    with pytest.raises(ValueError, match="clash"):
        bpe.encode(none, keep=["doc_id", "n_tokens"])
    some = spark.createDataFrame([(1, "a b", 7, "x")], none.schema)
    assert bpe.encode(some, keep=["doc_id", "extra"]).first()["extra"] == "x"


def test_store_of_repeated_and_missing_ids(spark, tmp_path):
    rng = random.Random(8)
    some = [("".join(rng.choice("ab cd\n") for _ in range(300)), rng.choice([None, 7, 7, 7, k])) for k in range(600)]
    rows = spark.createDataFrame([(d, t) for t, d in some], "doc_id long, text string").repartition(3)
    deal = ans_store.plan_parts(rows, "text", "doc_id", 10_000)
    assert deal.parts[0] > 1 and deal.parts.max() > 5 and (deal.parts > 1).sum() == 2  # the null ids and 7
    folder = str(tmp_path / "store")
    ans_store.write_store(rows, folder, part_bytes=10_000)
    sizes = [r[0] for r in spark.read.schema(ans_store.SEGMENT).parquet(folder).groupBy("part").agg({"n_docs": "sum"}).collect()]
    assert len(sizes) > 10
    back = ans_store.read_store(spark, folder, with_ids=True).collect()
    want = sorted(((d, tuple([*LIBRARY.encode(t, add_special_tokens=False).ids, 0])) for t, d in some), key=str)
    assert sorted(((r["doc_id"], tuple(r["ids"])) for r in back), key=str) == want
    by_start = sorted(back, key=lambda r: r["start"])
    at = 0
    for r in by_start:
        assert r["start"] == at
        at += r["n_tokens"]
    names = [r["doc_id"] for r in by_start]
    assert names == sorted(names, key=lambda d: -1 if d is None else d)


def test_wide_ids_and_segments_of_many_distinct_ids():
    ids = np.arange(200_000, dtype=np.uint32) % 90_000
    cut = np.array_split(ids, 10)
    made = list(ans_store._packed(list(range(10)), [x.astype("<u4").tobytes() for x in cut], "<u4"))
    assert len(made) > 1 and sum(n for _, n, _ in made) == len(ids)
    assert (np.concatenate([ans_store.unpack(data)[2] for *_, data in made]) == ids).all()
