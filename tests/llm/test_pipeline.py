"""The whole pipeline against a plain version of each stage, on a small corpus."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import ecoc_lang, quality_rules


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    parts = {"en": ["the", "ing", "and", "tion", "er", "on"], "de": ["sch", "und", "lich", "ung", "ein", "ge"]}
    make = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows, bench = [], [(i, make("en", 20)) for i in range(3)]
    for i in range(120):
        k = rng.choice(["en", "de"])
        t = make(k, rng.randint(60, 140))
        rows.append((t, k))
        if i % 5 == 0:
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            rows.append((" ".join(w), k))
        if i % 9 == 0:
            rows.append((t + " " + bench[i % 3][1], k))
    rows += [(None, "en"), ("", None), ("12 " * 80, "en"), ("the " * 200, "en"), (rows[0][0], "en"), (make("en", 80).replace(" ", " ### "), "en"), ("short one", "en")]
    where = tmp_path_factory.mktemp("sf")
    docs = [(i, t, k, "src" + str(i % 2), len(t or "")) for i, (t, k) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), docs, bench


def test_pipeline(spark, folder):
    where, docs, bench = folder
    rows = [d for d in docs if d[1] and re.search(r"[^\W\d_]", d[1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in quality_rules.apply(frame).where("kept").collect()}
    rows = [d for d in rows if d[0] in kept]
    sets = {}
    for i, t, *_ in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    rows = [d for d in rows if root(d[0]) == d[0]]
    assert len(rows) < len(kept)
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())
    grams = {tuple(words(t)[k : k + 13]) for _, t in bench for k in range(len(words(t)) - 12)}
    clean = []
    for d in rows:
        w = words(d[1])
        hit = {k + j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in grams for j in range(13)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(d)
    assert 0 < len(clean) < len(rows)
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, where).collect()}
    assert got == {d[0]: hashlib.sha256(d[1].encode()).hexdigest() for d in clean}


def test_dedup_compares_rows_whatever_their_id(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcd"}
    rows = [(7, text["a"]), (7, text["a"]), (None, text["a"] + " more"), (None, text["b"]), (None, text["b"]), (3, text["c"]), (3, text["d"]), (9, text["d"]), (2, text["d"] + " more")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(7, text["a"]), (None, text["b"]), (3, text["c"]), (2, text["d"] + " more")], key=str)


def test_language_id_without_labels_and_with_ambiguous_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the thing and the nation", "en"), (2, "schule und lichtung", "de"), (3, "\u4f60\u597d", None), (4, "12 34", None), (5, "", None), (6, None, None)]
    named = spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], kind)
    bare = named.withColumn("lang", F.lit(None).cast("string"))
    for df in (named, bare):
        assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, df, "").collect()} == {1, 2, 3}
    alike = named.where("doc_id < 3").withColumn("text", F.lit("the same words"))
    flags = ecoc_lang.predict(alike, ecoc_lang.fit(alike)).collect()
    assert all(r["ambiguous"] for r in flags) and corpus_pipeline.language_id(spark, alike, "").count() == 2
