"""Document operators against brute force on small fixtures."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import components, decontaminate, ecoc_lang, lattice_lm, near_dup, quality_rules, sharding, url_lists, work

SCHEMA = "doc_id long, text string, lang string, source string"


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(20, 120))) for _ in range(n)]
    rows = [None, "", " \n\t", "One", "one two three", "one two three"]
    for t in base:
        rows.append(t)
        for _ in range(rng.randint(0, 3)):
            w = t.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
    rows += [base[0]] * 20 + [base[0].upper()] * 3 + ["A" * 20_000, "É!! " * 40]
    return [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 2]) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def test_near_duplicates(docs):
    rows = corpus()
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in range(len(rows))}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    top = {x: x for e in edges for x in e}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}


def test_large_groups_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK", 7)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        if i:
            w[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = {r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_estimates_are_close(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words)]
    for changed in (5, 10, 20, 40, 600):
        other = list(words)
        for k in rng.choice(600, changed, replace=False):
            other[k] = f"z{changed}"
        texts.append(" ".join(other))
    rows = near_dup.sketch(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bands=25).orderBy("doc_id").collect()
    assert {len(r["bands"]) for r in rows} == {25}
    told = near_dup._estimates(np.array([np.frombuffer(r["signature"], np.uint8) for r in rows]))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(596)} for t in texts]
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert abs(told[a, b] - 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b])) < 15
    with pytest.raises(ValueError, match="bands"):
        near_dup.sketch(spark.range(1).selectExpr("id doc_id", "'' text"), bands=26)


def test_the_limit_of_near_duplicates_is_a_parameter(spark):
    base = [f"w{i}" for i in range(104)]
    near = base[:20] + ["x"] + base[21:80] + ["y"] + base[81:]  # 90 of 110 shingles: 0.818
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near))], "doc_id long, text string")
    for limit, n in ((85, 2), (82, 2), (81, 1), (80, 1)):
        assert near_dup.near_duplicates(df, limit=limit, bands=25).where("kept").count() == n


def test_items_without_id_and_with_names(spark):
    docs = spark.createDataFrame([(1, "A b c, d e"), (2, ""), (3, None), (4, "p q r s")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "c d e"), ("x9", "P q"), ("x10", "q R"), ("x9", "P q")], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontaminate.judge(decontaminate.scan(docs, bench)).collect()}
    assert [(got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) for i in (1, 2, 3, 4)] == [(3, 0, True), (0, 0, False), (0, 0, False), (3, 2, True)]
    assert got[4]["items_sha256"] == hashlib.sha256(b"x10,x9").hexdigest() and got[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError, match="clash"):
        decontaminate.scan(docs.withColumn("n_words", F.lit(1)), bench)


def test_shards_are_even_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 100)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 150)
    rng = random.Random(12)
    rows = [(i, "x" * int(rng.lognormvariate(6, 1)) + str(i)) for i in range(1500)] + [(2000 + i, "copy " * 50) for i in range(700)]
    loads = collections.Counter()
    placed = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    for r in placed:
        loads[r["shard"]] += r["size"]
    copies = {r["shard"] for r in placed if r["doc_id"] >= 2000}
    rest = [n for k, n in loads.items() if k not in copies] if loads[min(copies)] > sum(loads.values()) / 5 * 1.01 else list(loads.values())
    assert len(placed) == 2200 and len(copies) == 1 and max(rest) - min(rest) < 0.01 * max(rest)


def test_hot_words(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(b"w%d" % i, int(rng.paretovariate(0.7))) for i in range(3000)] + [(b"", 2)]
    counts = spark.createDataFrame(rows, "word binary, c long")
    for most in (0, 20, 500, 10_000):
        monkeypatch.setattr(lattice_lm, "HOT_WORDS", most)
        got = {bytes(r["word"]): r["c"] for r in lattice_lm.hot_words(counts).collect()}
        least = min((c for w, c in got.items() if w), default=None)
        assert b"" in got and len(got) <= most + 1
        if least is not None:
            assert got.keys() == {w for w, c in rows if c >= least} | {b""}
        assert len(got) > most // 4


def test_decontamination(spark, docs):
    rng = random.Random(3)
    rows = [(i, t) for i, t, *_ in corpus()]
    pick = [t for _, t in rows if t and len(t.split()) > 30]
    bench = [(i, " ".join(rng.choice(pick).split()[5 : 5 + rng.choice([3, 13, 20])])) for i in range(12)] + [(50, ""), (51, None), (52, "!!"), (53, "ONE-two")]
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    b = spark.createDataFrame(bench, "item_id long, text string")
    for limit in (1000, 5):  # one slice, several
        judged = decontaminate.judge(decontaminate.scan(docs.select("doc_id", "text"), b, slice_windows=limit))
        got = {r["doc_id"]: r for r in judged.collect()}
        for i, t in rows:
            w, hit, items = words(t), set(), set()
            for win, own in windows.items():
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        items |= own
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(items))
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
            assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    cut = decontaminate.remove_spans(spark.createDataFrame([(1, "a, B c d!", 4, [1, 3], [7])], "doc_id long, text string, n_words long, hit_spans array<long>, hit_items array<long>"))
    assert cut.first()["text"] == "a,  d!"
    assert decontaminate.judge(decontaminate.scan(docs.select("doc_id", "text"), b.limit(0))).where("contaminated").count() == 0


def test_language(spark):
    rng = random.Random(5)
    parts = {"en": ["the", "ing", "and", "tion"], "de": ["sch", "und", "lich", "ung"], "fr": ["eau", "é", "que", "ment"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(30)), k) for i, k in enumerate(list(parts) * 40)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "", "de"), (902, "12 !!", None)], "doc_id long, text string, lang string")
    model = ecoc_lang.fit(docs.where("doc_id % 3 <> 1 or doc_id < 3"))
    got = {r["doc_id"]: r for r in ecoc_lang.predict(docs, model).collect()}
    assert sum(got[i]["lang_pred"] == k for i, _, k in rows) >= 0.97 * len(rows)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    blank = ecoc_lang.predict(docs, ecoc_lang.fit(docs.limit(0)))
    assert {r["lang_pred"] for r in blank.collect()} == {"und"}
    code = ecoc_lang.codewords(9)
    assert min(int((code[i] != code[j]).sum()) for i in range(9) for j in range(i)) >= 10


def test_lattice(spark, docs):
    m = lattice_lm.Lattice({"▁": -1.0, "a": -2.0, "b": -2.5, "▁a": -1.5, "ab": -3.0}, [-9.0] * 256, -1.0, 2)

    def brute(text):
        if not text:
            return 1.0
        total = math.exp(sum(m.spell[x] for x in text[0].encode())) * brute(text[1:])
        return total + sum(math.exp(m.pieces[text[:k]]) * brute(text[k:]) for k in range(1, 3) if text[:k] in m.pieces and k <= len(text))

    for w in ("a", "ab", "abba", "xb"):
        assert m.word(w.encode()) == pytest.approx(math.log10(brute("▁" + w)))
    some = [w.encode() for w in ("a", "ab", "abba", "xb", "é", "a" * 39, "ab" * 60, "日本a", "\U0001f600")]
    assert lattice_lm.LatticeTable(m).words(some) == pytest.approx([m.word(w) for w in some])
    rows = corpus()
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    table = lattice_lm.LatticeTable(lattice_lm.fit_lattice(lattice_lm.count_words(docs.where(fold))))
    for hot in (200_000, 20):
        lattice_lm.HOT_WORDS = hot
        got = {r["doc_id"]: r for r in lattice_lm.score(docs, fold).collect()}
        tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t, *_ in rows}
        counts = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
        total = sum(counts.values())
        below = math.log10(total + 0.1 * (len(counts) + 1))
        for i, ws in tokens.items():
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(w in counts for w in ws), total)
            assert r["base_score"] == pytest.approx(sum(math.log10(counts.get(w, 0) + 0.1) - below for w in ws))
            total_log = sum(float(x) for x in table.words([w for w in ws if w])) + table.lattice.end / math.log(10)
            assert r["score"] == pytest.approx(total_log)
    lattice_lm.HOT_WORDS = 200_000


def test_quality(spark, docs):
    got = {r["doc_id"]: r for r in quality_rules.apply(docs).collect()}
    rows = corpus()
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + d for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\f\v")]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    kept = {r["doc_id"] for r in quality_rules.keep(docs).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}


def _levels(seed, n=300, dirt=1.0, words=150):
    """Documents of two sources that differ in every rate; source b has `dirt` times its usual rates."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    made = []
    for i in range(n):
        source = "ab"[i % 2]
        p = (0.02 if source == "a" else 0.07) * (dirt if source == "b" else 1)
        lines, line = [], []
        phrase = [word() for _ in range(3)]
        while sum(map(len, lines)) < words:
            line = [word().upper() if rng.random() < p else word() + ("#" if rng.random() < p else "") for _ in range(6)]
            if rng.random() < p:
                line[:3] = phrase
            lines.append(lines[-1] if lines and rng.random() < p else line)
        made.append((i, "\n".join(" ".join(x) for x in lines), "en", source))
    return made


def _fences(spark, rows):
    stats = work.table(quality_rules.with_stats(spark.createDataFrame(rows, SCHEMA)).drop("text"))
    return {r["source"]: r for r in quality_rules.thresholds(quality_rules.sketches(stats)).collect()}


def test_every_fence_follows_its_group(spark):
    usual, dirty = _fences(spark, _levels(1)), _fences(spark, _levels(1, dirt=2))
    for rule, *_ in quality_rules.RULES:
        name = f"fence_{rule}"
        assert usual["a"][name] < usual["b"][name] < dirty["b"][name]


def test_every_rule_rejects_what_stands_out_in_its_source(spark):
    rng = random.Random(4)
    rows = _levels(2, dirt=0.3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    many = [[word() for _ in range(6)] for _ in range(600)]
    phrase = [word() for _ in range(3)]
    odd = {
        "symbol": "\n".join(" ".join(w + "##" for w in x) for x in many),
        "dup_line": "\n".join(" ".join(x) for x in many + [["same"]] * 300),
        "repeat": "\n".join(" ".join(phrase + x[: 3 + i % 2]) for i, x in enumerate(many)),
        "upper": "\n".join(" ".join(w.upper() for w in x) for x in many),
    }
    rows += [(1000 + i, t, "en", "a") for i, t in enumerate(odd.values())]
    judged = quality_rules.apply(spark.createDataFrame(rows, SCHEMA))
    got = {r["doc_id"]: r for r in judged.collect()}
    for i, rule in enumerate(odd):
        assert rule in got[1000 + i]["failed_rules"].split(",")
    assert sum(got[i]["kept"] for i in range(300)) >= 297
    told = collections.Counter()
    for r in quality_rules.report(judged).collect():
        told[r["rule"]] += r["rejected"]
    assert told == collections.Counter(x for r in got.values() for x in (["base"] if r["base_failed"] else r["failed_rules"].split(",") if r["failed_rules"] else []))


def test_a_source_of_junk_does_not_lift_its_own_fence(spark):
    rows = _levels(3, n=700) + [(1000 + i, t, k, "c") for i, t, k, source in _levels(5, n=180) if source == "a"]
    junk = [(2000 + i, " ".join(f"x{k}q{i} ###" for k in range(90)), "en", "c") for i in range(60)]  # two fifths of c
    assert _fences(spark, rows + junk)["c"]["fence_symbol"] < 1500  # the junk has over 4000
    got = {r["doc_id"]: r["kept"] for r in quality_rules.apply(spark.createDataFrame(rows + junk, SCHEMA)).collect()}
    assert not any(got[i] for i, *_ in junk) and sum(got[i] for i, *_ in rows) >= 0.99 * len(rows)


def test_quality_against_its_sql(spark, docs, tmp_path):
    import duckdb

    rows = corpus() + [(5000 + i, *x[1:]) for i, x in enumerate(_levels(7))]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: (r["n_words"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["failed_rules"], r["kept"]) for r in quality_rules.apply(df).collect()}
    said = duckdb.sql(quality_rules.oracle(f"'{tmp_path}/d/*.parquet'")).fetchall()
    assert {x[0]: (x[1], x[4], x[5], *x[6:]) for x in said} == got
    none = spark.createDataFrame([], SCHEMA + ", n_words string")
    with pytest.raises(ValueError, match="clash"):
        quality_rules.keep(none)


def test_shards(spark, docs):
    rows = {r["doc_id"]: r for r in sharding.shard(docs, 5).collect()}
    by, slots, loads = {}, collections.defaultdict(list), collections.Counter()
    for i, t, *_ in corpus():
        r = rows[i]
        assert r["size"] == len((t or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((t or "").encode())
        assert by.setdefault(t, r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    rng = random.Random(0)
    sizes = [int(rng.lognormvariate(7, 1)) for _ in range(3000)]
    home = sharding.differencing(sizes, 8)
    sums = [sum(s for s, h in zip(sizes, home, strict=True) if h == k) for k in range(8)]
    assert max(sums) - min(sums) <= 5
    assert sharding.shard(docs.limit(0), 5).count() == 0


def test_urls(spark):
    events = spark.createDataFrame(
        [("host", "Bad.com", "add", 10), ("host", "bad.com", "remove", 20), ("host", "bad.com", "add", 20), ("host", "bad.com", "remove", 30), ("prefix", "ok.com/x/", "add", 5), ("exact", "one.org", "add", 1), ("host", "gone.net", "remove", 3), (None, "z", "add", 1)],
        "kind string, value string, action string, at int",
    )
    cases = [
        ("http://a.bad.com/q", 10, "host:bad.com"), ("http://bad.com:80/", 9, ""), ("http://www.bad.com", 19, "host:bad.com"), ("http://bad.com", 20, ""), ("http://notbad.com", 15, ""),
        ("https://ok.com/x/y?z", 6, "prefix:ok.com/x/"), ("https://ok.com/xy", 6, ""), ("https://ok.com/x/", 4, ""), ("http://one.org", 2, "exact:one.org"), ("http://a.one.org", 2, ""),
        ("http://gone.net", 9, ""), (None, 9, ""), ("no url", 9, ""), ("http://one.org", None, ""), ("http://one.org", 2, "exact:one.org"),
    ]
    df = spark.createDataFrame([(i, u, t) for i, (u, t, _) in enumerate(cases)], "id int, url string, fetched_at int")
    for limit in (1000, 0):
        url_lists.BROADCAST_VALUES = limit
        got = {r["id"]: ",".join(r["matched"]) for r in url_lists.evaluate(df, events).collect()}
        assert got == {i: m for i, (_, _, m) in enumerate(cases)}
    url_lists.BROADCAST_VALUES = 200_000
    assert url_lists.evaluate(df.limit(0), events).count() == 0


def test_odd_rows_of_near_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text), (1, text), (1, text), (5, "other words"), (5, "still others here"), (2, text + " more"), (3, None), (3, "")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(None, 36, None, True)] * 2 + [(1, 36, 1, True)] * 2 + [(2, 37, 1, False), (5, 1, 5, True), (5, 1, 5, True), (3, 0, 3, True), (3, 0, 3, True)]
    assert got == sorted(want, key=str)


def test_empty_tables(spark, tmp_path):
    from spanforge.llm import ans_store

    none = spark.createDataFrame([], SCHEMA + ", n_words string, kept int")
    assert near_dup.near_duplicates(none).count() == 0
    assert quality_rules.apply(none).count() == 0
    assert lattice_lm.score(none, F.lit(True)).count() == 0
    ans_store.write_store(none, str(tmp_path / "s"))
    assert ans_store.read_store(spark, str(tmp_path / "s")).count() == 0
