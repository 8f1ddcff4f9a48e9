"""Quality rules with thresholds that adapt to each language and source.

Every document gets a few rates in basis points.  Their distribution in each
(lang, source), over the documents that pass the base rule, is held in a
mergeable quantile sketch: a log-linear histogram that keeps the six leading
bits of a value, so a quantile is off by less than 1 in 32, counters merge by
addition, and the result does not depend on order or retries.  Sketches of the
groups add up to those of the languages and of the corpus.

Quantiles of a group are drawn towards those of its language as if `PRIOR`
documents of the language were among the group's, and those of a language
towards the corpus likewise.  A rule's fence in a group is

    q50 + SPREAD * spread, spread: the larger of q50 - q10 and
        q90 - q50 held within half and twice the language's q90 - q50

and at least one event in a document of the group's median size, below which
its rates cannot be told from zero.  So a source with much junk neither lifts
its own fence far nor can a uniform one push it to nothing.  A document fails a
rule where its count of events lies above the fence by more than `SURE`
standard deviations of such a count: a few events in a short text prove nothing.

DataFrame functions only.  Defined results: a null text has no words and fails
the base rule; null lang or source form groups of their own; rows repeat as
often as they come; an empty table gives an empty result; texts of any length
count in full; a group without a document that passes the base rule has no
fence and needs none.  Three-word windows are compared by 64-bit hash within
one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import work

#: Rule, its count, what that is counted among, and events of a kind that come together (a repeated window has three words).
RULES = (("symbol", "n_symbols", "word_chars", 1), ("dup_line", "n_dup_lines", "n_lines", 1), ("repeat", "n_repeat_words", "n_words", 3), ("upper", "n_upper", "word_chars", 1))
SIZES = ("word_chars", "n_lines", "n_words")
SPREAD, SURE, PRIOR = 3, 4, 100
#: (lang, source) groups up to which the thresholds are broadcast: about 100 bytes each.
BROADCAST_GROUPS = 100_000

_STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_repeat_words")
_WORD = r"[^\x20\x09-\x0D]"


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts named in _STATS (long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    blank = F.translate(body, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(_WORD))
    a = docs.withColumns(
        {
            "__words": F.regexp_extract_all(body, F.lit(_WORD + "+"), F.lit(0)),
            "word_chars": F.length(blank).cast("long"),
            "n_symbols": (F.length(blank) - F.length(F.translate(blank, "#*$%&|<>", ""))).cast("long"),
            "n_upper": (F.length(blank) - F.length(F.regexp_replace(blank, r"\p{Lu}+", ""))).cast("long"),
            "__lines": lines,
        }
    )
    n = F.size("__words")
    triple = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.struct(F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)).alias("h"), i.alias("i")),
    )
    b = a.withColumns(
        {
            "n_words": n.cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__windows": F.when(n >= 4, F.sort_array(triple)),
        }
    ).drop("__words", "__lines")
    h = lambda i: F.get("__windows", i)["h"]
    again = F.filter("__windows", lambda x, k: (x["h"] == F.coalesce(h(k - 1), F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(h(k + 1), F.bitwise_not(x["h"]))))
    c = b.withColumn("__at", F.array_sort(F.transform(again, lambda x: x["i"]))).drop("__windows")
    covered = F.aggregate(
        "__at",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    return c.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__at")


def _rate(n: str, of: str) -> Column:
    return F.expr(f"{n} * 10000 div greatest({of}, 1)")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bucket(v: str) -> Column:
    """The least value of v's bucket: v with all but its six leading bits cleared."""
    return F.expr(f"shiftleft(shiftright({v}, greatest(length(bin({v})) - 6, 0)), greatest(length(bin({v})) - 6, 0))")


def sketches(stats: DataFrame) -> DataFrame:
    """lang, source, rule (or the name of a size), bucket, n: one counter per bucket, of documents that pass the base rule.

    Sketches merge by adding n.  stats: written to a table, or the filter would be merged into the counting expressions.
    """
    values = [F.struct(F.lit(r).alias("rule"), _rate(n, of).alias("v")) for r, n, of, _ in RULES] + [F.struct(F.lit(c).alias("rule"), F.col(c).alias("v")) for c in SIZES]
    long = stats.where(~base_failed()).select("lang", "source", F.inline(F.array(*values)))
    return long.groupBy("lang", "source", "rule", _bucket("v").alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by, rule, n_docs, q10, q50, q90 of merged sketches."""
    merged = sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "rule")
    ranked = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "n_docs": F.sum("n").over(w)})
    q = [F.min(F.when(F.col("upto") * 100 >= F.col("n_docs") * p, F.col("bucket"))).alias(f"q{p}") for p in (10, 50, 90)]
    return ranked.groupBy(*by, "rule").agg(F.first("n_docs").alias("n_docs"), *q)


def _towards(near: str, far: str, q: str) -> Column:
    return F.expr(f"({near}.n_docs * {near}.{q} + {PRIOR} * {far}.{q}) div ({near}.n_docs + {PRIOR})").alias(q)


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and a fence in basis points for each rule; sketch: sketches(), written to a table."""
    qs = ("q10", "q50", "q90")
    every = quantiles(sketch, []).alias("e")  # one row a rule
    lang = quantiles(sketch, ["lang"]).alias("l").join(F.broadcast(every), F.expr("l.rule = e.rule")).select("l.lang", "l.rule", *[_towards("l", "e", q) for q in qs])
    own = quantiles(sketch, ["lang", "source"]).alias("o").join(lang.alias("g"), F.expr("o.lang <=> g.lang and o.rule = g.rule"))
    drawn = own.select("o.lang", "o.source", "o.rule", *[_towards("o", "g", q) for q in qs], F.expr("g.q90 - g.q50").alias("wide"))
    spread = F.expr("greatest(q50 - q10, least(greatest(q90 - q50, wide div 2), 2 * wide))")
    by = drawn.withColumn("fence", F.col("q50") + SPREAD * spread).groupBy("lang", "source")
    of = lambda name, c: F.max(F.when(F.col("rule") == name, F.col(c)))
    wide = by.agg(*[of(r, "fence").alias(f"fence_{r}") for r, *_ in RULES], *[of(c, "q50").alias(f"size_{c}") for c in SIZES])
    return wide.select("lang", "source", *[F.greatest(f"fence_{r}", F.expr(f"10000 div greatest(size_{of_what}, 1)")).alias(f"fence_{r}") for r, _, of_what, _ in RULES])


def _fails(rule: str, count: str, of: str, together: int) -> Column:
    over = F.expr(f"{count} * 10000 - {of} * fence_{rule}")
    return F.when((over > 0) & (over > 10000.0 * SURE * F.sqrt(together * F.col(count))), F.lit(rule))


def verdicts(stats: DataFrame, fences: DataFrame) -> DataFrame:
    """stats with base_failed, failed_rules (comma-joined) and kept; fences: thresholds(), written to a table."""
    right = fences.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), *[f"fence_{r}" for r, *_ in RULES])
    if fences.count() <= BROADCAST_GROUPS:
        right = F.broadcast(right)
    joined = stats.join(right, stats["lang"].eqNullSafe(F.col("__l")) & stats["source"].eqNullSafe(F.col("__s")), "left")
    failed = F.concat_ws(",", *[_fails(*rule) for rule in RULES])
    out = joined.withColumns({"base_failed": base_failed(), "failed_rules": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "")).drop("__l", "__s", *[f"fence_{r}" for r, *_ in RULES])


def report(judged: DataFrame) -> DataFrame:
    """lang, source, rule (base for the base rule), rejected: documents that each rule rejects beyond the base rule."""
    rule = F.explode(F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(F.filter(F.split("failed_rules", ","), lambda x: x != "")))
    return judged.select("lang", "source", rule.alias("rule")).groupBy("lang", "source", "rule").agg(F.count("*").alias("rejected"))


def _judged(rows: DataFrame) -> DataFrame:
    """rows (lang, source, __text and others) with counts and verdicts; texts are gone through once, counts are kept in a table."""
    stats = work.table(with_stats(rows, "__text").drop("__text"))
    return verdicts(stats, work.table(thresholds(work.table(sketches(stats)))))


def apply(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, failed_rules and kept of every row."""
    return _judged(docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("__text")))


def keep(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text, lang, source and others) that pass, with their own columns; a text is written once more beside its counts."""
    if set(docs.columns) & {*_STATS, "base_failed", "failed_rules", "kept"}:
        raise ValueError("a column would clash with the counts")
    return _judged(docs.withColumn("__text", F.col("text"))).where("kept").select(*docs.columns)


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for apply()."""
    values = [(f"'{r}'", f"{n} * 10000 // greatest({of}, 1)") for r, n, of, _ in RULES] + [(f"'{c}'", c) for c in SIZES]
    cut = "greatest(length(bin(v)) - 6, 0)::int"

    def quantile_sql(name: str, by: str) -> str:
        group = f"{by}, " if by else ""
        q = ", ".join(f"min(case when upto * 100 >= n_docs * {p} then b end) q{p}" for p in (10, 50, 90))
        return f"""{name} as (select {group}rule, any_value(n_docs) n_docs, {q}
          from (select {group}rule, b, sum(n) over (partition by {group}rule order by b) upto, sum(n) over (partition by {group}rule) n_docs
                from (select {group}rule, b, count(*) n from buckets group by {group}rule, b)) group by {group}rule)"""

    def towards(near: str, far: str) -> str:
        return ", ".join(f"(({near}.n_docs * {near}.{q} + {PRIOR} * {far}.{q}) // ({near}.n_docs + {PRIOR}))::bigint {q}" for q in ("q10", "q50", "q90"))

    over = {r: f"({n} * 10000 - {of} * f_{r})" for r, n, of, _ in RULES}
    failed = "concat_ws(',', " + ", ".join(f"case when {over[r]} > 0 and {over[r]} > {10000.0 * SURE} * sqrt({u} * {n}) then '{r}' end" for r, n, _, u in RULES) + ")"
    wide = ", ".join(f"greatest(max(case when rule = '{r}' then fence end), 10000 // greatest(max(case when rule = '{of}' then q50 end), 1)) f_{r}" for r, _, of, _ in RULES)
    space = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    return rf"""with t as (select doc_id, lang, source, coalesce(text, '') body, translate(coalesce(text, ''), {space}, '') blank from {table}),
      w as (select *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') words, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines from t),
      p as (select doc_id, words, unnest(range(1, len(words) - 1)) i from w where len(words) >= 4),
      k as (select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) c from p),
      d as (select doc_id, i, lag(i, 1, -10) over (partition by doc_id order by i) last from k where c > 1),
      rep as (select doc_id, sum(least(3, i - last)) n from d group by doc_id),
      stats as (select w.doc_id, lang, source, len(words) n_words, length(blank) word_chars, length(blank) - length(translate(blank, '#*$%&|<>', '')) n_symbols,
         length(blank) - length(regexp_replace(blank, '\p{{Lu}}+', '', 'g')) n_upper, len(lines) n_lines, len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words
         from w left join rep using (doc_id)),
      sound as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from stats),
      vals as ({" union all ".join(f"select lang, source, {r} rule, {v} v from sound where not base_failed" for r, v in values)}),
      buckets as (select lang, source, rule, (v >> {cut}) << {cut} b from vals),
      {quantile_sql("every", "")}, {quantile_sql("lng0", "lang")}, {quantile_sql("own0", "lang, source")},
      lng as (select lng0.lang, lng0.rule, {towards("lng0", "every")} from lng0 join every on lng0.rule = every.rule),
      own as (select own0.lang, own0.source, own0.rule, {towards("own0", "lng")}, lng.q90 - lng.q50 wide from own0 join lng on own0.lang is not distinct from lng.lang and own0.rule = lng.rule),
      chosen as (select *, q50 + {SPREAD} * greatest(q50 - q10, least(greatest(q90 - q50, wide // 2), 2 * wide)) fence from own),
      wide as (select lang, source, {wide} from chosen group by lang, source),
      judged as (select s.*, {failed} failed_rules from sound s left join wide on s.lang is not distinct from wide.lang and s.source is not distinct from wide.source)
    select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, base_failed, failed_rules, not base_failed and failed_rules = '' kept from judged"""
