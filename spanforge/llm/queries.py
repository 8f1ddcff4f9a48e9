"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ans_store, bpe, decontaminate, ecoc_lang, lattice_lm, near_dup, quality_rules, sharding, token_counts, url_lists, work


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply(_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept")


def op2_kk_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_documents(spark, sf_dir), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(_documents(spark, sf_dir), _fold(10) != 0)


def op4_ans_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work.folder(spark)
    ans_store.write_store(_documents(spark, sf_dir), folder)
    return ans_store.read_store(spark, folder)


def _fold(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op5_ecoc_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", _fold(3) == 1)
    model = ecoc_lang.fit(docs.where(~F.col("held_out")))
    return ecoc_lang.predict(docs, model, keep=["doc_id", "held_out"])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    scanned = decontaminate.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.judge(scanned).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: The dated list that op8 evaluates: kind, value, action, day.
URL_EVENTS = (
    ("host", "casino-win.example.com", "add", "2024-02-01"),
    ("host", "casino-win.example.com", "remove", "2024-06-01"),
    ("host", "casino-win.example.com", "add", "2024-09-15"),
    ("host", "free-bets.example.com", "add", "2024-03-10"),
    ("host", "example.net", "add", "2024-05-01"),
    ("host", "example.net", "add", "2024-05-10"),
    ("host", "example.net", "remove", "2024-05-20"),
    ("host", "example.org", "remove", "2024-07-01"),
    ("exact", "blog.tionsh.example.com", "add", "2024-01-10"),
    ("exact", "blog.tionsh.example.com", "remove", "2024-08-01"),
    ("exact", "example.com", "add", "2024-01-01"),
    ("prefix", "tionble.example.org/en/", "add", "2024-04-01"),
    ("prefix", "tionble.example.org/fr/", "add", "2024-04-01"),
    ("prefix", "tionble.example.org/fr/", "remove", "2024-10-01"),
)


def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages name no fetch time: their id gives one within 2024."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 366).cast("int"))
    events = spark.createDataFrame(list(URL_EVENTS), "kind string, value string, action string, at string").withColumn("at", F.col("at").cast("date"))
    judged = url_lists.evaluate(pages.select("page_id", "url", day.alias("fetched_at")), events)
    return judged.select("page_id", "blocked", "n_matches", F.array_join("matched", ",").alias("matched"))


_OP8_SQL = rf"""
with events(kind, value, action, day) as (values {", ".join(f"('{k}', '{v}', '{a}', date '{d}')" for k, v, a, d in URL_EVENTS)}),
marked as (select *, lag(action, 1, 'remove') over (partition by kind, value order by day) was from events),
spans as (select kind, value, action, day since, lead(day, 1, date '9999-01-01') over (partition by kind, value order by day) till from marked where action <> was),
p as (select page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') h,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)) path, date '2024-01-01' + (page_id * 7919 % 366)::int t from pages),
m as (select page_id, kind || ':' || value hit from p join spans on action = 'add' and t >= since and t < till and
  case kind when 'exact' then h = value when 'host' then h = value or ends_with(h, '.' || value) else starts_with(h || path, value) and (ends_with(value, '/') or h || path = value) end)
select p.page_id, count(hit) > 0 blocked, count(hit) n_matches, coalesce(string_agg(hit, ',' order by hit), '') matched from p left join m using (page_id) group by p.page_id"""


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_kk_shards, op3_lattice_lm, op4_ans_store, op5_ecoc_lang, op6_token_counts, op7_decontaminate, op8_url_lists, op9_near_dup, op10_byte_bpe)
}

ORACLES: dict[str, str] = {"op1_quality_rules": quality_rules.oracle(), "op8_url_lists": _OP8_SQL}
