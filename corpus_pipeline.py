"""Corpus pipeline: language ID, quality rules, near-duplicates, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import bpe, decontaminate, ecoc_lang, near_dup, quality_rules, work

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Percent of similarity from which the near-duplicate stage links, and its bands of minima.
NEAR, NEAR_BANDS = 80, 25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: those without letters or text; names the language of unlabelled ones. Fitted on its own labelled input.

    Ambiguous documents stay: a small lead tells two known languages apart
    badly, not text from junk.  Without labelled rows all with letters stay.
    """
    rows = docs.select(*COLUMNS)
    model = ecoc_lang.fit(rows)
    if not model.languages:
        return rows.where(F.col("text").rlike(r"\p{L}"))
    named = ecoc_lang.predict(rows, model, keep=list(COLUMNS))
    told = named.where(F.col("lang_pred") != ecoc_lang.UNDETERMINED)
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rule or the rules of its (lang, source) reject; null texts fail the base rule, null names are a group."""
    return quality_rules.keep(docs.select(*COLUMNS))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: the one of least doc_id; rows without one come last, equal ones in row order.

    Rows are compared one by one, whatever their doc_id: repeated rows and rows
    without doc_id take part, and two texts of one doc_id are two documents.
    """
    rows = work.table(docs.select(*COLUMNS).withColumn("__key", F.monotonically_increasing_id()))
    groups = near_dup.near_duplicates(rows, doc_id="__key", limit=NEAR, bands=NEAR_BANDS).select(F.col("doc_id").alias("__key"), "component_id")
    named = work.table(groups.join(rows.select("__key", "doc_id"), "__key"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__key"))).alias("first")
    stay = named.groupBy("component_id").agg(first).select("first.__key")
    gone = named.select("__key").join(stay, "__key", "left_anti")
    return rows.join(work.table(gone), "__key", "left_anti").select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents: of their words at least one in 20 is in a benchmark window; without words they are clean."""
    scanned = decontaminate.scan(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.judge(scanned).where(~F.col("contaminated")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of every row; a null text has no tokens."""
    return bpe.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("near_dup", dedup),
    ("decontaminate", benchmark_free),
    ("byte_bpe", encoded),
]

#: Language ID and MinHash cannot be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
