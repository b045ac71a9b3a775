"""Corpus pipeline: documents become packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared scratch folder and hands the table to the next.
All but the last return the columns of ``documents``.  Null texts and texts
without letters go in the first stage, and documents whose words are all repeats in
the second; documents with null ids are never near duplicates; ties are broken
by id (the smallest stays); repeated rows are copies like others; texts of any
length are read whole; extra columns pass through whatever their names; empty
tables pass through all stages.  ``report`` counts what each stage removed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklode.llm import language, lines, minhash, packing, pii
from tracklode.llm.common import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return language.accept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are deleted; documents whose words all stood elsewhere before go."""
    count = "__deleted"
    while count in map(str.lower, docs.columns):
        count += "_"
    left = lines.dedup(docs, count_col=count).filter((F.col(count) == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    return left.drop(count).withColumn("n_chars", F.length("text").cast("bigint"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    kept = minhash.near_duplicates(docs, width=5).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("pii_redaction", pii_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: Naive Bayes scores and tokens are not SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def report(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, int, int]]:
    """(stage, rows in, rows out, characters removed) of the stages before packing."""
    docs, made = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    measure = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    before = measure(docs)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        after = measure(docs)
        made.append((name, before[0], after[0], before[1] - after[1]))
        before = after
    return made


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
