"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, chat, html, language, lines, manifest, minhash, mix, packing, pii, quality, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op2_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op4_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op5_html(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_chat(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_quality(spark, sf_dir):
    return quality.assess(table(spark, sf_dir, "documents"))


def op9_lines(spark, sf_dir):
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_deleted")


def op10_vectors(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_manifest(spark, sf_dir):
    return manifest.audit(table(spark, sf_dir, "documents"))


def op12_align(spark, sf_dir):
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_mix(spark, sf_dir):
    return mix.report(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_pii, op2_bpe, op3_language, op4_minhash, op5_html, op6_packing, op7_chat, op8_quality, op9_lines, op10_vectors, op11_manifest, op12_align, op13_mix)}


def oracle_sql():
    return {"op4_minhash": minhash.SQL, "op8_quality": quality.SQL, "op10_vectors": vectors.SQL, "op11_manifest": manifest.SQL, "op13_mix": mix.SQL}
