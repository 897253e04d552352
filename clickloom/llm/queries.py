"""Catalogue of the training-data operators: each query applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.llm import (
    adaptive_rules,
    bpe_verify,
    byte_shards,
    context_tree,
    crf_toxicity,
    elias_fano,
    layout_text,
    parity_join,
    pu_quality,
    section_tokens,
    spectrum_whitening,
    string_tiling,
    turn_repair,
)
from clickloom.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return adaptive_rules.judge(_table(spark, sf_dir, "documents")).select(*cols)


def op2_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    elias_fano.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return elias_fano.read(spark, path).select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_shards.assign(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.link(_table(spark, sf_dir, "documents"))


def op5_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_text.extract(_table(spark, sf_dir, "pages"))


def op6_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens.attribute(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_bpe_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_verify.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_tiling.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(_table(spark, sf_dir, "conversations"))


def op12_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(_table(spark, sf_dir, "documents"))


def op13_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum_whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pu_quality": op1_pu_quality,
    "op2_elias_fano_ids": op2_elias_fano_ids,
    "op3_byte_shards": op3_byte_shards,
    "op4_parity_join": op4_parity_join,
    "op5_layout_text": op5_layout_text,
    "op6_section_tokens": op6_section_tokens,
    "op7_bpe_verify": op7_bpe_verify,
    "op8_crf_toxicity": op8_crf_toxicity,
    "op9_adaptive_rules": op9_adaptive_rules,
    "op10_string_tiling": op10_string_tiling,
    "op11_turn_repair": op11_turn_repair,
    "op12_context_tree": op12_context_tree,
    "op13_spectrum_whitening": op13_spectrum_whitening,
}
ORACLES: dict[str, str] = {
    "op4_parity_join": parity_join.oracle(),
    "op9_adaptive_rules": adaptive_rules.oracle(),
}
