"""Queries of this subpackage by name, with SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, brown_lm, importance, merkle, mixing, name_join, near_dedup, neighbour_vote, parity_join, quality_rules, secret_scan, sharding, toxicity_chain
from graphloom.llm.common import read


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op6_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(read(spark, sf_dir, "documents"))


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read(spark, sf_dir, "documents"))


def op2_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_documents(read(spark, sf_dir, "documents"))


def op3_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_vote.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_fast_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components_of(read(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(encoded)


def op9_merkle_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(read(spark, sf_dir, "documents"))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_chain.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_edit_distance_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_join.join_names(read(spark, sf_dir, "clients"), read(spark, sf_dir, "vendors"))


def op12_importance_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.components_of(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_sampled_splitters": op1_sampled_splitters,
        "op2_brown_classes": op2_brown_classes,
        "op3_neighbour_vote": op3_neighbour_vote,
        "op4_fast_sketch_dedup": op4_fast_sketch_dedup,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_trigram_secrets": op6_trigram_secrets,
        "op7_robust_outliers": op7_robust_outliers,
        "op8_source_schedule": op8_source_schedule,
        "op9_merkle_trees": op9_merkle_trees,
        "op10_toxicity_chain": op10_toxicity_chain,
        "op11_edit_distance_names": op11_edit_distance_names,
        "op12_importance_tries": op12_importance_tries,
        "op13_parity_join": op13_parity_join,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op6_trigram_secrets": secret_scan.oracle()}
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
