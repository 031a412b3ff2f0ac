"""The dealt operators over the given tables, one query each, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from loomwright.llm import (
    cover_anchors, decontaminate, factorization, fill_middle, language, maxent, mixing, odd_sketch, pivot_index, reply_trees, run_index, secrets, vector_codes,
)
from loomwright.llm import sql as twins
from loomwright.session import configure


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), every=True)


def op2_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorization.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.language_scores(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op5_pivot_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.top_k(_table(spark, sf_dir, "embeddings"))


def op6_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_anchors.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.remove_older(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op9_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_table(spark, sf_dir, "documents"))


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_trees.conversation_digest(_table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digest(_table(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_pigeonhole": op1_pigeonhole,
        "op2_factorization": op2_factorization,
        "op3_maxent": op3_maxent,
        "op4_mixing": op4_mixing,
        "op5_pivot_distance": op5_pivot_distance,
        "op6_cover_anchors": op6_cover_anchors,
        "op7_run_index": op7_run_index,
        "op8_secrets": op8_secrets,
        "op9_odd_sketch": op9_odd_sketch,
        "op10_segmentations": op10_segmentations,
        "op11_reply_trees": op11_reply_trees,
        "op12_vector_codes": op12_vector_codes,
        "op13_fill_middle": op13_fill_middle,
    }


def llm_sql() -> dict[str, str]:
    return {
        "op4_mixing": twins.MIXING,
        "op5_pivot_distance": twins.TOP_K,
        "op6_cover_anchors": twins.REPEATED_WORDS,
        "op7_run_index": twins.OLDER_BYTES,
        "op8_secrets": twins.SECRETS,
        "op11_reply_trees": twins.CONVERSATIONS,
        "op12_vector_codes": twins.VECTOR_CODES,
        "op13_fill_middle": twins.FILL_IN_MIDDLE,
    }
