"""The queries of this subpackage over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from roadloom.llm.common import load
from roadloom.llm.decontaminate import decontaminate
from roadloom.llm.near_dup import near_duplicates
from roadloom.llm.oracles import NEAR_DUPLICATES, PASSAGES, REPEATS
from roadloom.llm.packing import packed
from roadloom.llm.quality_rules import ORACLE as QUALITY_SQL
from roadloom.llm.quality_rules import quality
from roadloom.llm.sharding import shard
from roadloom.llm.snapshots import ORACLE as SNAPSHOT_SQL
from roadloom.llm.snapshots import collapse
from roadloom.llm.suffix_dedup import remove_repeats
from roadloom.llm.token_counts import edited_counts, mask_edits
from roadloom.llm.toxicity import toxicity
from roadloom.llm.warc import ORACLE as WARC_SQL
from roadloom.llm.warc import round_trip


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"), texts_too=False).drop("row", "kept_text")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "pages")).drop("url", "payload")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """neighbours and cosines are the evidence of each score."""
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).drop("row")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(load(spark, sf_dir, "documents"))


def op5_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(load(spark, sf_dir, "conversations"))


def op6_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(load(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), k=3, percent=85)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("items", "near_items")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after masking digit runs and mail addresses."""
    out = edited_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), mask_edits)
    return out.drop("starts", "leaves", "tree")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_snapshot_collapse": op5_snapshot_collapse,
    "op6_minimax_sharding": op6_minimax_sharding,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_token_counts": op10_token_counts,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array_dedup": REPEATS,
    "op2_warc": WARC_SQL,
    "op4_quality_rules": QUALITY_SQL,
    "op5_snapshot_collapse": SNAPSHOT_SQL,
    "op7_minhash_near_dedup": NEAR_DUPLICATES,
    "op8_benchmark_decontamination": PASSAGES,
}
