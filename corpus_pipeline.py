"""The corpus pipeline: toxicity, near duplicates, repeated substrings, benchmark passages, packing.

Each stage takes the documents its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import load, stored
from roadloom.llm.decontaminate import decontaminate
from roadloom.llm.near_dup import near_duplicates
from roadloom.llm.packing import packed
from roadloom.llm.suffix_dedup import remove_repeats
from roadloom.llm.toxicity import toxicity

#: Near duplicates: words of a shingle and percent of similarity.
SHINGLE, SIMILAR = 5, 80


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic."""
    scored = toxicity(docs, load(spark, sf_dir, "labels"), carry=docs.columns, training=load(spark, sf_dir, "documents"))
    return scored.where("predicted = 0").select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates; documents without an id or words stay."""
    gone = near_duplicates(docs, k=SHINGLE, percent=SIMILAR).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings that start earlier; a character that lost a byte goes whole. Lengths follow."""
    cut = remove_repeats(docs, carry=[c for c in docs.columns if c != "text"])
    size = F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    new = {"text": F.col("kept_text"), "n_chars": size.cast(docs.schema["n_chars"].dataType) if size is not None else None}
    return cut.select(*[(new[c] if c in new else F.col(f"row.{c}")).alias(c) for c in docs.columns])


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    hit = decontaminate(docs, load(spark, sf_dir, "benchmark")).where("contaminated and doc_id is not null").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 4096."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", keep_clean),
    ("near_duplicates", keep_one_of_each_group),
    ("repeated_substrings", cut_repeats),
    ("benchmark_passages", keep_uncontaminated),
    ("packing", pack_sequences),
]

#: The stages' models, sorts and packing have no SQL form; test_pipeline_is_that_of_brute_force holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
