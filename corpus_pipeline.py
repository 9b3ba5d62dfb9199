"""The corpus pipeline: five stages over ``documents``, each written and read again by its caller.

Language ID rejects documents that are in no learned language, line dedup cuts
repeated chunks of lines, MinHash near-dedup keeps one document of each group,
mixing repeats or drops documents until each source has its target weight, and
packing turns what is left into windows of token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recallforge.llm import lang_id, line_dedup, mixing, near_dup, packing
from recallforge.llm.common import staged, table
from recallforge.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in a learned language; texts without letters and texts like none of them go."""
    return lang_id.keep_identified(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with repeated chunks of lines cut from their texts."""
    return line_dedup.clean_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return near_dup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 token ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: Rolling boundaries, mixtures and differencing are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name}")
    return docs
