"""The corpus pipeline: four stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import minhash, packing, quality, suffixes
from geoloom.llm.common import saved, table

#: Near copies share so many hundredths of their shingles.
NEAR_PERCENT = 80
#: Words whose ids a worker keeps: fewer than packing alone would, as the workers' memory serves all stages.
KEPT_WORDS = 150_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.filtered(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (four fifths of their 5-word shingles in common) the document with the smallest id
    stays."""
    return minhash.deduplicated(docs, percent=NEAR_PERCENT)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that occur earlier are taken out of the texts; every document stays."""
    return suffixes.deduplicated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' pieces in sequences of 1024 tokens."""
    return packing.packed(docs, packing.default_tokenizer(), kept_words=KEPT_WORDS)


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]

#: The suffix and packing stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
