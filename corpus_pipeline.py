"""Documents to training sequences: five stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import op02_minhash, op05_packing, op06_language_id, op08_exact_dedup, op09_pii
from quillon.llm._common import release, stage, staged, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that score below half of what any document of the training sample does."""
    return op06_language_id.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op08_exact_dedup.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share 80 % of their shingles of five words or more; op2 alone is bound to three words and 85 %."""
    return op02_minhash.keep_representatives(docs, 80, 5)


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data and terms that disclose it go from its text."""
    return op09_pii.sanitize(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op05_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("remove_pii", remove_pii), ("packing", packing)]

#: SQL has no string kernel, sketch or tokenizer: tests/llm/test_pipeline.py holds run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), staged()
    for _, stage_of in STAGES:
        docs = stage(stage_of(spark, docs, sf_dir))
        # What a stage wrote for itself, and what it read, isn't needed once its result is written.
        release(spark, [p for p in staged()[:-1] if p not in before])
    return docs
