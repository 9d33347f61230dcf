"""The queries of this subpackage and, where DuckDB can tell their rows, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import op01_warc, op02_minhash, op03_token_counts, op04_sentencepiece, op05_packing, op06_language_id, op07_quality_rules, op08_exact_dedup, op09_pii
from quillon.llm import op10_license_scan as op10
from quillon.llm._common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_warc.pages_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_token_counts.token_counts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_sentencepiece.round_trip(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_packing.pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_language_id.identify(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_quality_rules.quality(table(spark, sf_dir, "documents")).drop("clean_text")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_pii.pii(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_minhash, op3_token_counts, op4_sentencepiece, op5_packing, op6_language_id, op7_quality_rules, op8_exact_dedup, op9_pii, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return SQL


SQL: dict[str, str] = {
    "op8_exact_dedup": r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, length(text) as points, sha256(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from t),
g as (select *, first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id rows between unbounded preceding and unbounded following) as keep_id,
             count(*) over (partition by text_sha256) as group_size from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
""",
}
