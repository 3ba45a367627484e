"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from decklore.llm import bpe, exact, idstore, jaccard, mixing, quality, secrets, sharding, sql, substring, toxicity
from decklore.llm.common import documents, shared_dir


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(documents(spark, sf_dir), keep_text=False)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/decklore-{spark.sparkContext.applicationId}/ids-{uuid.uuid4().hex}"
    idstore.write_ids(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return idstore.read_ids(spark, path, documents(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_substring_dedup,
        op3_sharding,
        op4_exact_dedup,
        op5_bpe,
        op6_toxicity,
        op7_jaccard_join,
        op8_token_files,
        op9_secret_scan,
        op10_mixing,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": sql.SUBSTRINGS,
    "op7_jaccard_join": sql.JACCARD,
    "op9_secret_scan": sql.SECRETS,
    "op3_sharding": sharding.SHARD_SQL.format(limit=sharding.SHARD_BYTES),
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op10_mixing": mixing.MIX_SQL.format(blocks=mixing.BLOCKS, target=mixing.TARGET_ENTROPY, steps=mixing.STEPS),
}
