"""The subpackage's registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from psephos.llm import (
    chat, contamination, embedding_duplicates, line_quality, merkle_manifest, near_duplicates, pii, quality_classifier, sentencepiece_codec, source_divergence, substrings, token_shards,
    toxicity,
)
from psephos.llm.common import documents
from psephos.llm.oracles import SQL


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.line_quality(documents(spark, sf_dir))


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.codec_report(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_report(documents(spark, sf_dir))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.token_shards(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    rows = chat.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.chat_report(chat.format_conversations(rows, tokenizer), tokenizer)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(documents(spark, sf_dir))


def op11_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_line_quality": op2_line_quality,
    "op3_contamination": op3_contamination,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_substrings": op6_substrings,
    "op7_token_shards": op7_token_shards,
    "op8_chat": op8_chat,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_embedding_duplicates": op11_embedding_duplicates,
    "op12_source_divergence": op12_source_divergence,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
