"""The training-data pipeline: toxicity, near-duplicates, decontamination, personal data, encoding, each on what is left.

Part of the subpackage ``psephos.llm`` (removed together with it).

Defined cases, in all stages: an empty table stays empty; a very long text is worked on whole; columns that a stage does not use,
whatever their names, are passed on by all stages but the last, which returns its own. Null and blank texts pass: they have
no near-duplicate, no benchmark window and no personal data (a null text stays null), and no ids at the end; only in the first stage
may they go, with all texts that know no term, if most labelled texts of that kind are toxic. Repeated rows are judged alike and all stay or
all go; rows of one id are one document for near-duplicates, and rows without an id are never one. Labels or a benchmark without
rows reject nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from psephos.llm import contamination, near_duplicates, pii, sentencepiece_codec, toxicity
from psephos.llm.common import workspace


#: Per cent of shingles that two documents share to be near-duplicates here (85 is op1's own rule).
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.keep_clean(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return near_duplicates.one_of_each_group(docs, NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text; every document stays."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document's text and the digest of what they decode to."""
    return sentencepiece_codec.encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("sentencepiece", encode),
]

#: The first and last stage are learned scores and a tokenizer, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = workspace(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
