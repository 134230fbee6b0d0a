"""A corpus from raw documents to tokens: five stages, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.bpe import tokens
from tablewright.llm.columns import given, materialized
from tablewright.llm.decontamination import leaking_removed
from tablewright.llm.nearduplicates import one_of_each
from tablewright.llm.quality import rejected_removed
from tablewright.llm.secrets import redacted
from tablewright.sources.workspace import scratch, workspace

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return rejected_removed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return leaking_removed(docs, given(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return redacted(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the text they decode to."""
    return tokens(docs, TOKENIZER).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded"
    )


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

# Markov models, edit distances and BPE are beyond SQL; tests/llm compares each
# stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written for the next, and what
    it wrote on the way is deleted then."""
    docs = given(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark):
            docs = materialized(stage(spark, docs, sf_dir), workspace(spark))
    return docs
