"""The operators as registered queries over the given tables, in production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import (
    bpe,
    decontamination,
    languages,
    lexical,
    manifest,
    nearduplicates,
    passages,
    quotations,
    secrets,
    substrings,
    viterbi,
)
from tablewright.llm.columns import given
from tablewright.llm.licenses import license_scan
from tablewright.llm.quality import quality_verdicts

Query = Callable[[SparkSession, str], DataFrame]


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.conversations(given(spark, sf_dir, "conversations"))


def removed(spans: str = "spans") -> Column:
    return F.aggregate(
        spans, F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"]
    ).alias("n_removed")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substrings_removed(given(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        removed(),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = given(spark, sf_dir, "documents"), given(spark, sf_dir, "benchmark")
    return decontamination.leaks(docs, benchmark).drop("text_key")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = nearduplicates.NearSettings(percent=85, threshold=38)
    return nearduplicates.near_duplicates(given(spark, sf_dir, "documents"), settings).drop("text_key")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(given(spark, sf_dir, "documents"), path)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = viterbi.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    return viterbi.token_counts(given(spark, sf_dir, "documents"), pieces)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages_removed(given(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", removed(), F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(given(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(given(spark, sf_dir, "documents"))

    def named(kinds: tuple[str, ...]) -> Column:
        chosen = F.filter("spans", lambda s: s["kind"].isin(*kinds))
        return F.array_join(
            F.transform(
                chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
            ),
            ",",
        )

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *(number(kind).alias(f"n_{kind}") for kind in secrets.KINDS),
        F.sha2(named(secrets.KINDS[:3]), 256).alias("base_sha256"),
        named(secrets.KINDS).alias("spans"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(given(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "host_failed",
        "kept",
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = given(spark, sf_dir, "documents"), given(spark, sf_dir, "benchmark")
    return lexical.ranked_search(docs, items).drop("text_key")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.languages(given(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.checked(given(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quotation_linking": op1_quotation_linking,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_ranked_search": op11_ranked_search,
    "op12_language_id": op12_language_id,
    "op13_merkle_manifest": op13_merkle_manifest,
}
