"""Quality rules with host-level verdicts, in DataFrame expressions alone.

Each document is measured inside its row.  Rule failures are then summed by
host, the hosts' failure rates are shrunk towards an empirical beta prior, and
the verdict on a host is joined back to its documents.  Only a few numbers a
document are written and shuffled; texts are read once and never moved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.columns import materialized, text_key

# White space between words, and symbols.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
REPEAT_PERCENT = 50


@dataclass(frozen=True)
class HostRules:
    """A host whose shrunk failure rate is over ``max_rate`` is held to the
    stricter limits: its documents that fail one of them go.  ``weighted``: a
    document that is k times over a limit goes on any host whose rate is over
    ``max_rate / k``, so the worse it is the less its host has to say.

    ``symbol_percent``: symbols in a hundred words; ``dup_line_percent``: lines
    that repeat an earlier one; ``strict_repeat_percent``: words in repeated
    windows; ``word_chars``: mean length of a word."""

    max_rate: float = 0.5
    symbol_percent: int = 30
    dup_line_percent: int = 30
    strict_repeat_percent: int = 30
    word_chars: tuple[int, int] = (2, 15)
    weighted: bool = True


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row a document with its counts.

    Null texts count as empty, of no words.  Lines without a word are no lines.
    ``n_repeat_words`` are the words of all three-word windows found twice or
    more in the text, overlapping windows counting a word once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    frame = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text_key().alias("text_key"),
        F.col(host).cast("string").alias("host"),
        F.when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, SPACE))
        .alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)).alias("lines"),
        (F.size(F.split(text, SYMBOLS, -1)) - 1).cast("bigint").alias("n_symbols"),
    )
    frame = frame.select(
        "doc_id",
        "text_key",
        "host",
        "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    frame = frame.withColumn(
        "_w",
        F.transform(
            F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0))),
            lambda h, i: F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2)),
        ),
    ).drop("_h")
    frame = frame.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_w")) < F.size("_w"),
            F.sort_array(
                F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            ),
        ),
    ).drop("_w")
    frame = frame.withColumn(
        "_p",
        F.sort_array(
            F.transform(
                F.filter(
                    "_s",
                    lambda x, i: (F.get("_s", i - 1)["h"] == x["h"])
                    | (F.get("_s", i + 1)["h"] == x["h"]),
                ),
                lambda x: x["i"],
            )
        ),
    ).drop("_s")
    covered = F.aggregate(
        F.transform(
            "_p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - x, F.lit(3)))
        ),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    return frame.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop(
        "_p"
    )


def base_failure() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )


def strict_failure(rules: HostRules) -> Column:
    n = F.col("n_words")
    return (
        base_failure()
        | (100 * F.col("n_symbols") > rules.symbol_percent * n)
        | (100 * F.col("n_dup_lines") > rules.dup_line_percent * F.col("n_lines"))
        | (100 * F.col("n_repeat_words") > rules.strict_repeat_percent * n)
        | (F.col("word_chars") < rules.word_chars[0] * n)
        | (F.col("word_chars") > rules.word_chars[1] * n)
    )


def excess(rules: HostRules) -> Column:
    """How many times over its worst strict limit a document is; over 1 where it
    fails one.  Only for documents with words."""
    n = F.col("n_words")
    return F.greatest(
        100 * F.col("n_symbols") / (rules.symbol_percent * n),
        100 * F.col("n_dup_lines") / (rules.dup_line_percent * F.col("n_lines")),
        100 * F.col("n_repeat_words") / (rules.strict_repeat_percent * n),
        rules.word_chars[0] * n / F.col("word_chars"),
        F.col("word_chars") / (rules.word_chars[1] * n),
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Prior counts of failures and passes by the method of moments over the
    hosts' rates; one row comes to the driver.  Hosts without spread, or none,
    give a prior as heavy as one document at the mean."""
    row = hosts.agg(
        F.avg(F.col("failed") / F.col("docs")).alias("m"),
        F.var_pop(F.col("failed") / F.col("docs")).alias("v"),
    ).first()
    mean, spread = row["m"] or 0.0, row["v"] or 0.0
    weight = mean * (1 - mean) / spread - 1 if spread > 0 else 1.0
    weight = min(max(weight, 1.0), 1e6)
    return mean * weight, (1 - mean) * weight


def host_verdicts(features: DataFrame, rules: HostRules) -> DataFrame:
    """One row a host: documents, failures, shrunk rate and verdict.  Counts are
    combined before the shuffle, so a host with most rows is no hot key.  A null
    host is a host of its own."""
    hosts = features.groupBy("host").agg(
        F.count("*").alias("docs"), F.sum(F.col("strict_failed").cast("bigint")).alias("failed")
    )
    hosts = materialized(hosts)
    a, b = beta_prior(hosts)
    rate = (F.col("failed") + F.lit(a)) / (F.col("docs") + F.lit(a + b))
    return hosts.select(
        F.col("host").alias("_host"),
        "docs",
        "failed",
        rate.alias("host_rate"),
        (rate > rules.max_rate).alias("host_failed"),
    )


def quality_verdicts(
    docs: DataFrame, host: str = "source", rules: HostRules | None = None
) -> DataFrame:
    """One row a document: counts, ``base_failed``, ``strict_failed``, ``host_rate``, ``host_failed`` and
    ``kept``.

    A document goes when it fails a base rule, or when it fails a strict rule
    and its host's shrunk rate, weighted by its own excess unless the rules say
    otherwise, is too high; a good document of a bad host stays.  An empty
    table gives an empty result.
    """
    rules = rules or HostRules()
    features = materialized(
        measured(docs, host).select(
            "*",
            base_failure().alias("base_failed"),
            strict_failure(rules).alias("strict_failed"),
        )
    )
    verdicts = host_verdicts(features, rules).select("_host", "host_rate", "host_failed")
    joined = features.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    too_bad = F.col("host_failed")
    if rules.weighted:
        # Documents without words fail a base rule.
        over = F.when(~F.col("base_failed"), excess(rules) * F.col("host_rate") > rules.max_rate)
        too_bad = too_bad | F.coalesce(over, F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~(too_bad & F.col("strict_failed")))


def rejected_removed(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    from tablewright.llm.columns import rejoined

    verdicts = quality_verdicts(docs).where("kept").select("doc_id", "text_key").distinct()
    return rejoined(docs, verdicts, "inner").select("row.*")
