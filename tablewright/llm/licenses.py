"""License scan by diagonal voting, in DataFrame expressions alone.

Rolling hashes of k words of every document are joined to the positions of the
templates' k-grams.  Matches vote for (template, offset) diagonals, diagonals
that nearly touch are merged, and each span so found is verified by comparing
its words with the template's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tablewright.llm.columns import keyed, materialized

# What separates words, and the base phrases with their labels.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Letters outside ASCII whose lower case is or holds an ASCII letter.
FOLDING = "[\\u212A\\u0130]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

K = 3
# Diagonals of one template this near to each other are one span.
MERGE = 3
# Share of a template's words that a span must hold in their places.
MIN_SCORE = 0.6

# Opening notices of common licenses, by label.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification "
    "are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution license",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "lgpl": "licensed under the gnu lesser general public license",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy "
    "of this software and associated documentation files",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license",
    "reserved": "all rights reserved",
}


def lowered(text: Column) -> Column:
    """A-Z in lower case and every other character as a separator or not as before."""
    return F.when(text.rlike(FOLDING), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    spaced = F.btrim(F.regexp_replace(lowered(text), SEPARATORS, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def rolling(words: str, k: int) -> Column:
    """Hashes of all runs of ``k`` words."""
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *(F.get(words, i + j) for j in range(1, k))),
    )


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    schema = T.StructType(
        [T.StructField("label", T.StringType()), T.StructField("template", T.StringType())]
    )
    rows = spark.createDataFrame(sorted(templates.items()), schema)
    return rows.select("label", F.split("template", " ").alias("t_words"))


def places_of(phrase: str, label: str) -> Column:
    """Positions where the phrase's words follow each other, with its label; only
    texts that hold the phrase at all are looked through word by word."""
    first, *rest = phrase.split(" ")

    def place(word: Column, i: Column) -> Column:
        match = word == first
        for j, part in enumerate(rest, 1):
            match = match & (F.get("words", i + j) == part)
        return F.when(match, F.struct(i.cast("bigint").alias("at"), F.lit(label).alias("label")))

    none = F.array().cast("array<struct<at:bigint,label:string>>")
    return F.when(
        F.contains(F.col("_line"), F.lit(f" {phrase} ")),
        F.filter(F.transform("words", place), lambda x: x.isNotNull()),
    ).otherwise(none)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_words``, the places of base phrases as ``places``
    (an array of position and label) and the hashes of single words."""
    frame = keyed(docs).select("doc_id", "text_key", words_of(F.col("text")).alias("words"))
    frame = frame.withColumn("_line", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    found = F.concat(*(places_of(phrase, label) for phrase, label in PHRASES.items()))
    return frame.select(
        "doc_id",
        "text_key",
        F.size("words").cast("bigint").alias("n_words"),
        found.alias("places"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )


def template_grams(table: DataFrame, k: int) -> DataFrame:
    """``label, t_at, gram``, hashed as documents are."""
    return table.withColumn("hashes", F.transform("t_words", lambda w: F.xxhash64(w))).select(
        "label", F.posexplode(rolling("hashes", k)).alias("t_at", "gram")
    )


def votes(hashed: DataFrame, grams: DataFrame, k: int) -> DataFrame:
    """``doc_id, text_key, label, diagonal, votes``: k-grams of a document that a
    template has, counted by diagonal before anything is shuffled.  The
    templates are a few hundred rows whatever the input."""
    return (
        hashed.select("doc_id", "text_key", F.posexplode(rolling("hashes", k)).alias("at", "gram"))
        .join(F.broadcast(grams), "gram")
        .groupBy("doc_id", "text_key", "label", (F.col("at") - F.col("t_at")).alias("diagonal"))
        .agg(F.count("*").alias("votes"))
    )


def merged_diagonals(counted: DataFrame, merge: int) -> DataFrame:
    """``doc_id, text_key, label, low, high, votes``: a diagonal more than ``merge``
    after the last of its document and template opens a new span.  The windows
    are within one document."""
    pair = W.partitionBy("doc_id", "text_key", "label").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(pair)
    return (
        counted.withColumn("_opens", (step.isNull() | (step > merge)).cast("int"))
        .withColumn("_span", F.sum("_opens").over(pair))
        .groupBy("doc_id", "text_key", "label", "_span")
        .agg(
            F.min("diagonal").alias("low"),
            F.max("diagonal").alias("high"),
            F.sum("votes").alias("votes"),
        )
        .drop("_span")
    )


def verified(docs: DataFrame, found: DataFrame, table: DataFrame, min_score: float) -> DataFrame:
    """``doc_id, text_key, label, first, length, score`` of spans whose words are
    the template's, in place on one of the span's diagonals, for at least
    ``min_score`` of the template."""
    grouped = found.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("label", "low", "high")).alias("spans")
    )
    words = keyed(docs).dropDuplicates(["doc_id", "text_key"]).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "text"
    )
    opened = (
        grouped.join(words, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
        .select("doc_id", "text_key", words_of(F.col("text")).alias("words"), "spans")
        .select("doc_id", "text_key", "words", F.explode("spans").alias("s"))
        .select("doc_id", "text_key", "words", "s.label", "s.low", "s.high")
        .join(F.broadcast(table), "label")
    )
    held = F.size(
        F.filter(
            "t_words",
            lambda t, j: F.exists(
                F.sequence(F.col("low"), F.col("high")),
                lambda d: (d + j >= 0) & (F.get("words", d + j) == t),
            ),
        )
    )
    return opened.select(
        "doc_id",
        "text_key",
        "label",
        F.greatest("low", F.lit(0)).cast("bigint").alias("first"),
        (F.col("high") - F.col("low") + F.size("t_words")).cast("bigint").alias("length"),
        (held / F.size("t_words")).alias("score"),
    ).where(F.col("score") >= min_score)


def license_spans(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    k: int = K,
    merge: int = MERGE,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """Every verified place of a template in whole texts; the spans found before
    verification are written, being few, and name the texts to read again."""
    table = template_table(docs.sparkSession, templates or TEMPLATES)
    counted = votes(measured(docs), template_grams(table, k), k)
    found = materialized(merged_diagonals(counted, merge))
    return verified(docs, found, table, min_score)


def license_scan(docs: DataFrame, **settings) -> DataFrame:
    """One row a document: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score``.

    Labels are distinct, sorted and joined by commas, empty without any.  The
    score is the best share of a template held, 1 where a base phrase stands
    and 0 where nothing was found.  Null and empty texts have no words; rows
    alike in id and text get equal results; an empty table gives an empty one.
    """
    by_doc = materialized(
        license_spans(docs, **settings)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
        .withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    )
    base = measured(docs).drop("hashes")
    ats = F.transform("places", lambda x: x["at"])
    labels = F.array_distinct(F.transform("places", lambda x: x["label"]))
    none = F.array().cast("array<string>")
    return base.join(
        by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left"
    ).select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(ats).alias("first_word"),
        F.array_max(ats).alias("last_word"),
        F.array_join(F.sort_array(labels), ",").alias("base_labels"),
        F.array_join(
            F.sort_array(F.array_union(labels, F.coalesce("found", none))), ","
        ).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
