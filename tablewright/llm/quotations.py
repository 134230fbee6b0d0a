"""Quotation linking: who is quoted by whom, and conversations without quotes.

Every message is parsed once, in its row: quoted lines by level, and what the
author wrote.  Quoted passages and written text meet by the hash of their
normalised form.  The original of a text is the message that wrote it first, so
originals are one row for each hash before they are joined, however often a
text is repeated.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewright.llm.columns import arrow_schema, materialized, record_batch

# A line's quote marks, and lines that only announce a quote.
MARKS = re.compile(r"[ \t]*((?:>[ \t]*)+)")
ANNOUNCES = re.compile(r".*\b(?:wrote|writes|said|schrieb|écrit|escribió)[ \t]*:[ \t]*")

# Ranks of the units that texts are compared in.
WHOLE, PARAGRAPH, LINE = 0, 1, 2
#: A single line of fewer characters, normalised, is no evidence of a quotation.
LEAST_CHARS = 12


def parsed(text: str) -> tuple[str, list[tuple[int, str]]]:
    """What the author wrote, and the quoted passages as (level, text).

    Neighbouring lines of one level are one passage.  Lines that announce the
    quote below them go with it, and so do blank lines around what is left."""
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    above = 0
    for line in text.split("\n"):
        marks = MARKS.match(line)
        level = marks.group(1).count(">") if marks else 0
        if not level:
            own.append(line)
        else:
            if above == 0 and own and ANNOUNCES.fullmatch(own[-1]):
                own.pop()
            if above != level:
                quoted.append((level, []))
            quoted[-1][1].append(line[marks.end() :])
        above = level
    body = "\n".join(own)
    return re.sub(r"\n{3,}", "\n\n", body).strip("\n"), [(n, "\n".join(p)) for n, p in quoted]


def normalised(text: str) -> str:
    """Letter and digit runs in lower case, by single spaces."""
    return " ".join(re.findall(r"\w+", text.casefold()))


def units(text: str) -> dict[bytes, int]:
    """Hashes of the text, its paragraphs and its lines, each with its best rank."""
    found: dict[bytes, int] = {}
    parts = [(WHOLE, [text]), (PARAGRAPH, re.split(r"\n[ \t]*\n", text)), (LINE, text.split("\n"))]
    for rank, pieces in parts:
        for piece in pieces:
            plain = normalised(piece)
            if plain and (rank == WHOLE or len(plain) >= LEAST_CHARS):
                found.setdefault(hashlib.blake2b(plain.encode(), digest_size=16).digest(), rank)
    return found


def parsed_messages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, body, quotes, written``: quotes have passage number, level, rank
    and hash, ``written`` the hashes of the body's units."""
    schema = (
        "conv_id bigint, turn bigint, role string, text_key bigint, body string, n_quotes bigint, "
        "quotes array<struct<passage:int,level:int,rank:int,hash:binary>>, written array<binary>"
    )
    shape = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text_key")]
            rows = []
            for *key, text in zip(*keys, batch.column("text"), strict=True):
                body, passages = parsed(text.as_py() or "")
                quotes = [
                    {"passage": n, "level": level, "rank": rank, "hash": name}
                    for n, (level, passage) in enumerate(passages)
                    for name, rank in units(passage).items()
                ]
                rows.append((*key, body, len(passages), quotes, list(units(body))))
            yield record_batch(rows, shape)

    chosen = messages.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    return (
        chosen.distinct()
        .withColumn("text_key", F.xxhash64("role", "text"))
        .mapInArrow(work, schema)
    )


def links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, text_key, n_linked, to_conv, to_turn, up``: how many passages of a
    message have an original, and the best one: of the least level, then the
    largest unit, then in the same conversation.  ``up`` is the turn of the best
    one in the same conversation, whatever others there are elsewhere.

    In its own conversation only an earlier turn is an original; elsewhere any
    message is, the least by conversation and turn.
    """
    quotes = messages.where("n_quotes > 0").select(
        "conv_id", "turn", "text_key", F.explode("quotes").alias("q")
    ).select("conv_id", "turn", "text_key", "q.*")
    written = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", F.explode("written").alias("hash")
    )
    # Only texts that somebody quotes are of interest.
    asked = materialized(quotes.select("hash").distinct())
    wanted = materialized(
        written.join(asked, "hash", "left_semi")
        .groupBy("conv_id", "hash")
        .agg(F.min("turn").alias("first"))
    )
    # The least two conversations of each text, so that one is not the quote's own.
    place = F.struct("conv_id", F.col("first").alias("turn"))
    anywhere = (
        wanted.withColumn("n", F.row_number().over(W.partitionBy("hash").orderBy("conv_id")))
        .where("n <= 2")
        .groupBy("hash")
        .agg(F.min(F.when(F.col("n") == 1, place)).alias("other"), F.min(F.when(F.col("n") == 2, place)).alias("next"))
    )
    matched = (
        quotes.join(wanted, ["conv_id", "hash"], "left")
        .withColumn("first", F.when(F.col("first") < F.col("turn"), F.col("first")))
        .join(anywhere, "hash", "left")
        .withColumn(
            "other", F.when(F.col("other.conv_id").eqNullSafe(F.col("conv_id")), F.col("next")).otherwise(F.col("other"))
        )
        .where("first IS NOT NULL OR other IS NOT NULL")
    )
    inside = F.col("first").isNotNull()
    best = F.struct(
        "level",
        "rank",
        (~inside).cast("int").alias("outside"),
        F.when(inside, F.col("conv_id")).otherwise(F.col("other.conv_id")).alias("to_conv"),
        F.when(inside, F.col("first")).otherwise(F.col("other.turn")).alias("to_turn"),
    )
    own = F.when(inside, F.struct("level", "rank", "first"))
    by_passage = matched.groupBy("conv_id", "turn", "text_key", "passage").agg(
        F.min(best).alias("b"), F.min(own).alias("own")
    )
    return by_passage.groupBy("conv_id", "turn", "text_key").agg(
        F.count("*").alias("n_linked"), F.min("b").alias("b"), F.min("own").alias("own")
    ).select(
        "conv_id", "turn", "text_key", "n_linked", "b.to_conv", "b.to_turn", F.col("own.first").alias("up")
    )


def threads(replies: DataFrame) -> DataFrame:
    """``conv_id, turn, thread, depth`` of turns that reply (``conv_id, turn, up``): the
    first message of their chain of replies and how far up it is.  A reply goes
    to an earlier turn, so chains end; each round doubles what a row has seen."""
    seen = materialized(replies.withColumn("depth", F.lit(1).cast("bigint")))
    while True:
        above = seen.select(
            F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("depth").alias("d2")
        )
        longer = seen.join(
            above, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("t")), "left"
        ).select(
            "conv_id",
            "turn",
            F.coalesce("up2", "up").alias("up"),
            (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
            F.col("t").isNotNull().alias("moved"),
        )
        longer = materialized(longer)
        seen = longer.drop("moved")
        if not longer.where("moved").limit(1).count():
            return seen.withColumnRenamed("up", "thread")


def conversations(messages: DataFrame) -> DataFrame:
    """Conversations without quotes, in order of replies: ``conv_id, thread, turn, depth, role, body,
    reply_to, n_quotes, n_linked, source_conv, source_turn``.

    A message that quotes an earlier turn replies to it (``reply_to``, of several
    the best quote's) and stands in its thread, also where a better original is
    elsewhere; any other opens a thread of its own turn.  ``source_*`` is the
    original of its best quote, in whatever conversation.  Rows are sorted by
    conversation, thread and turn, so each reply comes after what it replies
    to; the sort is by ranges of all three, so a long conversation is no single
    task's.  Repeated rows are one message; several messages of one turn share
    its thread.  Null texts have an empty body; messages without conversation
    or turn are in no thread (null) and are nobody's original.
    """
    told = materialized(parsed_messages(messages))
    linked = materialized(links(told))
    replies = linked.where("up IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("up").alias("up"))
    chains = threads(replies)
    a = linked.withColumnsRenamed({"conv_id": "_c", "turn": "_t", "text_key": "_k"})
    b = chains.withColumnsRenamed({"conv_id": "_cc", "turn": "_tt"})
    return (
        told.join(
            a,
            F.col("conv_id").eqNullSafe(F.col("_c"))
            & F.col("turn").eqNullSafe(F.col("_t"))
            & (F.col("text_key") == F.col("_k")),
            "left",
        )
        .join(b, (F.col("conv_id") == F.col("_cc")) & (F.col("turn") == F.col("_tt")), "left")
        .select(
            "conv_id",
            F.coalesce("thread", F.when(F.col("conv_id").isNotNull(), F.col("turn"))).alias("thread"),
            "turn",
            F.coalesce("depth", F.lit(0).cast("bigint")).alias("depth"),
            "role",
            "body",
            F.col("up").alias("reply_to"),
            "n_quotes",
            F.coalesce("n_linked", F.lit(0).cast("bigint")).alias("n_linked"),
            F.col("to_conv").alias("source_conv"),
            F.col("to_turn").alias("source_turn"),
        )
        .orderBy("conv_id", "thread", "turn", "role", "body")
    )
