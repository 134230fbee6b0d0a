"""Dedup of repeated passages by suffix automata of reference shards.

Passages that may repeat, as their anchors tell, are dealt into shards by the
anchor.  A shard takes its passages in order of document: each is streamed
through the suffix automaton of those before it, whose matching statistics say
where a window also starts in an earlier document, and then joins the automaton
as a reference for the rest.  Every copy of a passage beyond its first document
is matched as a whole, so a passage is streamed once for all its copies.  Equal
windows have equal anchors: a passage is streamed if another document has an
earlier one under its anchor, and joins the automaton if one has a later.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewright.llm import anchors as an
from tablewright.llm import wordarrays as wa
from tablewright.llm.columns import materialized
from tablewright.sources.workspace import scratch, workspace


# Bytes of text whose words are hashed together.
CHUNK_BYTES = 1 << 18


@dataclass(frozen=True)
class PassageSettings:
    """``window``: words of a passage that may not repeat; ``gram``: words of an
    anchor; ``shard``: passages that a shard is meant to hold; ``group_size``: an
    anchor with more different passages is split by what is around it."""

    window: int = 13
    gram: int = 5
    shard: int = 2_000
    group_size: int = 10_000


class SuffixAutomaton:
    """All substrings of the passages added, over words."""

    def __init__(self, longest: int):
        self.longest = longest
        self.to: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def state(self, to: dict[bytes, int], link: int, length: int) -> int:
        self.to.append(to)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def split(self, p: int, word: bytes, q: int) -> int:
        """The state of the suffixes of ``q`` that are one word longer than ``p``."""
        clone = self.state(dict(self.to[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.to[p].get(word) == q:
            self.to[p][word] = clone
            p = self.link[p]
        return clone

    def follow(self, last: int, word: bytes) -> int:
        """The state after one more word of the passage that ``last`` ends."""
        to, length = self.to, self.length
        if (q := to[last].get(word)) is not None:
            return q if length[q] == length[last] + 1 else self.split(last, word, q)
        new = self.state({}, 0, length[last] + 1)
        p = last
        while p >= 0 and word not in to[p]:
            to[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = to[p][word]
            self.link[new] = q if length[q] == length[p] + 1 else self.split(p, word, q)
        return new

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            last = self.follow(last, word)

    def statistics(self, words: list[bytes]) -> Iterator[int]:
        """For each word the length of the longest match that ends with it, up to
        the window."""
        state = size = 0
        to, link, length, most = self.to, self.link, self.length, self.longest
        for word in words:
            while state and word not in to[state]:
                state = link[state]
                size = length[state]
            if (found := to[state].get(word)) is None:
                state = size = 0
            else:
                state, size = found, min(size + 1, most)
                # Matches beyond the window need not be told apart.
                while length[link[state]] >= size and link[state] > 0:
                    state = link[state]
            yield size


def word_anchors(settings: PassageSettings):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in wa.byte_chunks(batches, ("doc_id", "text_key"), CHUNK_BYTES):
            data, begins = wa.joined(texts)
            starts, ends = wa.word_bounds(data)
            words = wa.word_hashes(data, starts, ends)
            bounds = np.append(np.searchsorted(starts, begins), len(words)).tolist()
            whole: list[tuple] = []
            parts: list[np.ndarray] = []
            offsets: list[int] = []
            size = 0
            for row, low, high in zip(rows, bounds, bounds[1:]):
                for at in range(low, max(high - settings.window + 1, low), an.PART):
                    part = words[at : min(high, at + an.PART + settings.window - 1)]
                    if size + len(part) > 2 * an.PART:
                        yield batch_of(whole, parts, offsets)
                        whole, parts, offsets, size = [], [], [], 0
                    whole.append(row)
                    parts.append(part)
                    offsets.append(at - low)
                    size += len(part)
            if whole:
                yield batch_of(whole, parts, offsets)

    def batch_of(rows, parts, offsets):
        sizes = np.array([len(p) for p in parts])
        return an.anchor_rows(
            rows, np.concatenate(parts), sizes, np.array(offsets), settings.window, settings.gram
        )

    return work


PASSAGE = "doc_id bigint, gram bigint, segment bigint, words string"


def passages(texts: DataFrame, settings: PassageSettings) -> DataFrame:
    """The words of each class's passage, joined by spaces."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << an.FIELD) - 1
        for batch in wa.small_batches(batches):
            rows = []
            listed = zip(
                batch.column("doc_id").to_pylist(),
                batch.column("text").cast(pa.binary()).to_pylist(),
                batch.column("own").to_pylist(),
                strict=True,
            )
            for doc_id, text, own in listed:
                words = text.split()
                for row in own:
                    first = row["place"] >> (2 * an.FIELD)
                    last = first + (row["place"] & mask)
                    rows.append(
                        (doc_id, row["gram"], row["segment"], b" ".join(words[first : last + settings.window]))
                    )
            ids, grams, segments, joined = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(grams, pa.int64()),
                    pa.array(segments, pa.int64()),
                    pa.array(joined, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "gram", "segment", "words"],
            )

    return texts.mapInArrow(work, PASSAGE)


VERDICT = "gram bigint, segment bigint, offset bigint"


def streamed(shards: DataFrame, settings: PassageSettings) -> DataFrame:
    """``gram, segment, offset``: windows of a passage, by their place in it, that
    also start in a document before the passage's own."""

    def stream(table: pa.Table) -> pa.Table:
        rows = sorted(
            zip(*(table.column(c).to_pylist() for c in ("doc_id", "gram", "segment", "words")), strict=True)
        )
        least: dict[int, int] = {}
        most: dict[int, int] = {}
        for doc_id, gram, *_ in rows:
            least.setdefault(gram, doc_id)
            most[gram] = doc_id
        automaton = SuffixAutomaton(settings.window)
        found: list[tuple[int, int, int]] = []
        waiting: list[list[bytes]] = []
        current = None
        for doc_id, gram, segment, joined in rows:
            if doc_id != current:
                for words in waiting:
                    automaton.add(words)
                waiting, current = [], doc_id
            words = joined.encode().split(b" ")
            if least[gram] < doc_id:
                for at, size in enumerate(automaton.statistics(words)):
                    if size >= settings.window:
                        found.append((gram, segment, at - settings.window + 1))
            if doc_id < most[gram]:
                waiting.append(words)
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["gram", "segment", "offset"])

    return shards.groupBy("shard").applyInArrow(stream, VERDICT)


def met(classes: DataFrame) -> DataFrame:
    """Classes under whose gram first documents differ; no other can match one."""
    own = W.partitionBy("gram")
    ends = {"_least": F.min("rep.doc_id").over(own), "_most": F.max("rep.doc_id").over(own)}
    return classes.withColumns(ends).where("_least < _most").drop(*ends)


def of_parts(links: DataFrame, classes: DataFrame, parts: DataFrame, found: DataFrame) -> DataFrame:
    """``gram, segment, offset`` of passages that were cut: of each part what was found
    of it, or all its windows where its own first document comes before."""
    before = classes.select("gram", "segment", F.col("rep.doc_id").alias("reference"))
    part = ["sub_gram", "sub_segment"]
    firsts = parts.select(
        F.col("gram").alias("sub_gram"), F.col("segment").alias("sub_segment"), F.col("rep.doc_id").alias("first")
    )
    cut = links.join(before, ["gram", "segment"]).join(firsts, part)
    earlier = cut.where("first < reference").select(
        "gram", "segment", F.explode(F.sequence("shift", F.col("shift") + F.col("windows") - 1)).alias("offset")
    )
    named = found.withColumnsRenamed({"gram": "sub_gram", "segment": "sub_segment"})
    same = cut.where("first = reference").join(named, part)
    return earlier.unionByName(same.select("gram", "segment", (F.col("offset") + F.col("shift")).alias("offset")))


def repeated_passages(texts: an.Texts, settings: PassageSettings) -> DataFrame:
    """``doc_id, text_key, low, high``: words covered by windows that also start in
    a document with a smaller id."""
    named = an.Texts(*(t.where("doc_id IS NOT NULL") for t in (texts.rows, texts.distinct)))
    found = an.anchors(named, word_anchors(settings))
    members = an.repeated(found)
    classes = an.segment_classes(members)
    usual, links = an.fitting(
        named, classes, settings.group_size, bytes.split, b" ".join, settings.window, settings.gram
    )
    several = materialized(met(usual))
    shards = max(1, -(-several.count() // settings.shard))
    dealt = passages(an.with_texts(named, several), settings).withColumn(
        "shard", F.pmod(F.xxhash64("gram"), F.lit(shards))
    )
    own = materialized(streamed(dealt, settings))
    if links is not None:
        own = materialized(own.unionByName(of_parts(links, classes, usual, own)))
    offsets = own.groupBy("gram", "segment").agg(F.collect_list("offset").alias("offsets"))
    reps = classes.select("gram", "segment", F.col("rep.doc_id").alias("reference"))
    # Written, so that a class that very many have is split in the next join.
    reps = materialized(reps.join(offsets, ["gram", "segment"], "left"))
    placed = members.join(reps, ["gram", "segment"])
    first = an.first_of(F.col("place"))
    # A later copy is matched from end to end; the first document's own copies
    # are matched where their passage was.
    later = F.struct(first.alias("low"), (first + an.last_of(F.col("place")) + settings.window).alias("high"))
    earliest = F.transform(
        "offsets",
        lambda at: F.struct((first + at).alias("low"), (first + at + settings.window).alias("high")),
    )
    spans = F.when(F.col("reference") < F.col("doc_id"), F.array(later)).otherwise(earliest)
    return placed.select("doc_id", "text_key", F.explode(spans).alias("span")).select(
        "doc_id", "text_key", "span.low", "span.high"
    )


def passages_removed(docs: DataFrame, settings: PassageSettings | None = None) -> DataFrame:
    """One row a document: ``doc_id, n_words, spans, kept``.

    Every word in a window of ``window`` words whose sequence also starts in a
    document with a smaller ``doc_id`` is in a span (word numbers, end
    exclusive) and not in ``kept``, the other words joined by one space.  Null
    texts have no words; rows without ``doc_id`` are neither earlier nor later
    than any other and keep all their words; rows of equal ``doc_id`` do not
    count against each other; an empty table gives an empty one.
    """
    settings = settings or PassageSettings()
    texts = an.Texts.of(docs)
    spark = docs.sparkSession
    with scratch(spark):
        spans = materialized(repeated_passages(texts, settings), workspace(spark))
    schema = (
        "doc_id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, kept string"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wa.small_batches(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = an.merged_lists(batch.column("spans"))
            bounds = found.offsets.to_pylist()
            starts, ends = (part.to_pylist() for part in found.values.flatten())
            numbers, kept = [], []
            for text, a, b in zip(texts, bounds, bounds[1:]):
                words = text.split()
                numbers.append(len(words))
                left, at = [], 0
                for low, high in zip(starts[a:b], ends[a:b]):
                    left += words[at:low]
                    at = high
                left += words[at:]
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(numbers, pa.int64()),
                    found,
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "spans", "kept"],
            )

    return an.with_spans(texts, spans).mapInArrow(work, schema)
