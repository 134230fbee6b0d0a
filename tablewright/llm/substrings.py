"""Suffix-array dedup of repeated byte strings, over a sparse suffix array.

Suffixes are sorted where anchors stand, so one for each eighty bytes or so, and
only where an anchor's gram occurs again.  A task sorts the suffixes of its
documents into runs and front-codes them: each suffix as the length of the
prefix it shares with the one before, and the rest.  Runs are exchanged by
range of the leading hash and combined by a loser tree that knows how far each
candidate agrees with the last suffix put out, and so compares bytes only from
there on.  The common prefixes of the merged order, and the bytes before the
anchors, then tell which windows occur twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import anchors as an
from tablewright.llm import wordarrays as wa
from tablewright.llm.columns import materialized
from tablewright.sources.workspace import scratch, workspace


@dataclass(frozen=True)
class SubstringSettings:
    """``window``: bytes of a string that may not occur twice; ``gram``: bytes of an
    anchor; ``run``: suffixes that a task sorts at once; ``range_size``:
    suffixes that a range is meant to hold; ``group_size``: an anchor with more
    different segments is split by what is around it."""

    window: int = 200
    gram: int = 40
    run: int = 20_000
    range_size: int = 25_000
    group_size: int = 20_000


@dataclass(slots=True)
class Suffix:
    """``key``: the anchor's hash, then the bytes from the anchor on; ``before``:
    those before it, nearest first; windows start at most ``len(before)`` and
    at least ``least`` bytes before the anchor."""

    key: bytes
    before: bytes
    least: int
    segment: int
    n: int


HEAD = 8


def byte_anchors(settings: SubstringSettings):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in wa.byte_chunks(batches, ("doc_id", "text_key"), an.PART):
            whole: list[tuple] = []
            parts: list[bytes] = []
            offsets: list[int] = []
            size = 0
            for row, text in zip(rows, texts, strict=True):
                for at in range(0, max(len(text) - settings.window + 1, 0), an.PART):
                    part = text[at : at + an.PART + settings.window - 1]
                    if size + len(part) > 2 * an.PART:
                        yield batch_of(whole, parts, offsets)
                        whole, parts, offsets, size = [], [], [], 0
                    whole.append(row)
                    parts.append(part)
                    offsets.append(at)
                    size += len(part)
            if whole:
                yield batch_of(whole, parts, offsets)

    def batch_of(rows, parts, offsets):
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        return an.anchor_rows(
            rows, wa.OF_BYTE[data], sizes, np.array(offsets), settings.window, settings.gram
        )

    return work


def suffix_of(text: bytes, own: dict, settings: SubstringSettings) -> Suffix:
    place = own["place"]
    first = place >> (2 * an.FIELD)
    mask = (1 << an.FIELD) - 1
    anchor, last = first + (place >> an.FIELD & mask), first + (place & mask)
    head = int(own["gram"]).to_bytes(HEAD, "big", signed=True)
    return Suffix(
        head + text[anchor : last + settings.window],
        text[first:anchor][::-1],
        anchor - last,
        own["segment"],
        own["n"],
    )


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of ``a`` and ``b``, known to be ``known`` at least."""
    end = min(len(a), len(b))
    while known < end:
        step = min(32, end - known)
        x, y = a[known : known + step], b[known : known + step]
        if x != y:
            differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return known + step - (differ.bit_length() + 7) // 8
        known += step
    return end


def front_coded(run: list[Suffix]) -> Iterator[tuple[int, Suffix]]:
    """Each suffix of a sorted run with what it shares with the one before."""
    previous = b""
    for suffix in run:
        shared = common(previous, suffix.key, 0)
        yield shared, suffix
        previous = suffix.key


RUN = (
    "range bigint, shared binary, rest binary, rest_sizes binary, before binary, "
    "before_sizes binary, least binary, segments binary, numbers binary"
)


def packed(part: int, coded: list[tuple[int, Suffix]]) -> tuple:
    shared = [s for s, _ in coded]
    rest = [x.key[s:] for s, x in coded]

    def numbers(values, kind):
        return np.array(values, kind).tobytes()

    return (
        part,
        numbers(shared, np.uint16),
        b"".join(rest),
        numbers([len(r) for r in rest], np.uint16),
        b"".join(x.before for _, x in coded),
        numbers([len(x.before) for _, x in coded], np.uint16),
        numbers([x.least for _, x in coded], np.uint16),
        numbers([x.segment for _, x in coded], np.int64),
        numbers([x.n for _, x in coded], np.int64),
    )


def unpacked(row: dict) -> Iterator[tuple[int, Suffix]]:
    """What ``packed`` put in, suffixes put together again one by one."""
    shared = np.frombuffer(row["shared"], np.uint16).tolist()
    sizes = np.frombuffer(row["rest_sizes"], np.uint16).tolist()
    befores = np.frombuffer(row["before_sizes"], np.uint16).tolist()
    least = np.frombuffer(row["least"], np.uint16).tolist()
    segments = np.frombuffer(row["segments"], np.int64).tolist()
    numbers = np.frombuffer(row["numbers"], np.int64).tolist()
    key, at, before_at = b"", 0, 0
    for s, size, b, low, segment, n in zip(
        shared, sizes, befores, least, segments, numbers, strict=True
    ):
        key = key[:s] + row["rest"][at : at + size]
        at += size
        yield s, Suffix(key, row["before"][before_at : before_at + b], low, segment, n)
        before_at += b


class LoserTree:
    """Merges front-coded runs.  ``agree[r]`` is how far the head of run ``r`` agrees
    with the last suffix put out (at inner nodes: with the winner that beat it).
    Of two heads the one that agrees further is less, without a look at their
    bytes; heads that agree equally far are compared from there on."""

    def __init__(self, runs: list[Iterator[tuple[int, Suffix]]]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.heads: list[Suffix | None] = [None] * self.size
        self.agree = [0] * self.size
        for r, run in enumerate(runs):
            _, self.heads[r] = next(run, (0, None))
        self.losers = [-1] * self.size
        self.winner = self.build(1)

    def build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        won, lost = self.play(self.build(2 * node), self.build(2 * node + 1))
        self.losers[node] = lost
        return won

    def play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's agreement becomes that with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.agree[a], self.agree[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        shared = common(x.key, y.key, p)
        first = x.key[shared : shared + 1] <= y.key[shared : shared + 1]
        won, lost = (a, b) if first else (b, a)
        self.agree[lost] = shared
        return won, lost

    def __iter__(self) -> Iterator[tuple[int, Suffix]]:
        """Suffixes in order, each with what it shares with the one before."""
        while (head := self.heads[self.winner]) is not None:
            run = self.winner
            yield self.agree[run], head
            self.agree[run], self.heads[run] = next(self.runs[run], (0, None))
            won, node = run, (run + self.size) // 2
            while node:
                won, self.losers[node] = self.play(won, self.losers[node])
                node //= 2
            self.winner = won


def repeats(order: list[tuple[int, Suffix]], window: int) -> Iterator[tuple[Suffix, int, int]]:
    """Each suffix with ranges of offsets before its anchor at which a window starts
    that occurs again.

    At offset o windows are equal if o bytes before the anchors and window - o
    from there on are: the latter are intervals of the merged order.  A segment
    that occurs more than once repeats at every offset.
    """
    shared = np.array([s - HEAD for s, _ in order])
    suffixes = [x for _, x in order]
    most = np.array([len(x.before) for x in suffixes])
    least = np.array([x.least for x in suffixes])
    depth = int(most.max())
    before = np.zeros((len(suffixes), depth + 1), np.uint8)
    for row, x in zip(before, suffixes, strict=True):
        row[: len(x.before)] = np.frombuffer(x.before, np.uint8)
    again = np.zeros((len(suffixes), depth + 1), bool)
    left = np.zeros(len(suffixes), np.uint64)
    for o in range(depth + 1):
        if o:
            left = left * wa.STEP + wa.OF_BYTE[before[:, o - 1]]
        live = np.flatnonzero((least <= o) & (o <= most))
        if len(live) < 2:
            continue
        interval = np.cumsum(shared < window - o)[live].astype(np.uint64)
        key = wa.mixed(left[live] + interval * wa.OF_PLACE[0])
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        again[live[by[1:][same]], o] = True
        again[live[by[:-1][same]], o] = True
    for x, flags in zip(suffixes, again, strict=True):
        if x.n > 1:
            yield x, x.least, len(x.before)
            continue
        edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
        for low, high in edges.reshape(-1, 2).tolist():
            yield x, low, high - 1


VERDICT = "gram bigint, segment bigint, low bigint, high bigint"


def sorted_runs(texts: DataFrame, ranges: int, settings: SubstringSettings) -> DataFrame:
    """Front-coded runs of the tasks' suffixes, cut by range of the leading hash."""

    def cut(run: list[Suffix]) -> pa.RecordBatch:
        run.sort(key=lambda x: x.key)
        head = np.array([int.from_bytes(x.key[:HEAD], "big") for x in run], np.uint64)
        part = (head // np.uint64(-(-(1 << 64) // ranges))).astype(np.int64) if ranges > 1 else np.zeros(len(run), np.int64)
        bounds = np.flatnonzero(np.diff(part, prepend=-1, append=-2)).tolist()
        rows = [
            packed(int(part[a]), list(front_coded(run[a:b]))) for a, b in zip(bounds, bounds[1:])
        ]
        names = [c.split(" ")[0] for c in RUN.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[Suffix] = []
        for batch in wa.small_batches(batches):
            listed = zip(
                batch.column("text").cast(pa.binary()).to_pylist(),
                batch.column("own").to_pylist(),
                strict=True,
            )
            for text, own in listed:
                for row in own:
                    run.append(suffix_of(text, row, settings))
                    if len(run) >= settings.run:
                        yield cut(run)
                        run = []
        if run:
            yield cut(run)

    return texts.mapInArrow(work, RUN)


def merged(runs: DataFrame, ranges: int, settings: SubstringSettings) -> DataFrame:
    """``gram, segment, low, high``: offsets of windows that occur again."""

    def combine(table: pa.Table) -> pa.Table:
        tree = LoserTree([unpacked(r) for r in table.to_pylist()])
        rows = [
            (int.from_bytes(x.key[:HEAD], "big", signed=True), x.segment, low, high)
            for x, low, high in repeats(list(tree), settings.window)
        ]
        names = [c.split(" ")[0] for c in VERDICT.split(", ")]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names)

    return runs.repartition(ranges, "range").groupBy("range").applyInArrow(combine, VERDICT)


def repeated_windows(texts: an.Texts, settings: SubstringSettings) -> DataFrame:
    """``doc_id, text_key, low, high``: byte ranges covered by repeated windows."""
    found = an.anchors(texts, byte_anchors(settings))
    members = an.repeated(found)
    classes = an.segment_classes(members)
    usual, links = an.fitting(
        texts, classes, settings.group_size, bytes, bytes, settings.window, settings.gram
    )
    ranges = max(1, -(-usual.count() // settings.range_size))
    runs = sorted_runs(an.with_texts(texts, usual), ranges, settings)
    verdicts = materialized(merged(runs, ranges, settings))
    if links is not None:
        found = verdicts.withColumnsRenamed({"gram": "sub_gram", "segment": "sub_segment"})
        verdicts = verdicts.unionByName(
            links.join(found, ["sub_gram", "sub_segment"]).select("gram", "segment", "low", "high")
        )
    anchor = an.first_of(F.col("place")) + an.anchor_of(F.col("place"))
    return members.join(verdicts, ["gram", "segment"]).select(
        "doc_id",
        "text_key",
        (anchor - F.col("high")).alias("low"),
        (anchor - F.col("low") + settings.window).alias("high"),
    )


def substrings_removed(docs: DataFrame, settings: SubstringSettings | None = None) -> DataFrame:
    """One row a document: ``doc_id, n_bytes, spans, kept``.

    Every byte in a string of ``window`` bytes that also starts anywhere else,
    in any document or the same one, is in a span (start, end exclusive; not
    touching each other) and not in ``kept``, the remaining bytes.  Null texts
    are empty; texts shorter than a window are kept whole; repeated rows are
    copies of each other; an empty table gives an empty one.
    """
    settings = settings or SubstringSettings()
    texts = an.Texts.of(docs)
    spark = docs.sparkSession
    with scratch(spark):
        spans = materialized(repeated_windows(texts, settings), workspace(spark))
    schema = (
        "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wa.small_batches(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [an.merged_spans(s) for s in batch.column("spans").to_pylist()]
            kept = []
            for text, own in zip(texts, found, strict=True):
                edges = [0, *(e for s in own for e in s), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(
                        [[{"start": a, "end": b} for a, b in s] for s in found],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                    ),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    return an.with_spans(texts, spans).mapInArrow(work, schema)
