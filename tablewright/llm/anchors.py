"""Anchors of repeated text: places chosen by content, so copies choose alike.

A text is a row of symbols, bytes or words.  Every window of ``window`` symbols
has one anchor, the run of ``gram`` symbols in it whose hash is least, the
first of equals.  Windows that follow each other share anchors, so one row
stands for many windows, and equal windows always have equal anchors at equal
offsets.  Only anchors cross the network; texts are read again where needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.columns import arrow_schema, keyed, materialized, record_batch
from tablewright.functions.comparison import Comparison
from tablewright.llm.wordarrays import STEP, mixed, small_batches
from tablewright.operators.integrity import KEY, joined_to_orphans
from tablewright.operators.sizing import BroadcastBudget
from tablewright.sources.workspace import reserved, scratch

PLACE_BITS = 24
#: Symbols searched at once; longer texts are cut into parts that overlap by a window.
PART = 1 << 19
#: A step's place: first window (38 bits), anchor and last window from there (12 bits each).
FIELD = 12
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))

SCHEMA = "doc_id bigint, text_key bigint, place bigint, gram bigint, segment bigint"


@dataclass(frozen=True)
class Runs:
    """Runs of windows with one anchor: first and last window, the anchor, the hash
    of its gram and of all the symbols that the windows cover."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray
    segment: np.ndarray


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def least_in(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive values, by doubling."""
    out, done = values, 1
    while done < size:
        step = min(done, size - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def anchor_runs(
    symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray, window: int, gram: int
) -> Runs:
    """Runs over texts that lie one after the other in ``symbols``, at ``begins`` to
    ``ends``; no window crosses two texts."""
    n = len(symbols)
    none = np.zeros(0, np.int64)
    if n < window:
        return Runs(none, none, none, none, none)
    up, down = powers(STEP, n + 1), powers(BACK, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * up[:n], out=total[1:])
    hashes = mixed((total[gram:] - total[: n - gram + 1]) * down[: n - gram + 1])
    mask = np.uint64((1 << PLACE_BITS) - 1)
    packed = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    chosen = (least_in(packed, window - gram + 1) & mask).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)
    fit = ends - begins >= window
    np.add.at(valid, begins[fit], 1)
    np.add.at(valid, ends[fit] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[: len(chosen)]))
    if not len(starts):
        return Runs(none, none, none, none, none)
    chosen = chosen[starts]
    opens = np.ones(len(starts), bool)
    opens[1:] = (np.diff(chosen) != 0) | (np.diff(starts) != 1)
    at = np.flatnonzero(opens)
    first, anchor = starts[at], chosen[at]
    last = starts[np.append(at[1:], len(starts)) - 1]
    segment = (total[last + window] - total[first]) * down[first]
    shape = ((anchor - first) << FIELD | (last - first)).astype(np.uint64)
    # Least hashes are small numbers: mixed again, they spread over all ranges.
    return Runs(first, last, anchor, mixed(hashes[anchor]), mixed(segment ^ mixed(shape)))


def anchor_rows(
    rows: list[tuple], symbols: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, window: int, gram: int
) -> pa.RecordBatch:
    """Runs of the parts of texts as rows; ``offsets``: where a part begins in its text."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    runs = anchor_runs(symbols, begins, ends, window, gram)
    part = np.searchsorted(ends, runs.first, "right")
    own = runs.first - begins[part] + offsets[part]
    place = own << (2 * FIELD) | (runs.anchor - runs.first) << FIELD | (runs.last - runs.first)
    ids, keys = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
    take = pa.array(part)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(take),
            keys.take(take),
            pa.array(place, pa.int64()),
            pa.array(runs.gram.view(np.int64)),
            pa.array(runs.segment.view(np.int64)),
        ],
        ["doc_id", "text_key", "place", "gram", "segment"],
    )


def first_of(place: Column) -> Column:
    return F.shiftright(place, 2 * FIELD)


def anchor_of(place: Column) -> Column:
    return F.shiftright(place, FIELD).bitwiseAND((1 << FIELD) - 1)


def last_of(place: Column) -> Column:
    return place.bitwiseAND((1 << FIELD) - 1)


@dataclass(frozen=True)
class Texts:
    """Documents by ``doc_id`` and ``text_key``.  Where no id comes twice, which only
    the ids need be read for, the second is 0 and adds nothing to what is sent."""

    rows: DataFrame
    distinct: DataFrame

    @classmethod
    def of(cls, docs: DataFrame) -> Texts:
        rows = keyed(docs)
        if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
            rows = rows.withColumn("text_key", F.lit(0).cast("bigint"))
            return cls(rows, rows)
        return cls(rows, rows.dropDuplicates(["doc_id", "text_key"]))


def anchors(texts: Texts, work: Callable[[Iterator], Iterator]) -> DataFrame:
    return texts.rows.mapInArrow(work, SCHEMA)


def repeated(found: DataFrame) -> DataFrame:
    """The anchors whose gram occurs again.

    Grams are counted first, in each task before the shuffle; only then do
    anchors with their places cross the network, and what stays is written.
    """
    members = reserved(found.sparkSession)
    with scratch(found.sparkSession):
        grams = materialized(
            found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
        )
        return materialized(found.join(grams, "gram"), members)


def segment_classes(members: DataFrame) -> DataFrame:
    """One row for each distinct segment under an anchor: how many have it, and
    the least (``doc_id``, ``text_key``, ``place``) of them as ``rep``."""
    return materialized(
        members.groupBy("gram", "segment").agg(
            F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "place")).alias("rep")
        )
    )


def by_ids(texts: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Texts with an id among ``_id`` (semi) or not (anti), null being taken as 0:
    sent as bits, the ids keep texts that need not meet anything where they are."""
    keys = ids.select(F.expr("coalesce(_id, 0L)").alias(KEY))
    with BroadcastBudget().account() as account:
        return joined_to_orphans(texts, Comparison("coalesce(doc_id, 0L)", KEY, "bigint"), keys, how, account)


def with_texts(texts: Texts, classes: DataFrame) -> DataFrame:
    """``text`` and ``own``, the classes (place, gram, segment, n) that it stands for."""
    listed = classes.groupBy(
        F.col("rep.doc_id").alias("_id"), F.col("rep.text_key").alias("_key")
    ).agg(F.collect_list(F.struct("rep.place", "gram", "segment", "n")).alias("own"))
    return (
        by_ids(texts.distinct, classes.select(F.col("rep.doc_id").alias("_id")), "left_semi").join(listed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
        .select("doc_id", "text_key", "text", "own")
    )


SPLIT = (
    "gram bigint, segment bigint, n bigint, doc_id bigint, text_key bigint, place bigint, "
    "sub_gram bigint, sub_segment bigint, shift bigint, windows bigint"
)


def split_runs(
    texts: DataFrame, symbols: Callable, joined: Callable, window: int, gram: int, level: int
) -> DataFrame:
    """Runs of windows cut by how far before the anchor a window starts, into ``2 ** level``
    intervals of offsets.  All windows of offsets a to b hold the same symbols from
    a before the anchor to ``window - b`` after it: their hash is the gram of the
    part, so equal windows stay under one gram and each is in one part.

    ``shift``: where a part's first window is in its run, ``windows``: how many it
    has.  ``symbols`` reads a text, ``joined`` writes some of its symbols."""
    edges = [i * (window - gram + 1) >> level for i in range((1 << level) + 1)]

    def named(*parts: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "big", signed=True)

    def parts_of(data, own: dict) -> Iterator[tuple]:
        mask = (1 << FIELD) - 1
        first = own["place"] >> (2 * FIELD)
        anchor, last = first + (own["place"] >> FIELD & mask), first + (own["place"] & mask)
        for a, end in zip(edges, edges[1:]):
            low, high = max(a, anchor - last), min(end - 1, anchor - first)
            if low > high:
                continue
            shared = joined(data[anchor - a : anchor - end + 1 + window])
            whole = joined(data[anchor - high : anchor - low + window])
            place = (anchor - high) << (2 * FIELD) | high << FIELD | (high - low)
            shape = b"%d %d %d" % (level, low, high)
            yield place, named(b"%d %d" % (level, a), shared), named(shape, whole), anchor - high - first, high - low + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text_key", "own")]
            for *key, listed, text in zip(*columns, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                data = symbols(text)
                for own in listed:
                    head = own["gram"], own["segment"], own["n"], *key
                    rows += [(*head, *part) for part in parts_of(data, own)]
            yield record_batch(rows, shape)

    shape = arrow_schema(SPLIT)
    return texts.mapInArrow(work, SPLIT)


def fitting(
    texts: Texts, classes: DataFrame, limit: int, symbols: Callable, joined: Callable, window: int, gram: int
) -> tuple[DataFrame, DataFrame | None]:
    """Classes of which at most ``limit`` are under one gram, and what they stand for:
    ``gram, segment`` of a class given, ``sub_gram, sub_segment`` of one that has a
    part of its windows, ``shift`` and ``windows``; None where no class was cut.

    A gram with more classes is split by `split_runs`, again and finer where a part
    still has too many; a part of a single offset holds equal windows alone."""
    spark = classes.sparkSession
    kept, links, open_, level = [], [], None, 0
    while True:
        sizes = classes.groupBy("gram").agg(F.count("*").alias("m"))
        large = materialized(sizes.where(F.col("m") > limit).select("gram"))
        last = large.isEmpty()
        kept.append(classes if last else classes.join(large, "gram", "left_anti"))
        if open_ is not None:
            named = large.withColumnRenamed("gram", "sub_gram")
            links.append(open_ if last else open_.join(named, "sub_gram", "left_anti"))
            open_ = open_.join(named, "sub_gram", "left_semi")
        if last:
            break
        level += 1
        rest = classes.join(large, "gram", "left_semi")
        finer, linked = reserved(spark), reserved(spark)
        with scratch(spark):
            parts = materialized(split_runs(with_texts(texts, rest), symbols, joined, window, gram, level))
            classes = materialized(
                parts.groupBy(F.col("sub_gram").alias("gram"), F.col("sub_segment").alias("segment")).agg(
                    F.sum("n").alias("n"), F.min(F.struct("doc_id", "text_key", "place")).alias("rep")
                ),
                finer,
            )
            own = parts.select("gram", "segment", "sub_gram", "sub_segment", "shift", "windows")
            if open_ is not None:
                further = own.select(*(F.col(c).alias(f"_{c}") for c in own.columns))
                same = (F.col("sub_gram") == F.col("_gram")) & (F.col("sub_segment") == F.col("_segment"))
                own = open_.join(further, same).select(
                    "gram", "segment", F.col("_sub_gram").alias("sub_gram"), F.col("_sub_segment").alias("sub_segment"),
                    (F.col("shift") + F.col("_shift")).alias("shift"), F.col("_windows").alias("windows"),
                )
            open_ = materialized(own, linked)
    return reduce(DataFrame.unionByName, kept), reduce(DataFrame.unionByName, links) if links else None


def with_spans(texts: Texts, spans: DataFrame) -> DataFrame:
    """``doc_id, text, spans``: every document with its ``low, high`` places of windows."""
    listed = spans.groupBy(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")
    ).agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    ids = spans.select(F.col("doc_id").alias("_id"))
    found = by_ids(texts.rows, ids, "left_semi").join(
        listed,
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")),
        "left",
    )
    others = by_ids(texts.rows, ids, "left_anti")
    return found.select("doc_id", "text", "spans").unionByName(
        others.select("doc_id", "text"), allowMissingColumns=True
    )


def merged_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans or []):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def merged_lists(spans: pa.ListArray) -> pa.ListArray:
    """`merged_spans` of every list at once, as ``start, end``; null as the empty list."""
    sizes = spans.value_lengths().fill_null(0).to_numpy()
    low, high = (part.to_numpy() for part in spans.flatten().flatten())
    if not len(low):
        low = high = np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    # Lists lie one after the other, with room between them.
    shift = row * (int(high.max(initial=0)) + 1)
    order = np.argsort(low + shift, kind="stable")
    row, low, high = row[order], (low + shift)[order], np.maximum.accumulate((high + shift)[order])
    opens = np.ones(len(low), bool)
    opens[1:] = low[1:] > high[:-1]
    at = np.flatnonzero(opens)
    ends = high[np.append(at[1:], len(high)) - 1] if len(at) else high
    ends = ends - shift[at]
    starts = low[at] - shift[at]
    bounds = np.append(0, np.cumsum(np.bincount(row[at], minlength=len(sizes))))
    merged = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), merged)
