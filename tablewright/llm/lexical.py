"""Ranked lexical search over hashed max-sketches.

A document's impacts fold into ``width`` hashed coordinates, each keeping the
largest.  An impact only grows with how often the term occurs, so a coordinate
stores the largest count and needs no figures of the whole corpus.  For a query
the weighted sum over its terms' coordinates is an upper bound of the score.
The documents of the highest bounds are scored exactly; the lowest score among
the best of them is the threshold down to which all others are scored too, in
descending order of what they could reach.  Nothing under it can be a result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.columns import arrow_schema, keyed, materialized, record_batch
from tablewright.operators.sizing import BROADCAST_BYTES

# Of ASCII only digits and letters make terms, A-Z as a-z.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
# Fixed values of the score: scale of an impact, of counts and of lengths.
SCALE, COUNT, LENGTH, SHARE = 1_000_000_000, 1000, 20, 50

# Bytes that one pair of document and item takes in a hash relation, at most.
PAIR_BYTES = 64
# Terms of documents, and cells of documents by items, that are held at once.
TERMS = 1 << 20
CELLS = 1 << 22
# Parts of an item's documents that are ranked each for itself first.
PARTS = 8

SKETCH = "doc_id bigint, text_key bigint, size bigint, places array<int>, peaks array<int>"
PAIRS = "doc_id bigint, text_key bigint, item int, bound double"
SCORES = "doc_id bigint, text_key bigint, item int, score bigint"
RESULT = "item_id bigint, rank int, doc_id bigint, text_key bigint, score bigint"


@dataclass(frozen=True)
class SearchSettings:
    """``top``: results of an item; ``width``: coordinates of a sketch, a power of
    two; ``items`` and ``chars``: how many items, and of how much text together,
    are looked up at once and sent to every task."""

    top: int = 50
    width: int = 1 << 24
    items: int = 1000
    chars: int = 1 << 20


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8; all bytes of other than ASCII belong to terms."""
    return text.translate(FOLD).split()


def length_share(size, docs: int, total: int):
    """``m`` of a document (number or array) of ``size`` terms."""
    return 100 - SHARE + (SHARE * size * docs) // total


def impact(count, share):
    return (SCALE * count) // (COUNT * count + LENGTH * share)


def binary(docs: DataFrame) -> DataFrame:
    return keyed(docs).withColumn("text", F.col("text").cast("binary"))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, text_key, size, places, peaks``: terms of each document, and the
    coordinates that they fall on with the largest count of any on each."""
    shape = arrow_schema(SKETCH)

    def folded(ids: pa.RecordBatch, sizes: list[int], found: list[Counter]) -> pa.RecordBatch:
        row = np.repeat(np.arange(len(found)), [len(c) for c in found])
        place = np.fromiter((crc32(t) for c in found for t in c), np.int64, len(row)) % width
        count = np.fromiter((n for c in found for n in c.values()), np.int64, len(row))
        key = row * width + place
        order = np.argsort(key, kind="stable")
        cells, first = np.unique(key[order], return_index=True)
        peaks = np.maximum.reduceat(count[order], first) if len(first) else count
        ends = pa.array(np.searchsorted(cells, np.arange(len(found) + 1) * width), pa.int32())
        lists = (
            pa.ListArray.from_arrays(ends, pa.array(values, pa.int32()))
            for values in (cells % width, peaks)
        )
        columns = [ids.column(0), ids.column(1), pa.array(sizes, pa.int64()), *lists]
        return pa.RecordBatch.from_arrays(
            [c.cast(f.type) for c, f in zip(columns, shape, strict=True)], schema=shape
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.select(["doc_id", "text_key"]), batch.column("text")
            sizes, found, held, first = [], [], 0, 0
            for n in range(len(batch)):
                words = terms(text[n].as_py())
                sizes.append(len(words))
                found.append(Counter(words))
                held += len(found[-1])
                if held >= TERMS or n == len(batch) - 1:
                    yield folded(ids.slice(first, len(found)), sizes, found)
                    sizes, found, held, first = [], [], 0, n + 1

    return binary(docs).mapInArrow(work, SKETCH)


@dataclass
class Lookup:
    """Items that are looked up together, with what scoring them needs: coordinates
    of their terms in ``places``, and where the entries of each, an ``item`` and
    the term's ``weight`` in it, begin and how many there are."""

    terms: list[dict[bytes, int]]
    docs: int
    total: int
    width: int
    places: np.ndarray = field(init=False)
    starts: np.ndarray = field(init=False)
    number: np.ndarray = field(init=False)
    item: np.ndarray = field(init=False)
    weight: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        entries = [(crc32(t) % self.width, i, w) for i, own in enumerate(self.terms) for t, w in own.items()]
        place, self.item, self.weight = np.array(sorted(entries), np.int64).reshape(-1, 3).T
        self.places, self.starts, self.number = np.unique(place, return_index=True, return_counts=True)

    def bounds(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """First row and bounds (rows by items) of blocks of a batch of sketches.
        Sums stay far below 2^53, so they are exact as floating point."""
        size = batch.column("size").to_numpy()
        lists = batch.column("places")
        row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
        place, peak = (batch.column(c).flatten().to_numpy() for c in ("places", "peaks"))
        own = np.searchsorted(self.places, place)
        met = np.flatnonzero(np.append(self.places, -1)[own] == place)
        row, own = row[met], own[met]
        number = self.number[own]
        share = length_share(size, self.docs, self.total)
        gain = impact(peak[met].astype(np.int64), share[row])
        done = np.concatenate([[0], np.cumsum(number)])
        begins = np.searchsorted(row, np.arange(len(batch) + 1))
        low, n = 0, len(self.terms)
        while low < len(batch):
            within = np.searchsorted(done[begins], done[begins[low]] + CELLS, "right") - 1
            high = max(low + 1, min(within, low + CELLS // n, len(batch)))
            part = slice(begins[low], begins[high])
            entry = np.repeat(np.arange(part.stop - part.start), number[part])
            slot = np.arange(len(entry)) + (self.starts[own[part]] - done[part] + done[part.start])[entry]
            cell = (row[part][entry] - low) * n + self.item[slot]
            sums = np.bincount(cell, self.weight[slot] * gain[part][entry], (high - low) * n)
            yield low, sums.reshape(high - low, n)
            low = high

    def score(self, item: int, counts: Counter, share: int) -> int:
        return sum(w * impact(counts[t], share) for t, w in self.terms[item].items() if t in counts)


def document_frequencies(docs: DataFrame, wanted: list[bytes]) -> np.ndarray:
    """In how many documents each of some distinct terms is; one number a term and task
    is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast({t: n for n, t in enumerate(wanted)})
    shape = arrow_schema("term int, n bigint")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                found.update(shared.value.keys() & set(terms(text.as_py())))
        rows = [(shared.value[t], n) for t, n in found.items()]
        yield record_batch(rows, shape)

    counted = binary(docs).mapInArrow(work, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(wanted), np.int64)
    for row in counted.collect():  # no more rows than terms of the items looked up at once
        out[row["term"]] = row["n"]
    return out


def pairs_of(batch: pa.RecordBatch, row: np.ndarray, item: np.ndarray, bound: np.ndarray) -> pa.Table:
    ids = batch.select(["doc_id", "text_key"]).take(pa.array(row))
    columns = [ids.column(0), ids.column(1), pa.array(item, pa.int32()), pa.array(bound, pa.float64())]
    return pa.Table.from_arrays(columns, ["doc_id", "text_key", "item", "bound"])


def highest(pairs: pa.Table, top: int, floor: np.ndarray) -> pa.Table:
    """The ``top`` pairs of the highest bounds of each item; raises ``floor`` to the
    lowest of them where an item has so many."""
    item, bound = (pairs.column(c).to_numpy() for c in ("item", "bound"))
    order = np.lexsort((-bound, item))
    first = np.searchsorted(item[order], item[order])
    rank = np.arange(len(order)) - first
    last = order[rank == top - 1]
    floor[item[last]] = bound[last]
    return pairs.take(pa.array(order[rank < top]))


def best_of(rows: DataFrame, top: int, value: str) -> DataFrame:
    """The first ``top`` rows of each item by descending value, with their ``rank``: of
    parts of its documents first, so no task sorts more than ``PARTS * top`` rows of
    an item in the end, however many are alike."""
    order = F.desc(value), "doc_id", "text_key"
    part = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(PARTS))
    for group in (("item", part), ("item",)):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= top)
    return rows


def highest_bounds(sketched: DataFrame, lookup: Lookup, top: int) -> DataFrame:
    """The ``top`` documents of the highest bounds above 0 of each item: of every
    task first, then of all, so what is sorted in the end is a few pairs a task."""
    shared = sketched.sparkSession.sparkContext.broadcast(lookup)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.zeros(len(shared.value.terms))
        held, size = [], 0
        for batch in batches:
            for low, bounds in shared.value.bounds(batch):
                row, item = np.nonzero(bounds > floor)
                held.append(pairs_of(batch, row + low, item, bounds[row, item]))
                size += len(row)
                if size >= CELLS:
                    held = [highest(pa.concat_tables(held), top, floor)]
                    size = len(held[0])
        if held:
            yield from highest(pa.concat_tables(held), top, floor).combine_chunks().to_batches()

    return best_of(sketched.mapInArrow(work, PAIRS), top, "bound").drop("rank")


def bounds_from(sketched: DataFrame, lookup: Lookup, least: np.ndarray) -> DataFrame:
    """Every pair whose bound is not below ``least`` of its item."""
    shared = sketched.sparkSession.sparkContext.broadcast((lookup, least.astype(float)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, limits = shared.value
        for batch in batches:
            for low, bounds in known.bounds(batch):
                row, item = np.nonzero(bounds >= limits)
                found = pairs_of(batch, row + low, item, bounds[row, item])
                yield from found.combine_chunks().to_batches()

    return sketched.mapInArrow(work, PAIRS)


def scored(docs: DataFrame, pairs: DataFrame, lookup: Lookup) -> DataFrame:
    """``doc_id, text_key, item, score`` of written pairs, from whole texts.

    Texts are read where they are as long as the documents asked for measurably
    fit every executor; else they are shuffled to meet their pairs."""
    wanted = pairs.groupBy("doc_id", "text_key").agg(F.collect_set("item").alias("items"))
    wanted = wanted.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    if pairs.count() * PAIR_BYTES <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(lookup)
    shape = arrow_schema(SCORES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = []
            for doc_id, key, text, items in zip(*batch.columns, strict=True):
                words = terms(text.as_py())
                counts, share = Counter(words), length_share(len(words), known.docs, known.total)
                rows += [
                    (doc_id.as_py(), key.as_py(), i, known.score(i, counts, share)) for i in items.as_py()
                ]
            yield record_batch(rows, shape)

    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    return binary(docs).join(wanted, same).drop("_id", "_key").mapInArrow(work, SCORES)


def ranked(scores: DataFrame, top: int) -> DataFrame:
    """The ``top`` scores above 0 of each item with their ``rank``."""
    return best_of(scores.where("score > 0"), top, "score")


def looked_up(
    docs: DataFrame,
    sketched: DataFrame,
    items: list[tuple[int, list[bytes]]],
    counted: tuple[int, int],
    settings: SearchSettings,
) -> DataFrame:
    """Results of the items of one lookup."""
    wanted = sorted({t for _, own in items for t in own})
    found = document_frequencies(docs, wanted)
    weights = {
        t: math.floor(1000 * math.log((2 * counted[0] + 2) / (2 * df + 1)))
        for t, df in zip(wanted, found.tolist(), strict=True)
        if df
    }
    # Terms of no document, or of no weight, add nothing to any score.
    own = [{t: weights[t] for t in sorted(set(named)) if weights.get(t)} for _, named in items]
    lookup = Lookup(own, *counted, settings.width)
    first = materialized(highest_bounds(sketched, lookup, settings.top))
    reached = ranked(scored(docs, first, lookup), settings.top).where(F.col("rank") == settings.top)
    least = np.ones(len(items), np.int64)
    for row in reached.select("item", "score").collect():  # one row an item
        least[row["item"]] = row["score"]
    pairs = materialized(bounds_from(sketched, lookup, least))
    names = docs.sparkSession.createDataFrame(
        [(n, item_id) for n, (item_id, _) in enumerate(items)], "item int, item_id bigint"
    )
    best = ranked(scored(docs, pairs, lookup), settings.top)
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "text_key", "score")


def ranked_search(docs: DataFrame, items: DataFrame, settings: SearchSettings | None = None) -> DataFrame:
    """The ``settings.top`` highest-scoring documents of each item (``item_id``,
    ``text``): ``item_id, rank, doc_id, text_key, score``, scores above 0 only.

    Equal scores go by ascending ``doc_id`` (null first), then by text.  Repeated
    rows of ``docs`` are documents of their own and rank one after the other;
    repeated rows of ``items`` are one item, and items of one id but different
    texts are ranked each for itself.  Null and empty texts, of documents or of
    items, have no terms and no results; either table may be empty, and more
    columns do no harm.  Sketches are written once; items are looked up
    ``settings.items`` at a time.
    """
    settings = settings or SearchSettings()
    spark = docs.sparkSession
    named = items.select(
        F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("text")
    ).where("text IS NOT NULL").distinct()
    sketched = materialized(sketches(docs, settings.width))
    counted = tuple(sketched.agg(F.expr("count_if(size > 0)"), F.expr("coalesce(sum(size), 0)")).first())
    number, chars = named.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    lookups = max(-(-number // settings.items), -(-chars // settings.chars))
    parts = []
    for n in range(lookups if counted[0] else 0):
        own = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(lookups)) == n)
        listed = [(r["item_id"], terms(bytes(r["text"]))) for r in own.orderBy("item_id", "text").collect()]
        listed = [(item_id, found) for item_id, found in listed if found]
        if listed:
            part = looked_up(docs, sketched, listed, counted, settings)
            parts.append(part if lookups == 1 else materialized(part))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RESULT)
