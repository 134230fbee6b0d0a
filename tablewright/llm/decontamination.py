"""Benchmark decontamination by q-gram lemma filtering.

Benchmark texts are cut into overlapping pieces.  A piece of n characters that
stands in a document within e edits shares at least n + 1 - q(e + 1) of its
q-grams with it, all on diagonals that differ by e at most, so all in one of the
bands of width 2e that start at every multiple of e.  Bands that reach this
count are verified by an alignment confined to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.columns import (
    arrow_schema,
    keyed,
    materialized,
    record_batch,
    rejoined,
)

RESULT = (
    "doc_id bigint, text_key bigint, item_id bigint, piece bigint, start bigint, end bigint, edits bigint"
)
# Texts searched together: a task holds some sixty bytes for each of their characters.
CHUNK_CHARS = 1 << 19
# Characters of benchmark text that are sent to every task at once; each is in ten pieces.
SHARD_CHARS = 4 << 20 >> 2
# Shared q-grams that are looked at together.
MATCHES = 1 << 18
# Candidates that are aligned together.
CANDIDATES = 1 << 15
SHIFT = 9
TABLE_BITS = 22
BASE = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.arange(1, 1 << 12, dtype=np.uint64) * np.uint64(2) * BASE + BASE


@dataclass(frozen=True)
class LeakSettings:
    """``q``: characters of a q-gram; ``piece`` and ``step``: how items are cut,
    by no more than the edits of a piece, so that nine tenths of one lie in any
    part of an item that long;
    ``edit_share``: edits allowed for each character of a piece; items of fewer
    than ``least_chars`` characters are no evidence and are not searched."""

    q: int = 8
    piece: int = 100
    step: int = 10
    edit_share: float = 0.1
    least_chars: int = 24


def codes(text: str) -> np.ndarray:
    """Code points, A-Z in lower case and each white space as a space."""
    out = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    out[(out >= 65) & (out <= 90)] += 32
    out[(out >= 9) & (out <= 13)] = 32
    return out


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """A hash for every run of ``q`` code points, put together from halves."""
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    parts = {1: (chars.astype(np.uint64) + np.uint64(1)) * BASE}
    size = 1
    while size * 2 <= q:
        half = parts[size]
        parts[size * 2] = joined(half, half, size)
        size *= 2
    whole, done = parts[size], size
    for rest in sorted(parts, reverse=True):
        while done + rest <= q:
            whole, done = joined(whole, parts[rest], done), done + rest
    return whole


def joined(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    out = left[: len(right) - size] * FACTORS[size]
    out ^= right[size:]
    out ^= out >> np.uint64(29)
    return out


@dataclass
class Piece:
    item_id: int
    start: int
    chars: np.ndarray
    edits: int
    least: int


def pieces_of(items: list[tuple[int, str]], settings: LeakSettings) -> list[Piece]:
    out = []
    for item_id, text in items:
        chars = codes(text or "")
        n = len(chars)
        if n < max(settings.least_chars, settings.q):
            continue
        size = min(n, settings.piece)
        starts = sorted({*range(0, n - size + 1, settings.step), n - size})
        edits = max(0, min(int(settings.edit_share * size), size // settings.q - 1))
        least = size + 1 - settings.q * (edits + 1)
        out += [Piece(item_id, s, chars[s : s + size], edits, least) for s in starts]
    return out


class Index:
    """The q-grams of all pieces of a shard, sorted by hash."""

    def __init__(self, pieces: list[Piece], settings: LeakSettings):
        self.pieces, self.q = pieces, settings.q
        hashes = [gram_hashes(p.chars, settings.q) for p in pieces]
        flat = np.concatenate(hashes)
        owner = np.repeat(np.arange(len(pieces)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first, self.number = np.unique(
            flat[order], return_index=True, return_counts=True
        )
        self.maybe = np.zeros(1 << TABLE_BITS, bool)
        self.maybe[self.grams >> np.uint64(64 - TABLE_BITS)] = True
        self.least = np.array([p.least for p in pieces])
        self.edits = np.array([p.edits for p in pieces])
        self.sizes = np.array([len(p.chars) for p in pieces])
        self.widest = int(self.edits.max())
        self.longest = int(self.sizes.max())

    def postings(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the text whose q-gram is in the index, and its entry."""
        hashes = gram_hashes(chars, self.q)
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - TABLE_BITS)])
        wanted = hashes[at]
        entry = np.minimum(np.searchsorted(self.grams, wanted), len(self.grams) - 1)
        same = self.grams[entry] == wanted
        return at[same], entry[same]

    def matches(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position in the text, piece, and position in the piece of shared
        q-grams in neighbourhoods that share enough of them."""
        at, entry = self.postings(chars)
        # A match lies within two neighbouring blocks, being shorter than one.
        shift = max(SHIFT, int(self.longest + self.widest).bit_length())
        block = at >> shift
        total = np.cumsum(self.number[entry])
        found, low = [], 0
        while low < len(at):
            # Whole blocks of about MATCHES entries, seen with the blocks around them.
            done = total[low - 1] if low else 0
            last = block[min(max(np.searchsorted(total, done + MATCHES), low), len(at) - 1)]
            a, b, high = np.searchsorted(block, [block[low] - 1, last + 2, last + 1])
            each, owner, place = self.expanded(at[a:b], entry[a:b])
            own = each >> shift
            held = self.enough(own, owner) & (own >= block[low]) & (own <= last)
            found.append((each[held], owner[held], place[held]))
            low = high
        if not found:
            return at, at, at
        return tuple(map(np.concatenate, zip(*found)))

    def expanded(self, at: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        number = self.number[entry]
        each = np.repeat(at, number)
        ends = np.cumsum(number)
        slot = np.arange(len(each)) - np.repeat(ends - number, number)
        slot += np.repeat(self.first[entry], number)
        return each, self.owner[slot], self.place[slot]

    def enough(self, block: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Which entries are in a block that shares enough with the piece together
        with a neighbour; only pairs of block and piece that occur are counted."""
        n = len(self.pieces)
        pairs, pair, counts = np.unique(block * n + owner, return_inverse=True, return_counts=True)
        after = np.minimum(np.searchsorted(pairs, pairs + n), len(pairs) - 1)
        follows = pairs[after] == pairs + n
        good = counts + np.where(follows, counts[after], 0) >= self.least[pairs % n]
        good[after[follows & good]] = True
        return good[pair]

    def bands(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and first diagonal of the bands that meet the bound."""
        at, owner, place = self.matches(chars)
        if not len(at):
            return at, at
        width = np.maximum(self.edits[owner], 1)
        last = (at - place) // width
        # One number for piece, band and place; bands start below 0.
        bands, places = len(chars) + 4 * self.longest, self.longest + 1
        keys = [(owner * bands + band + 2 * self.longest) * places + place for band in (last - 1, last)]
        found = np.unique(np.concatenate(keys)) // places  # each place of a piece once
        cuts = np.flatnonzero(np.diff(found, prepend=-1))
        number = np.diff(cuts, append=len(found))
        owner, band = np.divmod(found[cuts], bands)
        good = number >= self.least[owner]
        owner, band = owner[good], band[good] - 2 * self.longest
        return owner, band * np.maximum(self.edits[owner], 1)


def aligned(pieces: np.ndarray, windows: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Edits of each whole piece against its window, one candidate a row.

    Row c of ``windows`` starts at the lowest diagonal of candidate c;
    ``opening`` is the cost of starting on each diagonal.  The result has the
    cost of ending on each.
    """
    width = opening.shape[1]
    steps = np.arange(width, dtype=opening.dtype)
    cost = opening
    for j in range(pieces.shape[1]):
        moved = cost + (windows[:, j : j + width] != pieces[:, j : j + 1])
        np.minimum(moved[:, :-1], cost[:, 1:] + 1, out=moved[:, :-1])
        moved -= steps
        cost = np.minimum.accumulate(moved, axis=1) + steps
    return cost


def verified(
    chars: np.ndarray, index: Index, owner: np.ndarray, low: np.ndarray
) -> Iterator[tuple[int, int, int, int]]:
    """``(piece, start, end, edits)`` in the text, for the bands of the pieces
    ``owner`` starting on the diagonals ``low`` that hold them within their edits.
    Candidates whose pieces are of one length and budget are aligned together."""
    edge = 2 * max(index.widest, 1) + 1
    padded = np.concatenate(
        [np.full(edge, 0xFFFFFFFF, np.uint32), chars, np.full(index.longest + 2 * edge, 0xFFFFFFFF, np.uint32)]
    )
    sizes, edits = index.sizes[owner], index.edits[owner]
    for size, most in set(zip(sizes.tolist(), edits.tolist(), strict=True)):
        width = 2 * max(most, 1) + 1
        own = (sizes == size) & (edits == most) & (low > -size - width) & (low < len(chars))
        numbers, lows = owner[own], np.maximum(low[own], -width)
        for at in range(0, len(lows), CANDIDATES):
            part = slice(at, at + CANDIDATES)
            yield from placed(padded, edge, index, numbers[part], lows[part], size, most)


def placed(
    padded: np.ndarray, edge: int, index: Index, owner: np.ndarray, lows: np.ndarray, size: int, most: int
) -> Iterator[tuple[int, int, int, int]]:
    """The candidates of one length that align within ``most`` edits."""
    width = 2 * max(most, 1) + 1
    kinds, kind = np.unique(owner, return_inverse=True)
    pieces = np.stack([index.pieces[n].chars for n in kinds.tolist()])[kind]
    windows = padded[(lows + edge)[:, None] + np.arange(size + width - 1)]
    ends = aligned(pieces, windows, np.zeros((len(lows), width), np.int32))
    best = ends.argmin(axis=1)
    cost = ends[np.arange(len(lows)), best]
    good = np.flatnonzero(cost <= most)
    if not len(good):
        return
    # From the end back: the diagonal that the alignment starts on.
    closing = np.arange(width, dtype=np.int32) - (width - 1 - best[good])[:, None].astype(np.int32)
    closing[closing < 0] = size
    starts = aligned(pieces[good][:, ::-1], windows[good][:, ::-1], closing)
    begin = lows[good] + width - 1 - starts.argmin(axis=1)
    end = lows[good] + best[good] + size
    found = (owner[good], np.maximum(begin, 0), end, cost[good])
    yield from zip(*(column.tolist() for column in found), strict=True)


def leaks_in(chunk: list[str], index: Index) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``(text number, item_id, piece start, start, end, edits)`` of every piece in
    every text.  Texts are searched together, further apart than any edits reach."""
    gap = np.full(index.widest + 2, 0xFFFFFFFE, np.uint32)
    parts, starts, total = [], [], 0
    for text in chunk:
        own = codes(text)
        starts.append(total)
        parts += [own, gap]
        total += len(own) + len(gap)
    chars = np.concatenate(parts)
    places: dict[int, set[tuple[int, int, int]]] = {}
    for number, *place in verified(chars, index, *index.bands(chars)):
        places.setdefault(number, set()).add(tuple(place))
    begins = np.array(starts)
    for number in sorted(places):
        piece = index.pieces[number]
        for start, end, edits in distinct(places[number]):
            # The ends may lie in the gaps around a text, the middle does not.
            text = int(np.searchsorted(begins, (start + end) // 2, "right")) - 1
            at = starts[text]
            yield text, piece.item_id, piece.start, max(start - at, 0), min(end - at, len(chunk[text])), edits


def distinct(places: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping places of one piece, the one of fewest edits, then first."""
    kept: list[tuple[int, int, int]] = []
    for place in sorted(places, key=lambda p: (p[0], p[1])):
        if kept and place[0] < kept[-1][1]:
            if place[2] < kept[-1][2]:
                kept[-1] = place
        else:
            kept.append(place)
    return kept


def searched(docs: DataFrame, items: list[tuple[int, str]], settings: LeakSettings) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    shape = arrow_schema(RESULT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(shared.value, settings)
        index = Index(pieces, settings) if pieces else None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key")), strict=True))
            rows, held, size, base = [], [], 0, 0
            for n, scalar in enumerate(batch.column("text")):
                held.append(scalar.as_py())
                size += len(held[-1])
                if size >= CHUNK_CHARS or n == len(keys) - 1:
                    if index:
                        rows += [(*keys[base + t], *rest) for t, *rest in leaks_in(held, index)]
                    held, size, base = [], 0, n + 1
            yield record_batch(rows, shape)

    return keyed(docs).mapInArrow(work, RESULT)


def leaks(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings | None = None) -> DataFrame:
    """Every place of a piece of ``benchmark`` (``item_id``, ``text``) in whole texts:
    ``doc_id, text_key, item_id, piece, start, end, edits``.

    The benchmark is sent to all tasks up to ``SHARD_CHARS`` characters at once;
    a larger one is searched shard by shard, each result written before the
    next shard is read.  Null and empty texts and items match nothing; repeated
    rows and items give repeated results; either table may be empty.
    """
    settings = settings or LeakSettings()
    items = benchmark.select(
        F.col("item_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-chars // SHARD_CHARS))
    if shards == 1:
        return searched(docs, [tuple(r) for r in items.collect()], settings)
    found = None
    for n in range(shards):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == n)
        part = materialized(searched(docs, [tuple(r) for r in own.collect()], settings))
        found = part if found is None else found.unionByName(part)
    return found


def leaking_removed(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any place of a benchmark piece, with all their columns."""
    found = materialized(leaks(docs, benchmark).select("doc_id", "text_key").distinct())
    return rejoined(docs, found.withColumn("_leak", F.lit(True))).where("_leak IS NULL").select("row.*")
