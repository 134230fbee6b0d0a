"""Words and runs of words of many texts at once, as arrays of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
# Fixed draws: a number for each byte and for each place in a run.
DRAWS = np.random.default_rng(20240611)
OF_BYTE = DRAWS.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
OF_PLACE = DRAWS.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0xD1342543DE82EF95)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(values: np.ndarray) -> np.ndarray:
    out = values ^ (values >> np.uint64(32))
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every run of bytes that are no white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[data]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    powers = np.ones(int(sizes.max()) + 1, np.uint64)
    powers[1:] = STEP
    powers = np.cumprod(powers)
    begin = np.zeros(len(data), np.int64)
    begin[starts] = np.diff(starts, prepend=0)
    place = np.arange(len(data)) - np.cumsum(begin)
    place[IS_SPACE[data]] = 0
    values = OF_BYTE[data] * powers[np.clip(place, 0, len(powers) - 1)]
    values[IS_SPACE[data]] = 0
    return mixed(np.add.reduceat(values, starts) + sizes.astype(np.uint64))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive words."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += words[j : j + n] * OF_PLACE[j]
    return mixed(out)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each closed by a line feed, and where each begins."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return data, np.cumsum(sizes) - sizes


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that little is held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_chunks(
    batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], size: int = CHUNK_BYTES
) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Rows of ``columns`` and their texts as UTF-8, at most ``size`` bytes of text
    together but for the last."""
    rows: list[tuple] = []
    held: list[bytes] = []
    total = 0
    for batch in small_batches(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        own = zip(*(batch.column(c).to_pylist() for c in columns), strict=True)
        for row, text in zip(own, texts, strict=True):
            rows.append(row)
            held.append(text)
            total += len(text)
            if total >= size:
                yield rows, held
                rows, held, total = [], [], 0
    if rows:
        yield rows, held
