"""Secret scan: fixed patterns, and character Markov models of random strings
and of ordinary identifiers compared by their log-likelihood ratio.

The models are trained on the corpus itself.  Long runs of identifier characters
within what a fixed pattern marks as a secret are the random sample, all other
words and identifiers the ordinary one: keys that no pattern knows are so few
among these that they do not look ordinary.  Every document is counted, and only
the two tables of character transitions, whose size is fixed, come to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.columns import arrow_schema, keyed, record_batch

# The base patterns, the least length of each, and their order.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "markov")

# Runs that the models look at: the characters of identifiers and keys.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MARKS = "+/_=-"  # those of them that part words
STATES = len(ALPHABET) + 1  # the last one: where a run starts or ends
BACK_OFF = 10.0
CODES = np.full(128, STATES - 1, np.int64)
CODES[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


@dataclass(frozen=True)
class MarkovSettings:
    """``threshold``: least log-likelihood ratio in favour of random, in nats a
    character; ``spread``: share of each transition that stays uniform, for
    ordinary and for random strings, of which the samples show only a part;
    ``least_chars``: shorter runs and stretches are not judged."""

    threshold: float = 0.8
    spread: tuple[float, float] = (0.02, 0.5)
    least_chars: int = 20


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base patterns, leftmost and non-overlapping
    within each kind."""
    found = []
    folded = text.lower()
    if any(name in folded for name in ASSIGN_NAMES):
        found += [
            (m.start(), m.end(), "assign")
            for m in ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= ASSIGN_CHARS
        ]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def uncovered(text: str, spans: list[tuple[int, int, str]], least: int) -> list[tuple[int, int]]:
    """The parts of all runs that no base span covers, of ``least`` characters and more."""
    parts = []
    covered = sorted((s, e) for s, e, _ in spans)
    for run in RUN.finditer(text):
        at, end = run.span()
        for s, e in covered:
            if s >= end:
                break
            if s - at >= least:
                parts.append((at, s))
            at = max(at, e)
        if end - at >= least:
            parts.append((at, end))
    return parts


def coded(strings: list[str]) -> np.ndarray:
    """State numbers of all strings, each closed by the boundary state."""
    return CODES[np.frombuffer(("\n".join(strings) + "\n").encode("ascii", "replace"), np.uint8)]


def transitions(states: np.ndarray) -> np.ndarray:
    """How often each state follows each other one, the first after a boundary."""
    before = np.concatenate([[STATES - 1], states[:-1]])
    return np.bincount(before * STATES + states, minlength=STATES * STATES)


def samples(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of the ordinary strings of a text, all that no base span covers, and
    of the long runs within base spans, the random ones."""
    spans = base_spans(text)
    states = coded([text])
    random = [run for start, end, _ in spans for run in RUN.findall(text[start:end])]
    for start, end, _ in spans:
        states[start:end] = STATES - 1
    counts = transitions(states)
    counts[-1] = 0  # between boundaries there is nothing
    return counts, transitions(coded(random)) if random else np.zeros_like(counts)


def transition_counts(docs: DataFrame) -> DataFrame:
    """``random, pair, n`` over all documents, summed in each task first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, STATES * STATES), np.int64)
        for batch in batches:
            for scalar in batch.column("text"):
                ordinary, random = samples(scalar.as_py())
                totals[0] += ordinary
                totals[1] += random
        label, pair = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label == 1), pa.array(pair), pa.array(totals[label, pair])],
            ["random", "pair", "n"],
        )

    return (
        keyed(docs)
        .mapInArrow(work, "random boolean, pair bigint, n bigint")
        .groupBy("random", "pair")
        .agg(F.sum("n").alias("n"))
    )


def log_ratio(counts: np.ndarray, settings: MarkovSettings) -> np.ndarray:
    """Log of random over ordinary for each transition; ``counts`` has the
    ordinary ones first.  Rare states back off to how often a state comes at
    all, and each row is mixed with the uniform one, so transitions that a
    sample never showed stay possible."""
    rows = counts.reshape(2, STATES, STATES).astype(float)
    overall = rows.sum(1, keepdims=True) + 1.0 / STATES
    overall /= overall.sum(2, keepdims=True)
    smoothed = (rows + BACK_OFF * overall) / (rows.sum(2, keepdims=True) + BACK_OFF)
    share = np.array(settings.spread).reshape(2, 1, 1)
    mixed = (1 - share) * smoothed + share / STATES
    return (np.log(mixed[1]) - np.log(mixed[0])).ravel()


def trained(docs: DataFrame, settings: MarkovSettings | None = None) -> np.ndarray:
    """The table of log ratios; at most 2 x 68 x 68 counts reach the driver."""
    counts = np.zeros((2, STATES * STATES), np.int64)
    for row in transition_counts(docs).collect():
        counts[int(row["random"]), row["pair"]] = row["n"]
    return log_ratio(counts, settings or MarkovSettings())


def scores(strings: list[str], table: np.ndarray) -> np.ndarray:
    """Mean log ratio of each string's transitions, its ends included."""
    states = coded(strings)
    values = table[np.concatenate([[STATES - 1], states[:-1]]) * STATES + states]
    sizes = np.array([len(s) + 1 for s in strings])
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) / sizes


def best_stretch(gains: np.ndarray, least: int) -> tuple[int, int] | None:
    """The part of ``least`` and more characters whose gains have the largest sum,
    if that is not below 0."""
    if len(gains) < least:
        return None
    sums = np.concatenate([[0.0], np.cumsum(gains)])
    before = np.minimum.accumulate(sums[: len(sums) - least])
    over = sums[least:] - before
    end = int(over.argmax())
    if over[end] < 0:
        return None
    return int(sums[: end + 1].argmin()), end + least


def stretches(part: str, table: np.ndarray, settings: MarkovSettings) -> list[tuple[int, int]]:
    """Random stretches of a string that is not random as a whole: the best one, then
    those of what is left on either side.  A stretch goes on to the next mark
    between words, so no end of a key is left over."""
    states = coded([part])[:-1]
    values = table[np.concatenate([[STATES - 1], states[:-1]]) * STATES + states]
    gains = values - settings.threshold
    found, open_parts = [], [(0, len(part))]
    while open_parts:
        low, high = open_parts.pop()
        best = best_stretch(gains[low:high], settings.least_chars)
        if best is None:
            continue
        start, end = low + best[0], low + best[1]
        while start > low and part[start - 1] not in MARKS and part[start] not in MARKS:
            start -= 1
        while end < high and part[end] not in MARKS and part[end - 1] not in MARKS:
            end += 1
        found.append((start, end))
        open_parts += [(low, start), (end, high)]
    return found


def found_spans(
    text: str, table: np.ndarray, settings: MarkovSettings
) -> list[tuple[int, int, str]]:
    """All spans, ordered by start and then by kind as listed.

    What base spans leave of a run is judged by itself.  A part is random as a
    whole, or else the stretches of it that are."""
    spans = base_spans(text)
    parts = uncovered(text, spans, settings.least_chars)
    if parts:
        high = scores([text[s:e] for s, e in parts], table) >= settings.threshold
        for (start, end), whole in zip(parts, high.tolist(), strict=True):
            own = [(0, end - start)] if whole else stretches(text[start:end], table, settings)
            spans += [(start + s, start + e, "markov") for s, e in own]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


RESULT = "doc_id bigint, text_key bigint, spans array<struct<start:bigint,end:bigint,kind:string>>"


def secrets(docs: DataFrame, settings: MarkovSettings | None = None) -> DataFrame:
    """One row a document: ``doc_id, text_key, spans``, an array of start, end (exclusive, in code
    points) and kind.

    Null and empty texts have none; repeated rows stay repeated; an empty table
    gives an empty one and trains nothing.
    """
    settings = settings or MarkovSettings()
    table = trained(docs, settings)
    shape = arrow_schema(RESULT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_pylist() for c in ("doc_id", "text_key"))
            rows = []
            for doc_id, key, text in zip(ids, keys, batch.column("text"), strict=True):
                found = found_spans(text.as_py(), table, settings)
                rows.append((doc_id, key, [{"start": s, "end": e, "kind": k} for s, e, k in found]))
            yield record_batch(rows, shape)

    return keyed(docs).mapInArrow(work, RESULT)


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every secret masked and ``n_chars``, where there
    is one, counted anew; a null text stays null.  Texts without a secret are
    left alone."""
    settings = MarkovSettings()
    table = trained(docs, settings)

    def masked(text: str) -> str:
        out, at = [], 0
        for start, end, _ in found_spans(text, table, settings):
            if start >= at:
                out += [text[at:start], mask]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = [None if t is None else masked(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    clean = docs.mapInArrow(work, docs.schema)
    if "n_chars" in docs.columns:
        clean = clean.withColumn(
            "n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
        )
    return clean
