"""Language identification: multinomial naive Bayes over hashed character n-grams.

Grams lie around letters: each letter with its neighbours, and each pair of
neighbours of which one is a letter; whatever is no letter counts as a space.
They are hashed into buckets, counted by language over all labelled documents,
and the matrix of log-probabilities (buckets by languages, of bounded size) is
sent to every task.  A text's score for a language is the sum of its grams'
rows.  Log-probabilities are whole numbers of a millionth, so sums are exact
and the same in whatever order and blocks they are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.columns import arrow_schema

# Factors of the hash, one for each character of a gram of three and of two.
THREE = (2654435761, 2246822519, 3266489917)
TWO = (668265263, 374761393)
HASH_BITS = 32
SPACE = 32
LOG_SCALE = 1_000_000
UNDETERMINED = "und"
# Characters of texts, and grams, that are looked at together.
CHUNK_CHARS = 1 << 20
GRAMS = 1 << 19
LEAST_BUCKETS = 256

COUNTS = "lang string, bucket int, n bigint"
RESULT = "doc_id bigint, held_out boolean, lang_pred string, score double"


@dataclass(frozen=True)
class LanguageSettings:
    """``buckets``: of the hash, a power of two; ``cells``: most buckets times
    languages, so the matrix that is sent around stays under ``4 * cells`` bytes
    and many languages share fewer buckets; ``smoothing``: added to each count;
    ``held_out``: documents of which remainder, of how many, are never learned from."""

    buckets: int = 1 << 16
    cells: int = 1 << 22
    smoothing: float = 0.1
    held_out: tuple[int, int] = (2, 4)


@dataclass
class Model:
    """Languages in ascending order, log-probabilities of buckets by languages, and
    of the languages themselves."""

    languages: list[str]
    table: np.ndarray
    prior: np.ndarray


@lru_cache(1)
def letter_codes() -> np.ndarray:
    """For each code point its lower-case letter, or a space where it is none."""
    lowered = ((c, c.lower()) for c in map(chr, range(0x110000)))
    return np.array(
        [ord(low if len(low) == 1 else c) if c.isalpha() else SPACE for c, low in lowered], np.uint32
    )


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts in one row, spaces around each; where the letters are;
    and at which of them each text begins, with the end as the last."""
    joined = "\n".join(["", *texts, ""])
    codes = letter_codes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    at = np.flatnonzero(codes != SPACE)
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return codes, at, np.searchsorted(at, begins)


def grams(codes: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the grams around the letters ``at``, and which of these each is of."""
    before, own, after = codes[at - 1], codes[at], codes[at + 1]
    first = np.flatnonzero(before == SPACE)
    shift = np.uint32(HASH_BITS - (buckets.bit_length() - 1))

    def hashed(factors: tuple[int, ...], *chars: np.ndarray) -> np.ndarray:
        total = sum(c * np.uint32(f) for c, f in zip(chars, factors, strict=True))
        return (total >> shift).astype(np.int64)

    found = [
        hashed(THREE, before, own, after),
        hashed(TWO, own, after),
        hashed(TWO, before[first], own[first]),
    ]
    each = np.arange(len(at))
    return np.concatenate(found), np.concatenate([each, each, first])


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of parts of a batch, null texts as empty ones."""
    held, size, first = [], 0, 0
    for n, scalar in enumerate(batch.column("text")):
        held.append(scalar.as_py() or "")
        size += len(held[-1])
        if size >= CHUNK_CHARS or n == len(batch) - 1:
            yield first, held
            held, size, first = [], 0, n + 1


def blocks(at: np.ndarray) -> Iterator[np.ndarray]:
    for low in range(0, len(at), GRAMS):
        yield at[low : low + GRAMS]


def remainder_of(doc_id: str, parts: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))


def learned_from(docs: DataFrame, settings: LanguageSettings) -> DataFrame:
    """Texts with the languages to learn from: labelled, with an id, not held out."""
    number, parts = settings.held_out
    return docs.where(remainder_of("doc_id", parts) != number).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    ).where("lang IS NOT NULL")


def gram_counts(labelled: DataFrame, buckets: int) -> DataFrame:
    """``lang, bucket, n`` over whole texts; each task adds up its own first."""
    shape = arrow_schema(COUNTS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = batch.column("lang").to_pylist()
            for first, held in chunks(batch):
                by_language: dict[str, list[str]] = {}
                for lang, text in zip(languages[first : first + len(held)], held, strict=True):
                    by_language.setdefault(lang, []).append(text)
                for lang, own in by_language.items():
                    total = totals.setdefault(lang, np.zeros(buckets, np.int64))
                    codes, at, _ = letters_of(own)
                    for block in blocks(at):
                        total += np.bincount(grams(codes, block, buckets)[0], minlength=buckets)
        for lang, total in totals.items():
            bucket = np.flatnonzero(total)
            columns = [[lang] * len(bucket), bucket, total[bucket]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape
            )

    counted = labelled.mapInArrow(work, COUNTS)
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def trained(docs: DataFrame, settings: LanguageSettings | None = None) -> Model:
    """The model of all documents that may be learned from.

    Only counts by language and by (language, bucket) reach the driver, at most
    ``settings.cells`` of them.  More languages than there is room for with
    ``LEAST_BUCKETS`` buckets each are an error, so none is left out in silence.
    """
    settings = settings or LanguageSettings()
    labelled = learned_from(docs, settings)
    most = settings.cells // LEAST_BUCKETS
    rows = labelled.groupBy("lang").count().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} languages; raise cells")
    documents = {r["lang"]: r["count"] for r in rows}
    languages = sorted(documents, key=str.encode)
    if not languages:
        return Model([], np.zeros((settings.buckets, 0), np.int32), np.zeros(0, np.int64))
    room = 1 << (settings.cells // len(languages)).bit_length() - 1
    buckets = min(settings.buckets, room)
    found = gram_counts(labelled, buckets).toArrow()
    place = {lang: n for n, lang in enumerate(languages)}
    counts = np.zeros((buckets, len(languages)))
    numbers = np.array([place[lang] for lang in found.column("lang").to_pylist()], np.int64)
    counts[found.column("bucket").to_numpy(), numbers] = found.column("n").to_numpy()
    share = (counts + settings.smoothing) / (counts.sum(0) + settings.smoothing * buckets)
    known = np.array([documents[lang] for lang in languages])
    return Model(
        languages,
        np.floor(LOG_SCALE * np.log(share)).astype(np.int32),
        np.floor(LOG_SCALE * np.log(known / known.sum())).astype(np.int64),
    )


def scores(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text for each language, and which texts have a letter."""
    codes, at, begins = letters_of(texts)
    out = np.tile(model.prior, (len(texts), 1))
    held = np.flatnonzero(np.diff(begins))
    starts = begins[held]
    for low in range(0, len(at), GRAMS):
        block = at[low : low + GRAMS]
        bucket, letter = grams(codes, block, len(model.table))
        # The letters of a block by text, then grams put with their letter's text.
        inside = np.flatnonzero((starts < low + len(block)) & (np.append(starts[1:], len(at)) > low))
        text = np.searchsorted(np.maximum(starts[inside] - low, 0), letter, "right") - 1
        order = np.argsort(text, kind="stable")
        cuts = np.searchsorted(text[order], np.arange(len(inside)))
        sums = np.add.reduceat(model.table[bucket[order]], cuts, axis=0, dtype=np.int64)
        out[held[inside]] += sums
    return out, np.diff(begins) > 0


def predicted(docs: DataFrame, model: Model, held_out: tuple[int, int] = (2, 4)) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: from the text alone.

    ``score`` is the probability of the language among the learned ones, to six
    places.  A text without a letter, a null one, or any text where nothing was
    learned is ``und`` with score 0; equal languages go by the least name.  A
    null id is not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shape = arrow_schema(RESULT)

    def judged(texts: list[str]) -> tuple[list[str], np.ndarray]:
        known = shared.value
        if not known.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        totals, lettered = scores(texts, known)
        best = totals.argmax(axis=1)
        margins = totals - totals.max(axis=1, keepdims=True)
        sure = np.where(lettered, 1 / np.exp(margins / LOG_SCALE).sum(axis=1), 0.0)
        names = np.where(lettered, best, -1).tolist()
        return [known.languages[n] if n >= 0 else UNDETERMINED for n in names], np.round(sure, 6)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in chunks(batch):
                own = batch.slice(first, len(held))
                names, sure = judged(held)
                columns = [own.column("doc_id"), own.column("held_out"), pa.array(names), pa.array(sure)]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, shape, strict=True)], schema=shape
                )

    number, parts = held_out
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(remainder_of("doc_id", parts) == number, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(work, RESULT)


def languages(docs: DataFrame, settings: LanguageSettings | None = None) -> DataFrame:
    """Learn from ``docs`` (``doc_id``, ``text``, ``lang``) and predict each row's
    language: ``doc_id, held_out, lang_pred, score``, as `predicted` has them.

    Repeated rows count and stay repeated, columns of other names do no harm, an
    empty table gives an empty one, and where no row is labelled all are ``und``.
    """
    settings = settings or LanguageSettings()
    return predicted(docs, trained(docs, settings), settings.held_out)
