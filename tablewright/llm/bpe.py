"""Byte-level BPE by a pair occurrence index.

Each task takes its documents in chunks of bounded size.  The distinct words of
a chunk lie in one array of symbols.  The index maps every adjacent pair that
has a rank to all its positions in the chunk; ranks are applied in ascending
order, each to all its positions at once, and the pairs that a merge makes to
its left and right enter the lists of their own ranks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tablewright.llm.columns import arrow_schema, record_batch, texts

# Fixed value: how byte-level vocabularies split text into words.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    r"| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
CHUNK_CHARS = 8 << 20


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies:
    itself where it prints, else the next free one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary as arrays; a file of fixed size, whatever the corpus."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        ids, stands = whole["model"]["vocab"], printable_bytes()
        self.size = 1 + max([*ids.values(), *(t["id"] for t in whole["added_tokens"])])
        self.bytes = [b""] * self.size
        for token, i in ids.items():
            self.bytes[i] = bytes(stands[c] for c in token)
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for char, b in stands.items():
            self.of_byte[b] = ids[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in whole["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = self.left * self.size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], -1)


class PairIndex:
    """Rank -> positions of its pair; positions outdated by a later merge are
    found when their rank comes up."""

    def __init__(self):
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        held = ranks >= 0
        ranks, positions = ranks[held], positions[held]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        starts = [0, *cuts.tolist()]
        for rank, part in zip(ranks[starts].tolist(), np.split(positions, cuts), strict=True):
            if rank not in self.lists:
                self.lists[rank] = []
                heapq.heappush(self.active, rank)
            self.lists[rank].append(part)

    def lowest(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.active)
        return rank, np.unique(np.concatenate(self.lists.pop(rank)))


def merged(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words one after the other, and the number of each word's."""
    sizes = np.array([len(w) for w in words], np.int64)
    symbol = vocab.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(symbol)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(sizes)
    after[ends - 1] = -1
    before[(ends - sizes)[sizes > 0]] = -1
    alive = np.ones(n, bool)
    index = PairIndex()
    first = np.flatnonzero(after >= 0)
    index.add(vocab.ranks(symbol[first], symbol[first + 1]), first)
    while index.active:
        rank, at = index.lowest()
        left, right, made = vocab.left[rank], vocab.right[rank], vocab.made[rank]
        at = at[alive[at] & (symbol[at] == left) & (after[at] >= 0)]
        at = at[symbol[after[at]] == right]
        if left == right and len(at):
            at = leftmost(at, after)
        if not len(at):
            continue
        gone = after[at]
        following = after[gone]
        symbol[at], alive[gone], after[at] = made, False, following
        more = following >= 0
        before[following[more]] = at[more]
        previous = before[at]
        where = np.concatenate([previous[previous >= 0], at[more]])
        index.add(vocab.ranks(symbol[where], symbol[after[where]]), where)
    word_of = np.repeat(np.arange(len(words)), sizes)
    return symbol[alive], np.bincount(word_of[alive], minlength=len(words))


def leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of pairs of one symbol with itself that overlap: every other from the left."""
    linked = np.zeros(len(at), bool)
    linked[1:] = after[at[:-1]] == at[1:]
    place = np.arange(len(at))
    start = np.maximum.accumulate(np.where(linked, 0, place))
    return at[(place - start) % 2 == 0]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of consecutive runs: start, start + 1, ... for each size."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def encoded(chunk: list[str], vocab: Vocabulary) -> list[np.ndarray]:
    """The ids of each text; strings of special tokens in a text are those tokens."""
    pattern = regex.compile(WORDS)
    special = regex.compile("(" + "|".join(map(regex.escape, vocab.special)) + ")")
    seen: dict[str, int] = {}
    word_ids, counts = [], []
    for text in chunk:
        own: list[int] = []
        for part in special.split(text) if vocab.special else [text]:
            if part in vocab.special:
                own.append(seen.setdefault(part, len(seen)))
            elif part:
                own.extend([seen.setdefault(w, len(seen)) for w in pattern.findall(part)])
        word_ids.append(np.array(own, np.int32))
        counts.append(len(own))
    if not seen:
        return [np.zeros(0, np.uint32) for _ in chunk]
    words = list(seen)
    plain = [i for i, w in enumerate(words) if w not in vocab.special]
    ids, lengths = merged([words[i].encode() for i in plain], vocab)
    sizes = np.ones(len(words), np.int64)
    sizes[plain] = lengths
    starts = np.cumsum(sizes) - sizes
    table = np.zeros(int(sizes.sum()), np.uint32)
    table[spread(starts[plain], sizes[plain])] = ids
    for token, i in vocab.special.items():
        if token in seen:
            table[starts[seen[token]]] = i
    return [table[spread(starts[w], sizes[w])] for w in word_ids]


def decoded(ids: np.ndarray, vocab: Vocabulary) -> str:
    """The text of ids, special tokens included; bytes that are no UTF-8 become
    replacement characters."""
    return b"".join(map(vocab.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def chunks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list[str]]]:
    """``doc_id``s and texts, gathered until their texts have ``chars`` characters."""
    ids: list = []
    held: list[str] = []
    total = 0
    for batch in batches:
        for doc_id, text in zip(
            batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True
        ):
            ids.append(doc_id)
            held.append(text)
            total += len(text)
            if total >= chars:
                yield ids, held
                ids, held, total = [], [], 0
    if ids:
        yield ids, held


def coded(batches: Iterator[pa.RecordBatch], vocab: Vocabulary) -> Iterator[tuple]:
    """``doc_id``, ids and decoded text of each document."""
    for ids, held in chunks(batches, CHUNK_CHARS):
        for doc_id, tokens in zip(ids, encoded(held, vocab), strict=True):
            yield doc_id, tokens, decoded(tokens, vocab)


def mapped(docs: DataFrame, path: str, schema: str, row: Callable) -> DataFrame:
    """``row(doc_id, ids, decoded)`` of each document, under ``schema``."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    shape = arrow_schema(schema)

    def work(batches):
        held, size = [], 0
        for document in coded(batches, shared.value):
            held.append(row(*document))
            size += len(document[2])
            if len(held) >= 4096 or size >= CHUNK_CHARS:
                yield record_batch(held, shape)
                held, size = [], 0
        if held:
            yield record_batch(held, shape)

    return texts(docs).mapInArrow(work, schema)


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of whole texts, map-only.

    A null or empty text has no ids and decodes to the empty text; repeated
    rows stay repeated; other columns are left behind; an empty table gives an
    empty one.
    """
    return mapped(
        docs, path, "doc_id bigint, ids array<int>, decoded string", lambda i, t, d: (i, t.astype(np.int32), d)
    )


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what ``tokens`` gives."""
    return mapped(
        docs,
        path,
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        lambda i, t, d: (
            i,
            len(t),
            hashlib.sha256(t.astype("<u4").tobytes()).hexdigest(),
            hashlib.sha256(d.encode()).hexdigest(),
        ),
    )
