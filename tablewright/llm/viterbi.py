"""Token counts of a unigram vocabulary by a Viterbi pass that keeps no pieces.

An Aho-Corasick automaton lists every vocabulary entry in a word with the place
where it ends; the pass carries, for each place, the best score that reaches it
and how many pieces that takes.  Ties go as in the unigram tokenizer this
counts for: an entry replaces another that ends at the same place only with a
strictly higher score, and the one that starts first is seen first.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm.columns import texts

# Fixed values of the tokenizer: the mark of a word's start, and how much lower
# than the lowest entry an unknown character scores.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
WORDS_KEPT = 200_000


def pieces_of(model_file: str) -> list[tuple[str, float]]:
    """``(piece, score)`` of the ordinary entries of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


class Counter:
    """Counts pieces of words; unknown characters that follow each other are one
    piece."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(0.0, *(s for _, s in pieces)) - UNKNOWN_PENALTY

    def count(self, word: str) -> int:
        n = len(word)
        score: list[float | None] = [0.0] + [None] * n
        pieces = [0] * (n + 1)
        unknown = [False] * (n + 1)
        single = [False] * n
        done = 0

        def close(end: int) -> None:
            """An unknown character up to ``end``, unless it is an entry itself."""
            if single[end - 1]:
                return
            reached = score[end - 1] + self.unknown
            if score[end] is None or reached > score[end]:
                score[end] = reached
                pieces[end] = pieces[end - 1] + (not unknown[end - 1])
                unknown[end] = True

        for last, (length, value) in self.automaton.iter(word):
            end = last + 1
            while done < end - 1:
                done += 1
                close(done)
            start = end - length
            if length == 1:
                single[start] = True
            reached = score[start] + value
            if score[end] is None or reached > score[end]:
                score[end] = reached
                pieces[end] = pieces[start] + 1
                unknown[end] = False
        while done < n:
            done += 1
            close(done)
        return pieces[n]


def words_of(text: str) -> list[str]:
    """The text with spaces as marks, one in front, cut before every mark."""
    if not text:
        return []
    marked = text.replace(" ", MARK)
    parts = marked.split(MARK)
    head = [MARK + parts[0]] if not marked.startswith(MARK) else []
    return head + [MARK + p for p in parts[1:]]


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of whole texts, map-only.

    The vocabulary is a file of fixed size, sent to the tasks; counts of words
    seen lately are kept, up to a fixed number, in each task.  Null and empty
    texts count 0; repeated rows stay repeated; an empty table gives an empty
    one; other columns are left behind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = Counter(shared.value), {}
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("text"):
                total, own = 0, words_of(text.as_py())
                for word in own:
                    count = known.get(word)
                    if count is None:
                        if len(known) >= WORDS_KEPT:
                            known.clear()
                        count = known[word] = counter.count(word)
                    total += count
                words.append(len(own))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )

    return texts(docs).mapInArrow(work, "doc_id bigint, n_words bigint, n_tokens bigint")
