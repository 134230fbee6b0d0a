"""Language identification against a plain naive Bayes, on held-out rows, and odd rows."""

import math
import random
from collections import Counter
from zlib import crc32

import pytest

from tablewright.llm import languages
from tablewright.llm.columns import given
from tests.llm.texts import DOC_SCHEMA, EXTRA, documents, sample_texts

WORDS = {
    "xa": "ant bee cat dog eel fox".split(),
    "xb": "zug wöhr öde über äcker".split(),
    "xc": "ñu año óso vía uña".split(),
}


def grams(text):
    chars = [c if c.isalpha() else " " for c in f" {text or ''} "]
    low = [c.lower() if len(c.lower()) == 1 else c for c in chars]
    for i in range(1, len(low) - 1):
        if low[i] != " ":
            yield low[i - 1 : i + 2]
            yield low[i : i + 2]
            if low[i - 1] == " ":
                yield low[i - 1 : i + 1]


def bucket(gram, bits=16):
    factors = languages.THREE if len(gram) == 3 else languages.TWO
    return (sum(ord(c) * f for c, f in zip(gram, factors)) % 2**32) >> (32 - bits)


def plain_languages(rows, bits=16):
    """Rows of doc_id, text, lang."""
    held = [d is not None and crc32(str(d).encode()) % 4 == 2 for d, _, _ in rows]
    learned = [(t, lang) for (d, t, lang), h in zip(rows, held) if not h and d is not None and lang is not None]
    counts, docs = {}, Counter(lang for _, lang in learned)
    for text, lang in learned:
        counts.setdefault(lang, Counter()).update(bucket(g, bits) for g in grams(text))
    out = []
    for (doc_id, text, _), h in zip(rows, held):
        found = Counter(bucket(g, bits) for g in grams(text))
        scores = {}
        for lang in docs:
            own = counts.get(lang, Counter())
            total = sum(own.values()) + 0.1 * 2**bits
            scores[lang] = math.floor(1e6 * math.log(docs[lang] / sum(docs.values()))) + sum(
                k * math.floor(1e6 * math.log((own[b] + 0.1) / total)) for b, k in found.items()
            )
        if not found or not scores:
            out.append((doc_id, h, "und", 0.0))
            continue
        best = min(scores, key=lambda lang: (-scores[lang], lang.encode()))
        sure = 1 / sum(math.exp((s - scores[best]) / 1e6) for s in scores.values())
        out.append((doc_id, h, best, round(sure, 6)))
    return out


def same(got, want):
    key = lambda r: (repr(r[:3]), r[3])
    got, want = (sorted(map(tuple, rows), key=key) for rows in (got, want))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) <= 1.1e-6 for g, w in zip(got, want))


def labelled(n=200, seed=2):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rnd.choice(sorted(WORDS))
        text = " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randrange(1, 12)))
        rows.append((k, rnd.choice([text, text.upper(), text + " 12, x!"]), rnd.choice([lang, lang, None]), "s", 1))
    rows += [(n, None, "xa", None, None), (n + 1, "", "xb", "s", 0), (n + 2, "12 !?", "", "s", 0)]
    rows += [(None, "ant bee", "xa", "s", 1), (None, "zug", "only here", "s", 1), rows[0], rows[0]]
    rows += [(n + 3, "ſ İstanbul ß 漢字 Ǆ", "xd", "s", 3), (n + 5, "漢", None, "s", 1)]
    return rows


@pytest.mark.parametrize("bits, cells", [(16, 1 << 22), (16, 1 << 13), (10, 1 << 22)])
def test_matches_plain_naive_bayes(spark, bits, cells):
    rows = labelled()
    docs = spark.createDataFrame([(*r, 1, "k", "s", "c", "r") for r in rows], DOC_SCHEMA + EXTRA).repartition(3)
    got = languages.languages(docs, languages.LanguageSettings(buckets=1 << bits, cells=cells)).collect()
    known = len({r[2] for r in rows if r[2] is not None and r[0] is not None and crc32(str(r[0]).encode()) % 4 != 2})
    bits = min(bits, (cells // known).bit_length() - 1)
    same(got, plain_languages([r[:3] for r in rows], bits))


def test_long_and_odd_texts_in_small_blocks(spark, monkeypatch):
    """Blocks that cut texts anywhere give what whole texts give."""
    monkeypatch.setattr(languages, "CHUNK_CHARS", 900)
    monkeypatch.setattr(languages, "GRAMS", 37)
    texts = sample_texts()
    docs = documents(spark, texts)
    model = languages.trained(docs)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    same(languages.predicted(docs, model).collect(), plain_languages(rows))
    some = [t for t in texts if t]
    totals, lettered = languages.scores(some, model)
    for text, row, has in zip(some, totals.tolist(), lettered.tolist()):
        found = Counter(bucket(g) for g in grams(text))
        assert has == bool(found)
        assert row[0] == model.prior[0] + sum(k * int(model.table[b, 0]) for b, k in found.items())


def test_nothing_to_learn(spark):
    rows = [(1, "some text", None, "s", 1), (2, None, None, "s", 1)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    assert {(r.lang_pred, r.score) for r in languages.languages(docs).collect()} == {("und", 0.0)}
    assert not languages.languages(docs.limit(0)).count()


def test_too_many_languages_are_an_error(spark):
    rows = [(n, "text", f"l{n}", "s", 1) for n in range(40)]
    with pytest.raises(ValueError, match="languages"):
        languages.languages(spark.createDataFrame(rows, DOC_SCHEMA), languages.LanguageSettings(cells=1 << 10))


def test_predictions_use_the_text_alone(spark):
    docs = spark.createDataFrame(labelled(), DOC_SCHEMA)
    model = languages.trained(docs)
    other = docs.selectExpr("doc_id", "text", "'zz' AS lang", "'other' AS source", "-1L AS n_chars")
    key = "doc_id", "held_out", "lang_pred", "score"
    assert sorted(map(repr, languages.predicted(other, model).select(*key).collect())) == sorted(
        map(repr, languages.predicted(docs, model).select(*key).collect())
    )


def test_held_out_accuracy(spark):
    docs = given(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in languages.languages(docs).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.collect() if got[r.doc_id].held_out]
    assert len(held) > 200
    assert sum(a == b for a, b in held) / len(held) >= 0.99
