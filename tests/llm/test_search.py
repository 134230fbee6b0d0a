"""Ranked search against scoring every document, its bounds, and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tablewright.llm import lexical
from tests.llm.texts import ascii_lower, documents, plain_rows, sample_texts, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def terms(text):
    return TERM.findall(ascii_lower(text or ""))


def plain_search(rows, items, top):
    counts = [Counter(terms(t)) for _, t in rows]
    sizes = [sum(c.values()) for c in counts]
    n_docs, total = sum(map(bool, sizes)), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item_id, text in set(items):
        scores = []
        for (doc_id, _), c, size in zip(rows, counts, sizes):
            score = 0
            for t in set(terms(text)) & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + (50 * size * n_docs) // total
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            scores.append((score, doc_id))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is not None, s[1] or 0))
        out += [(item_id, k + 1, d, s) for k, (s, d) in enumerate(best[:top])]
    return out


def found(frame):
    return sorted(map(repr, map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect())))


def vocabulary(n=400):
    return [f"w{k}" for k in range(n)] + ["É", "naïve", "x1", "1", "漢字"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    own = [words(rnd, rnd.randrange(1, 120), vocabulary()) for _ in range(150)]
    own += [own[0]] * 40 + [words(rnd, 9000, vocabulary()), "W1 w1-W2;w3_W4", "!!! ...", "\x00w5\x1fw6"]
    return own + sample_texts()


@pytest.fixture(scope="module")
def items():
    rnd = random.Random(4)
    rows = [(n, words(rnd, rnd.randrange(1, 30), vocabulary())) for n in range(25)]
    rows += [(30, None), (31, ""), (32, "?!"), (33, "unheardof"), (3, rows[3][1]), (4, "w1 w2"), (None, "w7 é")]
    return rows


@pytest.mark.parametrize("width, top, at_once", [(1 << 24, 50, 1000), (64, 7, 1000), (1, 3, 10)])
def test_search_scores_every_document(spark, texts, items, width, top, at_once):
    """Also where all terms meet on a few coordinates, and in several lookups."""
    docs = documents(spark, texts, extra=True)
    settings = lexical.SearchSettings(top=top, width=width, items=at_once)
    got = lexical.ranked_search(docs, spark.createDataFrame(items, ITEMS), settings)
    want = plain_search(plain_rows(docs), items, top)
    assert found(got) == sorted(map(repr, want))


def test_bounds_are_never_below_scores(spark, texts):
    docs = documents(spark, texts)
    for width in (1 << 24, 128):
        sketched = lexical.sketches(docs, width)
        weights = [{t: 1 + k for k, t in enumerate(lexical.terms(b"w1 w2 w3 w7 w9 w20"))}, {b"w1": 9}]
        lookup = lexical.Lookup(weights, len(texts), 10_000, width)
        pairs = lexical.bounds_from(sketched, lookup, np.zeros(2)).drop("text_key").collect()
        assert len(pairs) == 2 * sketched.count()
        scores = {}
        for doc_id, text in plain_rows(docs):
            counts = Counter(lexical.terms((text or "").encode()))
            share = lexical.length_share(sum(counts.values()), len(texts), 10_000)
            for item in (0, 1):
                scores[doc_id, item] = lookup.score(item, counts, share)
        assert all(r.bound >= scores[r.doc_id, r.item] for r in pairs)
        if width > 128:
            assert all(r.bound == scores[r.doc_id, r.item] for r in pairs)


def test_empty_tables(spark, texts, items):
    docs = documents(spark, texts)
    none = spark.createDataFrame([], ITEMS)
    assert not lexical.ranked_search(docs, none).count()
    assert not lexical.ranked_search(docs.limit(0), spark.createDataFrame(items, ITEMS)).count()
    nothing = spark.createDataFrame([(1, "?"), (2, None)], ITEMS)
    assert not lexical.ranked_search(docs, nothing).count()
    assert not lexical.ranked_search(nothing.withColumnRenamed("item_id", "doc_id"), none).count()


def test_copies_rank_by_id(spark):
    docs = spark.createDataFrame([(n, "the same text") for n in range(500)] + [(900, "other")], "doc_id bigint, text string")
    got = lexical.ranked_search(docs, spark.createDataFrame([(1, "text other")], ITEMS)).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)][:3] == [900, 0, 1]
    assert len(got) == 50
