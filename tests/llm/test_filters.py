"""Quality rules, licenses and leaks against plain versions."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import decontamination as dc
from tablewright.llm.licenses import PHRASES, TEMPLATES, license_scan
from tablewright.llm.quality import HostRules, quality_verdicts, rejected_removed

from .texts import WORD, ascii_lower, documents, plain_rows, sample_texts

LINES = ["x y", "x y", " ", "", "x y", "<a> & b|c $5 %"]
TEXTS = [*sample_texts(n=25), "\n".join(LINES), "a b c a b c a", "a a a a", " ".join("abcd" * 20)]


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + d for at in seen.values() if len(at) > 1 for i in at for d in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    dup = len(lines) - len(set(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_counts_of_every_document(spark):
    docs = documents(spark, TEXTS, extra=True)
    got = quality_verdicts(docs).collect()
    want = sorted(repr((d, *plain_counts(t))) for d, t in plain_rows(docs))
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert quality_verdicts(docs.where("false")).count() == 0
    kept = rejected_removed(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in got)


def test_bad_host_is_held_to_stricter_limits(spark):
    rnd = random.Random(2)

    def good():
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(80))

    noisy = " ".join(f"{w}%" for w in good().split())  # fails a strict rule alone
    rows = [(i, noisy if i % 5 else good(), "bad") for i in range(200)]
    rows += [(1000 + i, noisy if i < 2 else good(), "fine") for i in range(200)]
    rows += [(2000, noisy, "single"), (2001, good(), None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in quality_verdicts(frame).collect()}
    assert {r.host for r in got.values() if r.host_failed} >= {"bad"}
    assert not got[1000].host_failed and got[1000].kept and got[2001].kept
    assert all(got[i].kept == (i % 5 == 0) for i in range(200))
    # One document says little about its host.
    assert got[2000].host_rate < got[1].host_rate
    assert HostRules().max_rate == 0.5


def test_plain_junk_goes_on_an_ordinary_host(spark):
    rnd = random.Random(3)

    def good():
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(80))

    # Junk on every fifth document of each host, as hosts are where none is bad.
    rows = [
        (i, " ".join(f"{w}***" for w in good().split()) if i % 5 == 0 else good(), f"h{i % 4}")
        for i in range(400)
    ]
    slight = " ".join(w + "%" * (i % 5 < 2) for i, w in enumerate(good().split()))  # 40 in a hundred
    rows.append((400, slight, "h0"))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in quality_verdicts(frame).collect()}
    assert not any(r.host_failed or r.base_failed for r in got.values())
    assert all(got[i].kept == (i % 5 != 0) for i in range(400))
    assert got[400].strict_failed and got[400].kept
    plain = quality_verdicts(frame, rules=HostRules(weighted=False))
    assert plain.where("NOT kept").count() == 0


def plain_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
    found = [
        (i, label)
        for phrase, label in PHRASES.items()
        for i in range(len(w))
        if w[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in found]
    labels = ",".join(sorted({x for _, x in found}))
    return len(w), len(at), min(at, default=None), max(at, default=None), labels


LICENSED = [
    "x All rights, reserved. y ALL RIGHTS RESERVED",
    "CC BY-SA cc-by",
    "the General Public  License; İ K all rights reservedK",
    "Released under the MIT License.",
    "some words and licensed under the Apache License, Version 2.0 (the License) and more",
    "licensed under the moon",
    TEMPLATES["bsd"].replace("with or", "with new or"),
    " ".join(["all rights reserved"] * 50),
]


def test_licenses(spark):
    docs = documents(spark, [*sample_texts(n=5), *LICENSED], extra=True)
    got = license_scan(docs).collect()
    want = sorted(repr((d, *plain_base(t))) for d, t in plain_rows(docs))
    columns = "doc_id n_words n_base first_word last_word base_labels".split()
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got) == want
    first = len(sample_texts(n=5))
    labels = {r.doc_id: (r.labels, r.score) for r in got}
    assert labels[first + 3] == ("mit", 1.0) and labels[first + 5] == ("", 0.0)
    assert "apache-2.0" in labels[first + 4][0] and labels[first + 6][0] == "bsd"
    assert labels[first + 6][1] == 1.0  # on two neighbouring diagonals
    assert all(0 <= s <= 1 for _, s in labels.values())
    assert license_scan(docs.where("false")).count() == 0


def least_edits(piece, text):
    """Edits of the piece against the nearest part of the text."""
    row = np.zeros(len(text) + 1, int)
    for j, c in enumerate(piece, 1):
        cost = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate([[j], cost]) - np.arange(len(text) + 1))
        row = row + np.arange(len(text) + 1)
    return row.min()


ITEMS = ["the quick brown fox jumps over the lazy dog and runs away from all of the hounds " * 2]
ITEMS += ["Ein kürzerer Satz, der auch gefunden wird.", "too short", "", None]


def edited(rnd, text, n):
    chars = list(text)
    for _ in range(n):
        i = rnd.randrange(len(chars))
        chars[i : i + 1] = rnd.choice([[], [rnd.choice("xyz")], [chars[i], rnd.choice("xyz")]])
    return "".join(chars)


def test_leaks_are_all_places_within_the_edits(spark):
    rnd = random.Random(4)
    settings = dc.LeakSettings()
    texts = sample_texts(n=8)
    for item in ITEMS[:2]:
        for n in (0, 1, 3, 6, 9, 14, 25):
            texts += [f"{texts[n % 5]} {edited(rnd, item, n)} {texts[n % 3]}".replace(" fox", "\nFOX")]
    texts += [ITEMS[0][:110], ITEMS[0][:90], ITEMS[1][:-1]]
    docs = documents(spark, texts, extra=True)
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id bigint, text string")
    found = dc.leaks(docs, bench).collect()
    got = {(r.doc_id, r.item_id, r.piece): r.edits for r in found}
    pieces = dc.pieces_of(list(enumerate(ITEMS)), settings)
    want = {}
    for doc_id, text in plain_rows(docs):
        for p in pieces:
            if len(text or "") < 20_000 and (n := least_edits(p.chars, dc.codes(text or ""))) <= p.edits:
                want[doc_id, p.item_id, p.start] = n
    assert {k for k in got} == set(want)
    by_place = {}
    for r in found:
        key = r.doc_id, r.item_id, r.piece
        by_place[key] = min(by_place.get(key, 99), r.edits)
    assert by_place == want
    text = dict(plain_rows(docs))
    for r in found:
        assert least_edits(dc.codes(text[r.doc_id][r.start : r.end]), dc.codes(ITEMS[r.item_id])) <= r.edits
    clean = dc.leaking_removed(docs, bench)
    leaking = {k[0] for k in want}
    assert clean.columns == docs.columns
    assert clean.count() == docs.where(~F.col("doc_id").eqNullSafe(-1)).count() - sum(
        d in leaking for d, _ in plain_rows(docs)
    )
    for a, b in ((docs.where("false"), bench), (docs, bench.where("false"))):
        assert dc.leaks(a, b).count() == 0


def test_large_benchmark_is_searched_in_shards(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"say {t} now") for i, t in enumerate(ITEMS[:2])], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id bigint, text string")
    whole = sorted(dc.leaks(docs, bench).collect())
    monkeypatch.setattr(dc, "SHARD_CHARS", 50)
    assert sorted(dc.leaks(docs, bench).collect()) == whole and whole


def test_parts_of_an_item_are_found_wherever_they_begin():
    rnd = random.Random(8)
    item = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=337))
    settings = dc.LeakSettings()
    index = dc.Index(dc.pieces_of([(0, item)], settings), settings)
    texts = [f"{'0123456789' * 20}{item[i : i + 90]}{'0123456789' * 20}" for i in range(len(item) - 89)]
    assert {t for t, *_ in dc.leaks_in(texts, index)} == set(range(len(texts)))


@pytest.mark.parametrize("limit", [1, 300, 1 << 22])
def test_blocks_are_counted_alike_however_they_are_cut(monkeypatch, limit):
    rnd = random.Random(6)
    pieces = dc.pieces_of(list(enumerate(ITEMS)), dc.LeakSettings())
    index = dc.Index(pieces, dc.LeakSettings())
    texts = sample_texts(n=6)[:6]
    text = " ".join(f"{t} {edited(rnd, ITEMS[i % 2], i)}" for i, t in enumerate(texts))
    chars = dc.codes(text)
    monkeypatch.setattr(dc, "MATCHES", limit)
    got = set(zip(*(x.tolist() for x in index.matches(chars))))
    each, owner, place = index.expanded(*index.postings(chars))
    shift = max(dc.SHIFT, int(index.longest + index.widest).bit_length())
    n = len(pieces)
    counts = np.zeros(((len(chars) >> shift) + 3, n), int)
    np.add.at(counts, (each >> shift, owner), 1)
    around = counts[:-1] + counts[1:] >= index.least
    around[1:] |= around[:-1].copy()
    held = around[each >> shift, owner]
    assert got == set(zip(each[held].tolist(), owner[held].tolist(), place[held].tolist())) and got


def test_large_benchmark_needs_no_table_of_blocks_and_pieces():
    rnd = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz "
    items = [(i, "".join(rnd.choices(letters, k=3000))) for i in range(700)]
    index = dc.Index(dc.pieces_of(items, dc.LeakSettings()), dc.LeakSettings())
    texts = ["".join(rnd.choices(letters, k=1 << 20)) for _ in range(2)] + [items[5][1][200:600]]
    tracemalloc.start()
    found = list(dc.leaks_in(texts, index))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A dense table would have 4,096 blocks x 42,000 pieces, 1.3 GB for one array.
    assert peak < 500e6
    assert {(t, item) for t, item, *_ in found} == {(2, 5)}


def test_a_task_holds_little_beside_the_texts_searched_together():
    rnd = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz "
    items = [(i, "".join(rnd.choices(letters, k=300))) for i in range(20)]
    index = dc.Index(dc.pieces_of(items, dc.LeakSettings()), dc.LeakSettings())
    parts = [t for _, t in items] + ["".join(rnd.choices(letters, k=700)) for _ in items]
    texts = rnd.choices(parts, k=dc.CHUNK_CHARS // 500)
    tracemalloc.start()
    found = list(dc.leaks_in(texts, index))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Six tasks share an executor of 3 GB with their JVM.
    assert peak < 150e6
    assert {t for t, *_ in found} == {n for n, t in enumerate(texts) if t in parts[:20]}


@pytest.mark.parametrize("q", [1, 2, 3, 5, 8])
def test_gram_hashes_depend_on_the_grams_alone(q):
    chars = dc.codes("abcabcabdabc")
    hashes = dc.gram_hashes(chars, q).tolist()
    grams = [bytes(chars[i : i + q]) for i in range(len(chars) - q + 1)]
    assert len(hashes) == len(grams)
    assert [[a == b for b in grams] for a in grams] == [[a == b for b in hashes] for a in hashes]
