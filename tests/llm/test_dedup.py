"""Near duplicates, repeated strings and repeated passages against plain versions."""

import random

import numpy as np
import pytest

from tablewright.llm import anchors, nearduplicates
from tablewright.llm.nearduplicates import (
    NearSettings,
    near_duplicates,
    one_of_each,
    prefix_posts,
    shingle_sets,
    signatures,
)
from tablewright.llm.passages import PassageSettings, SuffixAutomaton, passages_removed
from tablewright.llm.substrings import LoserTree, Suffix, SubstringSettings, substrings_removed

from .texts import WORD, documents, plain_components, plain_rows, sample_texts, words

TEXTS = sample_texts()


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, TEXTS, extra=True).repartition(3).cache()


@pytest.mark.parametrize("settings", [NearSettings(), NearSettings(bin_shingles=2000)])
def test_components_are_those_of_all_pairs(docs, settings):
    got = near_duplicates(docs, settings).collect()
    want = plain_components(plain_rows(docs))
    assert sorted(map(repr, want)) == sorted(
        repr((r.doc_id, r.n_shingles, r.component_id)) for r in got
    )
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_document_of_each_group_stays(docs):
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for _, n, c in plain_components(plain_rows(docs)) if n}
    linked = [r.doc_id for r in kept.collect() if (r.text or "").strip()]
    assert sorted(linked, key=repr) == sorted(want, key=repr)


def test_documents_alike_by_four_fifths_are_linked(spark):
    first = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(first)), (1, " ".join([*first[:30], "other", *first[31:]]))]
    rows += [(2, " ".join([*first[:20], "x", *first[21:40], "y", *first[41:]]))]
    shared = 51 / (56 + 56 - 51)
    assert 0.8 <= shared < 0.85
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r.component_id for r in near_duplicates(frame).orderBy("doc_id").collect()] == [0, 0, 2]
    assert {r.doc_id for r in one_of_each(frame).collect()} == {0, 2}
    at_85 = near_duplicates(frame, NearSettings(percent=85, threshold=38))
    assert [r.component_id for r in at_85.orderBy("doc_id").collect()] == [0, 1, 2]


def test_unrelated_documents_do_not_meet_however_many_there_are(spark):
    """2,000 documents with hashes 14 bits narrower stand for 30 million: no least hash
    agrees by chance, so nothing is posted.  Upper halves alone, narrowed alike,
    would post nearly all."""
    rnd = random.Random(8)
    texts = [" ".join(f"{rnd.getrandbits(40):x}" for _ in range(334)).encode() for _ in range(2000)]
    settings = NearSettings()
    drawn = signatures(shingle_sets(texts, settings.words), settings).view(np.uint64)

    def posted(values):
        rows = [(n, row) for n, row in enumerate(values.astype(np.int64).tolist())]
        classes = spark.createDataFrame(rows, "id bigint, signature array<bigint>")
        return prefix_posts(classes, settings).select("id").distinct().count()

    assert posted(drawn >> np.uint64(14)) == 0
    assert posted(drawn >> np.uint64(32 + 14)) > 1500


def test_hot_terms_meet_by_broadcast_with_the_same_links(docs, monkeypatch):
    want = sorted(map(repr, near_duplicates(docs).collect()))
    monkeypatch.setattr(nearduplicates, "HOT_POSTS", 2)
    assert sorted(map(repr, near_duplicates(docs).collect())) == want
    monkeypatch.setattr(nearduplicates, "BROADCAST_BYTES", 64)
    assert sorted(map(repr, near_duplicates(docs).collect())) == want


def test_pipeline_stage_on_an_empty_table(docs):
    assert one_of_each(docs.limit(0)).count() == 0


def plain_strings(texts, window):
    places = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - window + 1):
            places.setdefault(t[p : p + window], []).append((i, p))
    covered = [bytearray(len(t)) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                covered[i][p : p + window] = b"\1" * window
    return covered


@pytest.mark.parametrize(
    "settings",
    [
        SubstringSettings(),
        SubstringSettings(run=7, range_size=40),
        SubstringSettings(group_size=1),
        SubstringSettings(group_size=3, run=50, range_size=100),
    ],
)
def test_repeated_strings_are_removed(docs, settings):
    rows = plain_rows(docs)
    rows = [(d, (t or "").encode()) for d, t in rows]
    covered = plain_strings([t for _, t in rows], settings.window)
    want = [
        (d, len(t), sum(c), bytes(b for b, x in zip(t, c) if not x))
        for (d, t), c in zip(rows, covered)
    ]
    got = [
        (r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), bytes(r.kept))
        for r in substrings_removed(docs, settings).collect()
    ]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(n for _, _, n, _ in want)


def plain_passages(rows, window):
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for p in range(len(w) - window + 1 if d is not None else 0):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = [0] * len(w)
        for p in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[p : p + window])] < d:
                gone[p : p + window] = [1] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize(
    "settings", [
        PassageSettings(),
        PassageSettings(shard=3),
        PassageSettings(group_size=1),
        PassageSettings(group_size=2, shard=5),
    ],
)
def test_repeated_passages_are_removed(docs, settings):
    want = plain_passages(plain_rows(docs), settings.window)
    got = [
        (r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept)
        for r in passages_removed(docs, settings).collect()
    ]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(n for _, _, n, _ in want)


def test_a_hot_anchor_is_split_into_parts_that_fit(spark):
    """One run of words, and of bytes, between words of all kinds, in 300 documents:
    every group that is merged or streamed fits, and the results are the plain ones."""
    rnd = random.Random(4)
    hot = " ".join(f"hot{k}" for k in range(7))
    sides = [[words(rnd, 9, [f"x{k}" for k in range(30)]) for _ in range(4)] for _ in range(2)]
    texts = []
    for _ in range(300):
        left, right = (words(rnd, rnd.randrange(5), list("pqrs")) for _ in range(2))
        texts.append(" ".join([left, rnd.choice(sides[0]), hot, rnd.choice(sides[1]), right]))
    docs = documents(spark, [*texts, *texts[:9]])
    seen = []
    real = anchors.fitting

    def fitting(*args):
        out = real(*args)
        seen.append((out[0].groupBy("gram").count().agg({"count": "max"}).first()[0], out[1].count()))
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(anchors, "fitting", fitting)
        rows = plain_rows(docs)
        got = passages_removed(docs, PassageSettings(group_size=20)).collect()
        want = plain_passages(rows, 13)
        assert sorted(repr((r.doc_id, r.kept)) for r in got) == sorted(repr((d, k)) for d, _, _, k in want)
        settings = SubstringSettings(window=40, gram=10, group_size=20)
        got = substrings_removed(docs, settings).collect()
        data = [(t or "").encode() for _, t in rows]
        kept = [bytes(b for b, x in zip(t, c) if not x) for t, c in zip(data, plain_strings(data, 40))]
        assert sorted(repr(bytes(r.kept)) for r in got) == sorted(map(repr, kept))
    assert len(seen) == 2 and all(most <= 20 and links > 0 for most, links in seen)


@pytest.mark.parametrize("operator", [near_duplicates, substrings_removed, passages_removed])
def test_empty_table(docs, operator):
    assert operator(docs.where("false")).count() == 0


def test_loser_tree_puts_out_sorted_suffixes_and_their_common_prefixes():
    runs = [[b"aab", b"ab", b"b"], [b"aa", b"aab", b"ba"], [], [b"ab"]]

    def coded(run):
        before = b""
        for key in run:
            shared = len(common(before, key))
            yield shared, Suffix(key, b"", 0, 0, 1)
            before = key

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return a[:n]

    out = [(s, x.key) for s, x in LoserTree([coded(r) for r in runs])]
    keys = sorted(k for r in runs for k in r)
    assert [k for _, k in out] == keys
    assert [s for s, _ in out] == [len(common(a, b)) for a, b in zip([b"", *keys], keys)]


def test_automaton_statistics():
    automaton = SuffixAutomaton(3)
    automaton.add([b"a", b"b", b"a", b"b", b"c"])
    automaton.add([b"x", b"b", b"c"])
    assert list(automaton.statistics([b"b", b"a", b"b", b"c", b"x", b"b", b"b", b"c", b"y"])) == [
        1, 2, 3, 3, 1, 2, 1, 2, 0,
    ]


def test_texts_without_spans_are_not_shuffled(spark):
    from tablewright.llm import anchors

    rows = [(i, f"text {i}") for i in range(50)] + [(None, "none"), (0, "text 0")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    docs = anchors.materialized(docs)
    spans = docs.where("doc_id = 7 OR doc_id IS NULL").selectExpr(
        "doc_id", "xxhash64(text) AS text_key", "1L AS low", "2L AS high"
    )
    for threshold in ("1b", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = anchors.with_spans(anchors.Texts.of(docs), spans)
            plan = got._jdf.queryExecution().executedPlan().toString()
            found = sorted((str(r.doc_id), r.text, r.spans is not None) for r in got.collect())
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert found == sorted((str(i), t, i in (7, None)) for i, t in rows)
        assert ("LeftSemi" in plan and "BroadcastHashJoin" in plan) == (threshold == "1b")


def test_passages_stream_only_where_another_document_has_their_anchor(spark, monkeypatch):
    from tablewright.llm import passages

    rnd = random.Random(9)
    lone = [words(rnd, 60, [f"lone{k}" for k in range(500)]) for _ in range(20)]
    near = [f"a{k} " + " ".join(f"near{j}" for j in range(30)) + f" z{k}" for k in range(6)]
    docs = documents(spark, [*lone, *lone, *near, *near[:2], lone[0] + " . " + lone[0]])
    seen = []
    deal = passages.passages
    monkeypatch.setattr(passages, "passages", lambda *args: seen.append(deal(*args).cache()) or seen[-1])
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in passages_removed(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_passages(plain_rows(docs), 13)))
    under = {}
    for row in seen[0].collect():
        under.setdefault(row.gram, set()).add(row.doc_id)
    assert under and all(len(ids) > 1 for ids in under.values())


def test_an_automaton_holds_only_passages_with_a_later_one(spark, monkeypatch):
    """Under each anchor the first document's passage is not streamed, the last one's not added."""
    import pyarrow as pa

    from tablewright.llm import passages

    calls = []
    add, statistics = SuffixAutomaton.add, SuffixAutomaton.statistics
    monkeypatch.setattr(SuffixAutomaton, "add", lambda s, w: calls.append(("add", w[0])) or add(s, w))
    monkeypatch.setattr(SuffixAutomaton, "statistics", lambda s, w: calls.append(("stream", w[0])) or statistics(s, w))

    class Shards:
        def groupBy(self, _):
            return self

        def applyInArrow(self, stream, _):
            rows = [(1, 7, 70, "a x y z"), (2, 7, 71, "b x y z"), (3, 7, 72, "c x y z"), (2, 8, 80, "d u v w")]
            names = ["doc_id", "gram", "segment", "words"]
            return stream(pa.table([pa.array(c) for c in zip(*rows)], names))

    found = passages.streamed(Shards(), PassageSettings(window=3, gram=1)).to_pylist()
    assert calls == [("add", b"a"), ("stream", b"b"), ("add", b"b"), ("stream", b"c")]
    assert found == [{"gram": 7, "segment": s, "offset": 1} for s in (71, 72)]


def test_lists_of_spans_are_merged_as_one_by_one():
    import pyarrow as pa

    rnd = random.Random(3)
    lists = [None, [], [(2, 5)], [(5, 9), (0, 5)], [(0, 3), (4, 6), (1, 2)]]
    for _ in range(200):
        lows = [rnd.randrange(60) for _ in range(rnd.randrange(9))]
        lists.append([(a, a + rnd.randrange(1, 9)) for a in lows])
    rows = [s if s is None else [{"low": a, "high": b} for a, b in s] for s in lists]
    kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
    for at, n in ((0, len(rows)), (3, 50), (0, 2)):
        got = anchors.merged_lists(pa.array(rows, kind).slice(at, n)).to_pylist()
        want = [anchors.merged_spans(s) for s in rows[at : at + n]]
        assert [[(s["start"], s["end"]) for s in own] for own in got] == want
