"""Chains, rings and forks of keys against following them one step at a time."""

import random

import pytest

from tablewright import Catalog
from tablewright.catalog import ForeignKey, nullable_ref, pk, ref, string, table
from tablewright.operators import cleanup, hierarchy
from tablewright.operators.cleanup import fk_clean_cascade

SELF = ForeignKey("t", "up", "t", "id")
TREE = Catalog.of("self", table("t", 0, pk("id"), nullable_ref("up", "t.id", 0.0), string("wide")))


def plain_hierarchy(rows):
    """Rows of id, up: state, depth, last and whether on a ring, of every key."""
    link = {}
    for key, up in rows:
        if key is not None and (key not in link or link[key] is not None and (up is None or up < link[key])):
            link[key] = up
    out = {}
    for key in link:
        seen, at = [], key
        while at in link and link[at] is not None and at not in seen:
            seen.append(at)
            at = link[at]
        if at not in link:
            out[key] = ("missing", len(seen), at, False)
        elif link[at] is None:
            out[key] = ("root", len(seen), at, False)
        else:
            ring = seen[seen.index(at) :]
            out[key] = ("ring", None, min(ring), key in ring)
    return out


def hierarchy_of(spark, rows):
    frame = spark.createDataFrame(rows, "id string, up string").repartition(3)
    found = hierarchy.fk_hierarchy(SELF, {"t": frame}).collect()
    return {r.node: (r.state, r.depth, r.last, r.on_ring) for r in found}


SHAPES = {
    "chain": [(f"{k:04}", f"{k - 1:04}" if k else None) for k in range(300)],
    "open chain": [(f"{k:04}", f"{k - 1:04}") for k in range(1, 100)],
    "ring": [(f"{k:03}", f"{(k + 1) % 70:03}") for k in range(70)],
    "tail into a loop": [(f"{k:03}", f"{min(k + 1, 99):03}") for k in range(100)],
    "two rings": [("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("f", "a"), ("g", "f"), ("h", "h")],
    "star": [("r", None)] + [(f"s{k}", "r") for k in range(500)],
    "repeated and null": [("a", None), ("a", "b"), ("b", "c"), ("b", "z"), (None, "a"), (None, None), ("c", "b")],
    "empty": [],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, shape):
    assert hierarchy_of(spark, SHAPES[shape]) == plain_hierarchy(SHAPES[shape])


@pytest.mark.parametrize("seed", range(3))
def test_random_links(spark, seed):
    rnd = random.Random(seed)
    names = [f"{k:02}" for k in range(60)]
    rows = [(k, rnd.choice([None, "none", *names * 2])) for k in names]
    assert hierarchy_of(spark, rows) == plain_hierarchy(rows)


def test_summary(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 9), (5, 4), (6, 7), (7, 6), (8, 6), (None, 3), (None, None)]
    frame = spark.createDataFrame(rows, "id bigint, up bigint")
    (row,) = hierarchy.fk_self_summary(SELF, {"t": frame}).collect()
    assert row.asDict() == {
        "total": 10, "nulls": 2, "valid": 7, "orphaned": 1, "rings": 1, "max_depth": 3, "unrooted": 5,
    }
    none = frame.where("id = 6 OR id = 7")
    (row,) = hierarchy.fk_self_summary(SELF, {"t": none}).collect()
    assert (row.rings, row.max_depth, row.unrooted) == (1, None, 2)
    (row,) = hierarchy.fk_self_summary(SELF, {"t": frame.limit(0)}).collect()
    assert (row.total, row.rings, row.max_depth, row.unrooted) == (0, 0, None, 0)


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)

    def call(frame, *args, **options):
        calls.append(frame.columns)
        return real(frame, *args, **options)

    monkeypatch.setattr(module, name, call)
    return calls


def test_a_chain_of_5000_levels_is_cleaned_in_few_rounds(spark, tmp_path, monkeypatch):
    """All of a chain hangs below a missing key: keys are written once a round, in at
    most 15 rounds, and whole rows once."""
    whole = counted(monkeypatch, cleanup, "write_table")
    keys = counted(monkeypatch, hierarchy, "materialized")
    chain = [(k, k - 1, "x" * 50) for k in range(1, 5001)]
    kept = [(k, k - 1 if k > 6001 else None, "y") for k in range(6001, 6101)]
    tables = {"t": spark.createDataFrame(chain + kept, "id bigint, up bigint, wide string")}
    cleaned = fk_clean_cascade(TREE, tables, folder=str(tmp_path / "out"))
    assert sorted(r.id for r in cleaned.tables["t"].collect()) == list(range(6001, 6101))
    assert len(whole) == 1
    rounds = [c for c in keys if "steps" in c]
    assert 10 < len(rounds) <= 15
    assert not any("wide" in c for c in keys)


def plain_cleaned(tables, edges):
    """Rows (dicts) left when orphans go until none is left; edges of child, column,
    parent, key, nullable."""
    tables = {name: list(rows) for name, rows in tables.items()}
    while True:
        before = sum(map(len, tables.values()))
        for child, column, parent, key, nullable in edges:
            there = {r[key] for r in tables[parent] if r[key] is not None}
            tables[child] = [
                r for r in tables[child] if (nullable if r[column] is None else r[column] in there)
            ]
        if sum(map(len, tables.values())) == before:
            return tables


@pytest.mark.parametrize("seed", range(4))
def test_cycles_with_several_references_and_repeated_keys(spark, tmp_path, seed):
    """Rows that refer to several keys, keys that differing rows hold, parents beyond the
    cycle, keys of two types, and rings."""
    rnd = random.Random(seed)
    catalog = Catalog.of(
        "cycle",
        table("o", 0, pk("o_id")),
        table("a", 0, ref("b1", "b.b_id"), ref("o", "o.o_id"), pk("a_id"), nullable_ref("up", "a.a_id", 0.0)),
        table("b", 0, ref("a", "a.a_id"), pk("b_id"), nullable_ref("other", "a.code", 0.0)),
        table("c", 0, ref("a", "a.a_id"), pk("c_id")),
    )
    edges = [
        ("a", "b1", "b", "b_id", False), ("a", "o", "o", "o_id", False), ("a", "up", "a", "a_id", True),
        ("b", "a", "a", "a_id", False), ("b", "other", "a", "code", True), ("c", "a", "a", "a_id", False),
    ]
    n = 40

    def key(nulls=0.0, most=n):
        return None if rnd.random() < nulls else rnd.randrange(most)

    def near(k):
        return min(max((k or 0) + rnd.randrange(-3, 4), 0), n + 1)

    rows = {
        "o": [{"o_id": k} for k in range(10)],
        "a": [
            {"b1": near(k), "o": key(most=11) if (k or 0) < 3 else 1, "a_id": k, "up": rnd.choice([None, None, near(k)]), "code": f"{(k or 0) % 30}"}
            for k in [*range(n), 5, 5, 17, None]
        ],
        "b": [{"a": near(k), "b_id": k, "other": rnd.choice([None, None, key()])} for k in [*range(n), 7, 9]],
        "c": [{"a": key(0.1), "c_id": k} for k in range(30)],
    }
    schemas = {
        "o": "o_id bigint", "a": "b1 bigint, o bigint, a_id bigint, up bigint, code string",
        "b": "a bigint, b_id bigint, other bigint", "c": "a bigint, c_id bigint",
    }
    frames = {t: spark.createDataFrame([tuple(r.values()) for r in own], schemas[t]) for t, own in rows.items()}
    cleaned = fk_clean_cascade(catalog, frames, folder=str(tmp_path / "out")).tables
    for r in rows["b"]:
        r["other"] = None if r["other"] is None else str(r["other"])
    want = plain_cleaned(rows, edges)
    for r in want["b"]:
        r["other"] = None if r["other"] is None else int(r["other"])
    for name in rows:
        got = sorted(map(repr, map(tuple, cleaned[name].collect())))
        assert got == sorted(repr(tuple(r.values())) for r in want[name]), name


def test_a_missing_table_on_a_cycle(spark, tmp_path):
    catalog = Catalog.of(
        "cycle",
        table("a", 0, ref("b", "b.b_id"), pk("a_id"), nullable_ref("up", "a.a_id", 0.0)),
        table("b", 0, ref("a", "a.a_id"), pk("b_id")),
    )
    a = spark.createDataFrame([(1, 1, None), (7, 2, 1), (7, 3, 9), (7, 4, 3)], "b bigint, a_id bigint, up bigint")
    b = spark.createDataFrame([(1, 1), (3, 2)], "a bigint, b_id bigint")
    cleaned = fk_clean_cascade(catalog, {"a": a, "b": None}, folder=str(tmp_path / "one")).tables
    assert sorted(r.a_id for r in cleaned["a"].collect()) == [1, 2] and cleaned["b"] is None
    cleaned = fk_clean_cascade(catalog, {"a": None, "b": b}, folder=str(tmp_path / "two")).tables
    assert cleaned["b"].count() == 2
