import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablewright.catalog import ForeignKey
from tablewright.operators import integrity
from tablewright.operators.cleanup import fk_clean_table
from tablewright.operators.integrity import (
    fk_orphan_rows,
    fk_summary,
    fk_valid_count,
    fk_validate_all,
)
from tablewright.operators.profile import quality_score

EDGE = ForeignKey("child", "p", "parent", "id")
CHILD = "k int, p bigint"
PARENT = "id bigint"


def frames(spark, child, parent, key="bigint"):
    return {
        "child": spark.createDataFrame(list(enumerate(child)), f"k int, p {key}"),
        "parent": spark.createDataFrame([(v,) for v in parent], f"id {key}"),
    }


def check(spark, tables, edges=(EDGE,), **options):
    return integrity.fk_validate_all(spark, list(edges), tables, **options).collect()


def test_null_is_an_orphan_and_repeated_parents_do_not_count_twice(spark):
    tables = frames(spark, [1, 1, 2, None, 9], [1, 1, 2, 3, None])
    (row,) = check(spark, tables)
    assert (row.total, row.valid, row.orphaned, row.nulls) == (5, 3, 2, 1)
    assert (row.valid_pct, row.status) == (60.0, "FAIL")
    (row,) = check(spark, tables, null_policy="ignore")
    assert (row.total, row.valid, row.orphaned, row.nulls) == (4, 3, 1, 1)
    with pytest.raises(ValueError):
        check(spark, tables, null_policy="keep")


def test_empty_child_empty_parent_and_missing_table(spark):
    (row,) = check(spark, frames(spark, [], [1]))
    assert (row.total, row.orphaned, row.valid_pct, row.status) == (0, 0, 0.0, "OK")
    (row,) = check(spark, frames(spark, [1, 2], []))
    assert (row.total, row.orphaned, row.status) == (2, 2, "FAIL")
    missing = frames(spark, [1], [1]) | {"parent": None}
    (row,) = check(spark, missing)
    assert (row.total, row.status) == (None, "SKIPPED")
    status = integrity.fk_final_status(integrity.fk_validate_all(spark, [EDGE], missing)).first()
    assert tuple(status) == (0, 1, 0)


def test_text_keys_and_several_references_into_one_parent(spark):
    tables = frames(spark, ["a", "b", "zz"], ["a", "b"], "string")
    tables["other"] = spark.createDataFrame([("b", 1), ("c", 7)], "p string, n bigint")
    tables["number"] = spark.createDataFrame([(1,)], "id int")
    edges = [
        EDGE,
        ForeignKey("other", "p", "parent", "id"),
        ForeignKey("other", "n", "number", "id"),
    ]
    rows = {(r.child_table, r.fk_column): r for r in check(spark, tables, edges)}
    assert {k: (r.valid, r.orphaned) for k, r in rows.items()} == {
        ("child", "p"): (2, 1),
        ("other", "p"): (1, 1),
        ("other", "n"): (1, 1),
    }
    fan = {(r.child_table, r.fk_column): r for r in integrity.fk_fan_in(spark, edges, tables).collect()}
    row = fan["child", "p"]
    assert (row.parents, row.referenced, row.never_referenced) == (2, 2, 0)
    row = fan["other", "p"]
    assert (row.min_children, row.max_children, row.avg_children) == (0, 1, 0.5)


def test_a_third_of_all_rows_on_one_key(spark):
    """The hot key reaches the shuffle once per task, and counts come out whole."""
    child = spark.range(0, 300_000, 1, 8).selectExpr(
        "CAST(id AS int) AS k", "if(id % 3 = 0, 7L, id) AS p"
    )
    tables = {"child": child, "parent": spark.range(0, 150_000)}
    (row,) = check(spark, tables)
    expected = 100_000 + sum(1 for i in range(150_000) if i % 3)
    assert (row.total, row.valid, row.orphaned) == (300_000, expected, 300_000 - expected)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.one_of(st.none(), st.integers(0, 12)), max_size=30),
    st.lists(st.one_of(st.none(), st.integers(0, 12)), max_size=15),
)
def test_counts_match_brute_force(spark, child, parent):
    (row,) = check(spark, frames(spark, child, parent))
    valid = sum(1 for v in child if v is not None and v in parent)
    assert (row.total, row.valid, row.orphaned) == (len(child), valid, len(child) - valid)


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("key", ["bigint", "string", "int"])
def test_orphan_rows_both_ways(spark, limit, key):
    make = str if key == "string" else int
    child = [make(1), make(1), None, make(5), make(5), make(8)]
    tables = frames(spark, child, [make(1), make(2)], key)
    rows = integrity.fk_orphan_rows(EDGE, tables, broadcast_limit=limit)
    assert rows.columns == ["k", "p"]
    assert sorted(r.k for r in rows.collect()) == [2, 3, 4, 5]


def test_self_reference(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 9)], "id bigint, up bigint")
    row = integrity.fk_self_check(ForeignKey("t", "up", "t", "id"), {"t": tree}).first()
    assert tuple(row) == (3, 1, 1, 1)


def test_duplicate_and_null_keys(spark):
    frame = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 2)], "a int, b int")
    assert sorted(map(tuple, integrity.duplicate_keys(frame, "a").collect()), key=str) == [
        (1, 3),
        (None, 1),
    ]
    assert sorted(map(tuple, integrity.duplicate_keys(frame, "a", "b").collect()), key=str) == [
        (1, 1, 2),
        (None, 2, 1),
    ]
    assert dict(map(tuple, integrity.null_counts(frame).collect())) == {"a": 1, "b": 0}


def test_validation_is_one_shuffle_without_joins_of_rows(spark):
    """The ledger plan: no sort-merge join, and only keys of the tables are read."""
    child = spark.range(100).selectExpr("id AS k", "id AS p")
    plan = integrity.fk_validate_all(spark, [EDGE], {"child": child, "parent": spark.range(50)})
    text = plan._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text


KEY_TYPES = {
    "bigint": "id",
    "int": "CAST(id AS int)",
    "decimal(19,2)": "CAST(id AS decimal(19,2))",
    "double": "CAST(id AS double)",
    "text": "CAST(id AS string)",
    "padded text": "lpad(CAST(id AS string), 5, '0')",
    "date": "date_add(DATE '2024-01-01', CAST(id AS int))",
    "timestamp_ntz": "CAST(date_add(DATE '2024-01-01', CAST(id AS int)) AS timestamp_ntz)",
}
NUMBERS = ["bigint", "int", "decimal(19,2)", "double"]
PAIRS = [(a, b) for a in NUMBERS for b in [*NUMBERS, "padded text"]]
PAIRS += [("text", "bigint"), ("padded text", "decimal(19,2)"), ("date", "timestamp_ntz"), ("text", "date")]


@pytest.mark.parametrize(("child", "parent"), PAIRS)
def test_both_ways_of_joining_agree_with_the_ledger(spark, child, parent):
    """Ids 0-9, one of them null, against 0-6: seven have a parent."""
    ids = spark.range(10).selectExpr("id AS n", f"if(id = 6, NULL, {KEY_TYPES[child]}) AS k")
    tables = {"c": ids, "p": spark.range(7).selectExpr(f"{KEY_TYPES[parent]} AS k")}
    edge = ForeignKey("c", "k", "p", "k")
    same = child != "text" or parent != "date"
    valid = 6 if same else 0
    row = fk_validate_all(spark, [edge], tables).first()
    assert (row.valid, row.orphaned, row.nulls) == (valid, 10 - valid, 1)
    for limit in (1 << 26, 0):
        kept = fk_clean_table(ids, [edge], tables, broadcast_limit=limit)
        assert sorted(r.n for r in kept.collect()) == list(range(valid))
        bad = fk_orphan_rows(edge, tables, broadcast_limit=limit)
        assert sorted(r.n for r in bad.collect()) == list(range(valid, 10))


def test_missing_tables_leave_nothing_valid(spark):
    tables = {"c": spark.range(3).withColumnRenamed("id", "k"), "p": None}
    edge = ForeignKey("c", "k", "p", "k")
    checked = fk_validate_all(spark, [edge], tables)
    assert not fk_summary(checked).first().is_valid
    assert quality_score(checked).first().verdict == "ISSUES"
    assert fk_orphan_rows(edge, tables) is None
    assert tuple(fk_valid_count(edge, tables).first()) == (None, None, None, None)
