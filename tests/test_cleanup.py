import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright import Catalog
from tablewright.catalog import ForeignKey, integer, nullable_ref, pk, ref, table
from tablewright.operators.cleanup import fk_clean_cascade, fk_clean_table, fk_filter
from tablewright.operators.integrity import fk_orphan_rows, fk_validate_all
from tablewright.operators.sizing import BroadcastBudget

CHAIN = Catalog.of(
    "chain",
    table("leaf", 0, ref("mid_id", "mid.mid_id"), ref("root_id", "root.root_id"), pk("leaf_id")),
    table("mid", 0, ref("root_id", "root.root_id"), pk("mid_id")),
    table("root", 0, pk("root_id"), integer("n")),
    output_format="parquet",
)


def chain(spark, root, mid, leaf):
    return {
        "root": spark.createDataFrame([(r, 0) for r in root], "root_id bigint, n int"),
        "mid": spark.createDataFrame(mid, "root_id bigint, mid_id bigint"),
        "leaf": spark.createDataFrame(leaf, "mid_id bigint, root_id bigint, leaf_id bigint"),
    }


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_filter_drops_nulls_and_keeps_columns(spark):
    child = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "p int, v string")
    parent = spark.createDataFrame([(1,), (1,)], "id bigint")
    kept = fk_filter(child, "p", parent, "id")
    assert kept.columns == ["p", "v"] and rows(kept) == [(1, "a")]


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_cascade_sees_cleaned_parents(spark, tmp_path, limit, fmt):
    tables = chain(
        spark,
        [1, 2],
        [(1, 10), (9, 11), (2, 12), (None, 13)],
        [(10, 1, 100), (11, 1, 101), (12, 9, 102), (12, 2, 103), (13, 1, 104)],
    )
    cleaned = fk_clean_cascade(
        CHAIN, tables, folder=str(tmp_path / "out"), fmt=fmt, broadcast_limit=limit
    )
    assert rows(cleaned.tables["mid"]) == [(1, 10), (2, 12)]
    assert rows(cleaned.tables["leaf"]) == [(10, 1, 100), (12, 2, 103)]
    assert cleaned.rewritten == ("mid", "leaf")
    assert cleaned.tables["root"] is tables["root"]
    removed = {r.table_name: r.rows_removed for r in cleaned.summary().collect()}
    assert removed == {"root": 0, "mid": 2, "leaf": 3}
    assert not [f for f in tables["leaf"].schema if f.name not in cleaned.tables["leaf"].columns]


def test_clean_dataset_is_left_alone(spark, tmp_path):
    tables = chain(spark, [1], [(1, 10)], [(10, 1, 100)])
    cleaned = fk_clean_cascade(CHAIN, tables, folder=str(tmp_path / "out"))
    assert cleaned.rewritten == () and not (tmp_path / "out").exists()


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_all_rows_orphaned_leaves_an_empty_table(spark, tmp_path, fmt):
    tables = chain(spark, [1], [(7, 10)], [(10, 1, 100)])
    cleaned = fk_clean_cascade(CHAIN, tables, folder=str(tmp_path / "out"), fmt=fmt)
    assert rows(cleaned.tables["mid"]) == [] and rows(cleaned.tables["leaf"]) == []


def test_missing_parent_skips_its_reference(spark, tmp_path):
    tables = chain(spark, [1], [(7, 10)], [(10, 1, 100), (99, 1, 101)]) | {"root": None}
    cleaned = fk_clean_cascade(CHAIN, tables, folder=str(tmp_path / "out"))
    assert rows(cleaned.tables["leaf"]) == [(10, 1, 100)]
    assert rows(cleaned.tables["mid"]) == [(7, 10)]


def test_few_orphaned_keys_are_dropped_without_shuffling_rows(spark):
    child = spark.range(0, 20_000, 1, 4).selectExpr("id % 100 AS p", "id AS k", "'x' AS wide")
    tables = {"child": child, "parent": spark.range(99).withColumnRenamed("id", "pid")}
    kept = fk_clean_table(
        child, [ForeignKey("child", "p", "parent", "pid")], tables, broadcast_limit=0
    )
    assert kept.count() == 19_800
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "SortMergeJoin" not in plan


def test_many_orphaned_keys_and_a_hot_key_are_split(spark):
    """A third of all rows hold one key; with nothing broadcast, the join of
    whole rows splits its partition, and every row comes out."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    child = spark.range(0, 300_000, 1, 8).selectExpr(
        "if(id % 3 = 0, 7L, id) AS p", "id AS k", "repeat(md5(CAST(id AS string)), 2) AS wide"
    )
    tables = {"child": child, "parent": spark.range(0, 150_000).withColumnRenamed("id", "pid")}
    edge = ForeignKey("child", "p", "parent", "pid")
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        kept = fk_clean_table(child, [edge], tables, broadcast_limit=0).groupBy().agg(
            F.count("k").alias("rows"), F.sum(F.length("wide")).alias("chars")
        )
        expected = 100_000 + sum(1 for i in range(150_000) if i % 3)
        assert tuple(kept.collect()[0]) == (expected, expected * 64)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for name in settings:
            spark.conf.unset(name)


key = st.one_of(st.none(), st.integers(0, 6))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.integers(0, 6), max_size=6),
    st.lists(st.tuples(key, st.integers(0, 6)), max_size=10),
    st.lists(st.tuples(key, key), max_size=15),
)
def test_nothing_is_orphaned_after_the_cascade(spark, root, mid, pairs):
    leaf = [(m, r, i) for i, (m, r) in enumerate(pairs)]
    cleaned = fk_clean_cascade(CHAIN, chain(spark, root, mid, leaf)).tables
    checked = fk_validate_all(spark, CHAIN.edges, cleaned).collect()
    assert all(r.orphaned == 0 for r in checked)
    kept_mid = {m for r, m in mid if r in root}
    expected = [x for x in leaf if x[0] in kept_mid and x[1] in root]
    assert rows(cleaned["leaf"]) == sorted(expected)


def test_cycles_and_what_hangs_below_them_are_cleaned_to_the_end(spark, tmp_path):
    """A and B refer to each other, C to A: losing one row unravels a whole chain."""
    catalog = Catalog.of(
        "cycle",
        table("C", 0, ref("a", "A.a_id"), pk("c_id")),
        table("A", 0, ref("b", "B.b_id"), pk("a_id")),
        table("B", 0, ref("a", "A.a_id"), pk("b_id")),
    )
    assert catalog.load_order() == ["A", "B", "C"]
    tables = {
        "A": spark.createDataFrame([(0, 0), (1, 1), (1, 2), (2, 3), (9, 4)], "b bigint, a_id bigint"),
        "B": spark.createDataFrame([(0, 0), (2, 1), (4, 2)], "a bigint, b_id bigint"),
        "C": spark.createDataFrame([(0, 0), (1, 1), (3, 2)], "a bigint, c_id bigint"),
    }
    cleaned = fk_clean_cascade(catalog, tables, folder=str(tmp_path / "out"))
    assert rows(cleaned.tables["A"]) == [(0, 0), (1, 1), (1, 2)]
    assert rows(cleaned.tables["B"]) == [(0, 0), (2, 1)]
    assert rows(cleaned.tables["C"]) == [(0, 0), (1, 1)]


def test_self_reference_is_cleaned_to_the_end(spark, tmp_path):
    catalog = Catalog.of("self", table("T", 0, pk("id"), nullable_ref("up", "T.id", 0.0)))
    tree = [(i, i - 1 if i not in (0, 5) else None) for i in range(10) if i != 2]
    tables = {"T": spark.createDataFrame(tree, "id bigint, up bigint")}
    cleaned = fk_clean_cascade(catalog, tables, folder=str(tmp_path / "out"))
    assert rows(cleaned.tables["T"].select("id")) == [(i,) for i in (0, 1, 5, 6, 7, 8, 9)]


EDGE = ForeignKey("child", "p", "parent", "id")
AROUND = [-(2**63), -513, -512, -65, -64, -63, -1, 0, 1, 63, 64, 511, 512, 513, 2**40, 2**63 - 1]


@pytest.mark.parametrize("kind", ["bigint", "int"])
def test_many_orphans_are_dropped_without_a_shuffle_of_rows(spark, kind):
    keys = [k for k in AROUND if kind == "bigint" or -(2**31) <= k < 2**31]
    child = spark.createDataFrame([(k, i) for i, k in enumerate([*keys, *keys, None])], f"p {kind}, v int")
    parent = spark.createDataFrame([(k,) for k in keys[::2]], "id bigint")
    # Keys as they are would be too many for Spark to broadcast by itself.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1b")
    try:
        kept = fk_clean_table(child, [EDGE], {"parent": parent}, broadcast_limit=0)
        lost = fk_orphan_rows(EDGE, {"child": child, "parent": parent}, broadcast_limit=0)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.p for r in kept.collect()) == sorted([*keys[::2]] * 2)
        assert sorted(r.p for r in lost.where("p IS NOT NULL").collect()) == sorted([*keys[1::2]] * 2)
        assert lost.where("p IS NULL").count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_orphans_beyond_the_budget_are_dropped_as_keys(spark):
    child = spark.createDataFrame([(k, 0) for k in AROUND], "p bigint, v int")
    parent = spark.createDataFrame([(k,) for k in AROUND[::2]], "id bigint")
    with BroadcastBudget(0).account() as none:
        kept = fk_clean_table(child, [EDGE], {"parent": parent}, broadcast_limit=0, orphans=none)
        assert sorted(r.p for r in kept.collect()) == sorted(AROUND[::2])


def test_a_cascade_shuffles_no_rows_for_many_orphans(spark, monkeypatch):
    """Every large reference of a cascade draws on the budget of its orphaned keys."""
    asked = []
    monkeypatch.setattr(
        "tablewright.operators.sizing.Account.grants", lambda self, size: asked.append(size) or size > 32 * 3
    )
    tables = chain(spark, [1, 2], [(1, 10), (9, 11)], [(10, 1, 100), (11, 1, 101), (10, 9, 102)])
    cleaned = fk_clean_cascade(CHAIN, tables, broadcast_limit=0)
    assert rows(cleaned.tables["mid"]) == [(1, 10)]
    assert rows(cleaned.tables["leaf"]) == [(10, 1, 100)]
    assert sum(size % 160 == 0 and size > 0 for size in asked) == 3
