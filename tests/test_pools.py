from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablewright.operators import pools as module
from tablewright.operators.pools import (
    drawn_from_group,
    fallback_groups,
    indexed_pools,
    items_from_text,
    numbered_values,
    pool_rows,
    selected_pools,
)
from tablewright.operators.sampling import dense_index, sampled_keys


def test_fallback_pools(spark):
    pools = pool_rows(fallback_groups(spark))
    sizes = {r.pool: r["count"] for r in pools.groupBy("pool").count().collect()}
    assert sizes == {
        "user_names": 500,
        "product_names": 1000,
        "brands": 500,
        "descriptions": 500,
        "addresses": 1000,
        "warehouse_names": 25,
        "delivery_partner_names": 200,
    }
    values = {(r.pool, r.grp, r.idx): r.value for r in pools.collect()}
    assert values["user_names", "", 19] == "Greta Solis"
    assert values["user_names", "", 20] == "User_0"
    assert values["user_names", "", 499] == "User_479"
    assert values["product_names", "Toys", 99] == "Toys_Product_99"
    assert values["addresses", "Delhi", 3] == "House 3, Old Market Road, Delhi"
    assert values["descriptions", "Home", 0] == "A Home article made to last, batch 0"


def test_large_group_is_spread(spark):
    groups = spark.createDataFrame(
        [("brands", "hot", 250_000, "Brand_{i}"), ("brands", "none", 0, "Brand_{i}")],
        "pool string, grp string, size bigint, template string",
    )
    rows = pool_rows(groups)
    assert rows.count() == 250_000 and rows.select("idx").distinct().count() == 250_000
    assert rows.rdd.getNumPartitions() > 1


def test_supplied_groups_replace_fallback(spark):
    supplied = spark.createDataFrame(
        [("brands", "Toys", "Zed"), ("brands", "Toys", "Acme")], "pool string, grp string, value string"
    )
    pools = selected_pools(numbered_values(indexed_pools(supplied)), fallback_groups(spark))
    toys = pools.where("pool = 'brands' AND grp = 'Toys'").orderBy("idx").collect()
    assert [(r.idx, r.value) for r in toys] == [(0, "Acme"), (1, "Zed")]
    assert pools.where("pool = 'brands' AND grp = 'Home'").count() == 50


def test_drawing_from_a_hot_group(spark):
    values = spark.createDataFrame(
        [("brands", "hot", f"h{i}") for i in range(3)] + [("brands", "cold", "c")],
        "pool string, grp string, value string",
    )
    rows = spark.range(3000).selectExpr("id", "if(id % 10 = 0, 'cold', if(id = 1, 'none', 'hot')) AS grp")
    drawn = drawn_from_group(
        rows, "id", "grp", "brands", indexed_pools(values), "brand", seed=1, tag="t"
    )
    counts = {(r.grp, r.brand): r["count"] for r in drawn.groupBy("grp", "brand").count().collect()}
    assert counts["cold", "c"] == 300 and counts["none", None] == 1
    assert sum(counts["hot", f"h{i}"] for i in range(3)) == 2699
    assert min(counts["hot", f"h{i}"] for i in range(3)) > 700


REPLIES = {
    '{"names": ["a", "b", "c"]}': ["a", "b"],
    '{"names": []}': [],
    '{"other": ["a"]}': [],
    '{"names": null, "x": "y"}': ["names", "x"],
    '{"names": 5}': ["names"],
    '["a", "b", "c"]': ["a", "b"],
    "Take 'one' or \"two\" or 'three'": ["one", "two"],
    "1. first\n 2.  second\nno\n3. third": ["first", "second"],
    '{"names": ["a", ': ["names", "a"],
    "nothing here": [],
    "": [],
}


@pytest.mark.parametrize("reply", REPLIES)
def test_items_from_text(spark, reply):
    frame = spark.createDataFrame([(1, reply)], "id int, response string")
    got = items_from_text(frame, "names", 2).orderBy("pos").collect()
    assert [r.item for r in got] == REPLIES[reply]
    assert [r.pos for r in got] == list(range(len(got)))


@pytest.mark.parametrize("partitions", [1, 5, None])
def test_dense_index_equals_rank(spark, partitions):
    keys = spark.range(0, 1000, 1, 7).selectExpr("id * 37 % 1009 AS k", "'v' AS v")
    got = dense_index(keys, "k", partitions=partitions).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(1000))
    assert [r.k for r in got] == sorted(i * 37 % 1009 for i in range(1000))


def test_sampled_keys_of_any_type(spark):
    parents = spark.createDataFrame([("x",), ("y",), ("z",)], "code string")
    ids = spark.range(3000)
    got = sampled_keys(ids, "id", parents, "code", "parent", seed=1, tag="t")
    counts = {r.parent: r["count"] for r in got.groupBy("parent").count().collect()}
    assert counts.keys() == {"x", "y", "z"} and min(counts.values()) > 900
    empty = sampled_keys(ids, "id", parents.where("false"), "code", "parent", seed=1, tag="t")
    assert empty.where("parent IS NULL").count() == 3000


def test_a_value_that_most_rows_hold_is_split(spark):
    rows = spark.range(0, 100_000, 1, 8).selectExpr("if(id % 10 = 0, id, -1L) AS k")
    index = dense_index(rows, "k", partitions=8)
    assert index.selectExpr("count(*)", "min(idx)", "max(idx)", "count(DISTINCT idx)").first()[:] == (
        100_000, 0, 99_999, 100_000,
    )
    assert index.where("(k = -1) <> (idx < 90000)").isEmpty()
    folders = Path(spark.conf.get("spark.checkpoint.dir")).glob("tablewright-*")
    written = spark.read.parquet(str(max(folders, key=lambda f: f.stat().st_mtime)))
    sizes = written.groupBy(F.shiftright("_place", 33).alias("part")).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) <= 2 * 100_000 / 8


@pytest.mark.parametrize("hot", ["hot", None, "absent"])
def test_one_group_of_most_rows_is_met_by_all_tasks(spark, monkeypatch, hot):
    """With nothing broadcast, no task gets over twice the mean of the rows, whether the
    hot group has values, is not there, or is null; and rows and draws are the same."""
    values = spark.createDataFrame(
        [("brands", g, f"{g}-{k}") for g in ("hot", "b", "c") for k in range(7)],
        "pool string, grp string, value string",
    )
    pools = indexed_pools(values)
    group = F.when(F.col("id") % 10 != 0, F.lit(hot)).otherwise(F.element_at(F.array(F.lit("b"), F.lit("c")), (F.col("id") % 2 + 1).cast("int")))
    rows = spark.range(40_000).select("id", group.alias("g"))
    want = drawn_from_group(rows, "id", "g", "brands", pools, "brand", seed=1, tag="t")
    monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        groups = pools.directory.where("pool = 'brands'").select(F.col("grp").alias("g"), "first", "size")
        met = module._met(rows, "id", groups, ["g"])
        counts = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == 40_000 and max(counts) <= 2 * 40_000 / 8
        got = drawn_from_group(rows, "id", "g", "brands", pools, "brand", seed=1, tag="t")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        even = module._met(spark.range(8000).select("id", F.lit("b").alias("g")).limit(0), "id", groups, ["g"])
        assert even.count() == 0
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_groups_that_are_not_heavy_are_met_once(spark, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    rows = spark.range(5000).select("id", F.expr("CAST(id % 1000 AS string)").alias("g"))
    groups = spark.range(1000).select(F.col("id").cast("string").alias("g"), F.lit(0).alias("first"))
    met = module._met(rows, "id", groups, ["g"])
    assert met.columns == ["g", "id", "first"]
    assert met.count() == 5000 and met.where("first IS NULL").count() == 0
