from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablewright.catalog import (
    Catalog,
    ColumnSpec,
    TableSpec,
    boolean,
    decimal,
    enum,
    integer,
    nullable_ref,
    phone,
    pk,
    ref,
    string,
    table,
    timestamp,
)
from tablewright.functions.draws import draw, u32
from tablewright.functions.generators import Context
from tablewright.operators.integrity import fk_validate_all
from tablewright.operators.pools import fallback_groups, indexed_pools, pool_rows
from tablewright.operators.rows import generated_dataset, generated_table, range_source

AS_OF = datetime(2025, 1, 1, tzinfo=timezone.utc)
SMALL = Catalog.of(
    "small",
    table("Parent", 100, pk("p_id"), nullable_ref("up", "Parent.p_id", 0.7)),
    table(
        "Child",
        5000,
        ref("p_id", "Parent.p_id"),
        pk("c_id"),
        string("name"),
        phone("phone"),
        enum("kind", "A", "B", "it's"),
        decimal("price", -1.5, 2.0),
        boolean("flag", 0.9),
        timestamp("at", 2),
        integer("n", 1, 5),
    ),
)


def test_columns_keep_to_their_declaration(spark):
    child = generated_dataset(spark, SMALL)["Child"]
    assert child.columns == ["p_id", "c_id", "name", "phone", "kind", "price", "flag", "at", "n"]
    assert dict(child.dtypes)["price"] == "decimal(19,2)"
    row = child.agg(
        F.countDistinct("c_id").alias("ids"),
        F.max("c_id").alias("last"),
        F.max(F.length("phone")).alias("digits"),
        F.collect_set("kind").alias("kinds"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.avg(F.col("flag").cast("int")).alias("share"),
        F.min("at").alias("first"),
        F.max("at").alias("recent"),
        F.countDistinct("at").alias("moments"),
        F.collect_set("n").alias("ns"),
    ).first()
    assert (row.ids, row.last, row.digits) == (5000, 4999, 10)
    assert set(row.kinds) == {"A", "B", "it's"}
    assert Decimal("-1.50") <= row.low < Decimal("-1.45") and Decimal("1.95") < row.high <= 2
    assert 0.87 < row.share < 0.93
    assert row.first >= datetime(2024, 12, 30) and row.recent <= datetime(2025, 1, 1)
    assert row.moments > 4000
    assert set(row.ns) == {1, 2, 3, 4}


def test_int_and_timestamp_modes(spark):
    ctx = Context(parent_rows={"Parent": 100}, inclusive_ints=True, constant_timestamps=True)
    child = generated_table(spark, SMALL.tables["Child"], ctx)
    row = child.agg(F.max("n").alias("n"), F.countDistinct("at").alias("at"), F.min("at").alias("t"))
    assert row.first()[:2] == (5, 1)
    assert row.first().t == datetime(2024, 12, 30)


def test_rows_do_not_depend_on_partitions(spark):
    ctx = Context(parent_rows={"Parent": 100})
    few, many = (
        generated_table(spark, SMALL.tables["Child"], ctx, partitions=n) for n in (1, 13)
    )
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()
    other = generated_table(spark, SMALL.tables["Child"], Context(43, parent_rows={"Parent": 100}))
    assert other.select("price").exceptAll(few.select("price")).count() > 0


def test_generated_keys_are_valid_and_nullable_key_has_its_share(spark):
    tables = generated_dataset(spark, SMALL)
    checked = fk_validate_all(spark, SMALL.edges + SMALL.nullable_edges, tables).collect()
    by_column = {r.fk_column: r for r in checked}
    assert by_column["p_id"].orphaned == 0
    assert 55 <= by_column["up"].nulls <= 85
    assert by_column["up"].valid + by_column["up"].nulls == 100


def test_draws_are_uniform_and_unrelated(spark):
    pairs = spark.range(200_000).selectExpr(
        f"{draw(1, 'a', 'id', 10)} AS a", f"{draw(1, 'b', 'id', 10)} AS b"
    )
    counts = [r["count"] for r in pairs.groupBy("a", "b").count().collect()]
    assert len(counts) == 100
    chi = sum((c - 2000) ** 2 / 2000 for c in counts)
    assert 50 < chi < 170


def test_draws_beyond_32_bits(spark):
    ids = spark.range(5).selectExpr("id * 5000000000 AS id")
    assert ids.selectExpr(f"{u32(1, 'x', 'id')} AS v").distinct().count() == 5
    big = spark.range(10_000).selectExpr(f"{draw(1, 'x', 'id', 10**12)} AS v")
    low, high, n = big.selectExpr("min(v)", "max(v)", "count(distinct v)").first()
    assert 0 <= low < 10**9 and 999 * 10**9 < high < 10**12 and n == 10_000
    with pytest.raises(ValueError):
        draw(1, "x", "id", 0)


def test_unknown_type_and_empty_parent(spark):
    odd = TableSpec("Odd", 1, None, (ColumnSpec("x", "geometry"),))
    with pytest.raises(ValueError, match="geometry"):
        generated_table(spark, odd, Context())
    child = generated_table(spark, SMALL.tables["Child"], Context(parent_rows={"Parent": 0}))
    assert child.where("p_id IS NOT NULL").isEmpty()


def test_column_drawn_from_a_pool(spark):
    pools = indexed_pools(pool_rows(fallback_groups(spark)))
    people = table("People", 2000, pk("id"), string("name", pool="user_names"), string("city"))
    frame = generated_table(spark, people, Context(), pools=pools)
    assert frame.columns == ["id", "name", "city"]
    assert frame.count() == 2000
    names = frame.select("name").distinct()
    assert 480 < names.count() <= 500
    assert names.where("name = 'Tomas Okafor'").count() == 1


def test_range_source_is_dense(spark):
    for rows in (0, 1, 7, 120_000):
        frame = range_source(spark, rows)
        assert frame.count() == rows
        assert frame.selectExpr("coalesce(max(id) + 1, 0)").first()[0] == rows
