"""Row sources and generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.catalog import Catalog, TableSpec
from tablewright.functions.generators import Context, table_values
from tablewright.operators.pools import PoolSet, with_pool_values
from tablewright.operators.sizing import partitions_for

def range_source(spark: SparkSession, rows: int, partitions: int | None = None) -> DataFrame:
    """``rows`` ids, dense from 0, whatever the partitioning.

    The number of tasks grows with the rows unless it is given.
    """
    return spark.range(0, rows, 1, partitions or partitions_for(spark, rows))


def generated_table(
    spark: SparkSession,
    table: TableSpec,
    ctx: Context,
    *,
    pools: PoolSet | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """All rows of a declared table in one projection over its row ids.

    Columns that name a value pool are joined in on narrow (id, slot) rows
    before the wide projection; a pool's group is what another column of the
    row holds.
    """
    ids = range_source(spark, table.rows, partitions)
    values = table_values(table, "id", ctx)
    pooled = {c.name: (c.pool, c.pool_group) for c in table.columns if c.pool} if pools else {}
    if pooled:
        groups = {group for _, group in pooled.values() if group}
        ids = ids.withColumns({group: values[group] for group in groups})
        ids = with_pool_values(ids, table.name, pooled, pools, ctx.seed)
        values |= {group: F.col(group) for group in groups}
        values |= {name: F.col(f"pool_{name}") for name in pooled}
    return ids.select(*[value.alias(name) for name, value in values.items()])


def dataset_context(catalog: Catalog, **options) -> Context:
    """Generated parents have dense keys, so their row counts are all a child needs."""
    rows = {name: t.rows for name, t in catalog.tables.items()}
    return Context(seed=catalog.seed, parent_rows=rows, **options)


def generated_dataset(
    spark: SparkSession, catalog: Catalog, *, pools: PoolSet | None = None, **options
) -> dict[str, DataFrame]:
    ctx = dataset_context(catalog, **options)
    return {
        name: generated_table(spark, table, ctx, pools=pools)
        for name, table in catalog.tables.items()
    }
