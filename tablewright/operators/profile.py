"""Table statistics, column profiles and the reports built on validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.catalog import Catalog
from tablewright.functions.literals import literal_frame
from tablewright.operators.integrity import EDGE_COLUMNS, Tables, percentage, total_of


def row_count(table: DataFrame) -> DataFrame:
    return table.selectExpr("count(*) AS row_count")


def table_counts(spark: SparkSession, tables: Tables) -> DataFrame:
    """Rows per table; null for a missing one.

    The tables are united as bare names and counted before the shuffle: each
    task sends one number, and parquet tables answer from their footers.
    """
    names = literal_frame(
        spark,
        "table_name string, _present boolean",
        [(name, table is not None) for name, table in tables.items()],
    )
    marks = [
        table.select(F.lit(name).alias("table_name"))
        for name, table in tables.items()
        if table is not None
    ]
    if not marks:
        return names.selectExpr("table_name", "CAST(NULL AS bigint) AS row_count")
    counted = reduce(DataFrame.union, marks).groupBy("table_name").agg(F.expr("count(*) AS n"))
    return names.join(F.broadcast(counted), "table_name", "left").selectExpr(
        "table_name", "if(_present, coalesce(n, 0L), NULL) AS row_count"
    )


def table_stats(spark: SparkSession, tables: Tables) -> DataFrame:
    """Rows and columns per table by name; missing tables are marked."""
    widths = literal_frame(
        spark,
        "table_name string, column_count int, status string",
        [
            (name, None, "MISSING") if table is None else (name, len(table.columns), "OK")
            for name, table in tables.items()
        ],
    )
    counts = table_counts(spark, tables)
    return (
        counts.join(F.broadcast(widths), "table_name")
        .select("table_name", "row_count", "column_count", "status")
        .orderBy("table_name")
    )


def table_stats_total(stats: DataFrame) -> DataFrame:
    return stats.selectExpr(
        f"{total_of('row_count')} AS total_rows", f"{total_of('column_count')} AS total_columns"
    )


def level_rollup(spark: SparkSession, catalog: Catalog, tables: Tables) -> DataFrame:
    """Tables and rows per load level, and over all levels."""
    levels = catalog.tables_frame(spark).select("table_name", "load_level")
    counted = table_counts(spark, tables).join(F.broadcast(levels), "table_name")
    return (
        counted.rollup("load_level")
        .agg(
            F.expr(
                "if(grouping(load_level) = 1, 'TOTAL', CAST(load_level AS string)) AS level_name"
            ),
            F.expr("count(*) AS table_count"),
            F.expr(f"{total_of('row_count')} AS row_count"),
        )
        .drop("load_level")
    )


def union_counts(spark: SparkSession, tables: Tables) -> DataFrame:
    return table_counts(spark, tables).where("row_count IS NOT NULL").orderBy("table_name")


def total_records(spark: SparkSession, tables: Tables) -> DataFrame:
    return table_counts(spark, tables).selectExpr(
        f"{total_of('row_count')} AS total_records"
    )


def sample_rows(table: DataFrame, *order: str, rows: int = 5) -> DataFrame:
    """The first rows by the given order, kept as a top-k per task."""
    return table.orderBy(*order).limit(rows)


def has_order(kind: T.DataType) -> bool:
    """Whether values of the type have extremes."""
    if isinstance(kind, T.ArrayType):
        return has_order(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(has_order(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def value_text(name: str, kind: T.DataType) -> str:
    """A column's values as text that is equal where they are: 0.0 for -0.0, and
    maps by their entries in order."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return f"CAST(`{name}` + 0.0D AS string)"
    if isinstance(kind, T.MapType):
        return f"to_json(array_sort(map_entries(`{name}`)))"
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return f"to_json(struct(`{name}`))" if has_order(kind) else f"CAST(`{name}` AS string)"
    return f"CAST(`{name}` AS string)"


def distinct_counts(table: DataFrame) -> DataFrame:
    """``position, n``: distinct values of every column that has any."""
    pairs = ", ".join(
        f"struct({i} AS position, if(`{f.name}` IS NULL, NULL, {value_text(f.name, f.dataType)}) AS v)"
        for i, f in enumerate(table.schema.fields)
    )
    values = table.selectExpr(f"inline(array({pairs}))").where("v IS NOT NULL").distinct()
    return values.groupBy("position").agg(F.expr("count(*) AS n"))


def column_profile(table: DataFrame, *, distinct: str = "exact") -> DataFrame:
    """Type, nullability, rows, nulls, distinct values and extremes per column.

    Extremes are whole values as text, null for types without an order; NaN is
    above every number.  Counts and extremes take one scan and one row per task.  Exact distinct
    values take a second scan of (column, value) pairs, combined before the
    shuffle so that repeated values cross it once per task;
    ``distinct="approx"`` keeps one sketch per column instead and shuffles none:
    the choice for wide or very large tables, at an error of about 5 %.
    """
    if distinct not in ("exact", "approx"):
        raise ValueError(f"distinct {distinct!r} is neither 'exact' nor 'approx'")
    fields = list(enumerate(table.schema.fields))
    measures = ["count(*) AS rows"]
    for i, f in fields:
        measures.append(f"count_if(`{f.name}` IS NULL) AS nulls{i}")
        for name in ("min", "max"):
            found = f"CAST({name}(`{f.name}`) AS string)" if has_order(f.dataType) else "CAST(NULL AS string)"
            measures.append(f"{found} AS {name}{i}")
        if distinct == "approx":
            measures.append(f"approx_count_distinct({value_text(f.name, f.dataType)}) AS distinct{i}")
    entries = [
        f"struct({i} AS position, rows AS row_count, nulls{i} AS null_rows, min{i} AS min_value, "
        f"max{i} AS max_value, "
        f"{f'distinct{i}' if distinct == 'approx' else '0L'} AS distinct_values)"
        for i, _ in fields
    ]
    measured = table.selectExpr(*measures).selectExpr(f"inline(array({', '.join(entries)}))")
    described = literal_frame(
        table.sparkSession,
        "position int, column_name string, data_type string, nullable boolean",
        [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in fields],
    )
    profile = described.join(F.broadcast(measured), "position")
    if distinct == "exact":
        profile = (
            profile.drop("distinct_values")
            .join(F.broadcast(distinct_counts(table)), "position", "left")
            .withColumn("distinct_values", F.expr("coalesce(n, 0L)"))
            .drop("n")
        )
    return profile.drop("position")


def fk_report(checked: DataFrame) -> DataFrame:
    """Validation results by table and key; skipped references stay visible."""
    return checked.select(
        *EDGE_COLUMNS, "status", "valid", "total", "valid_pct", "orphaned"
    ).orderBy("child_table", "fk_column")


def quality_score(checked: DataFrame) -> DataFrame:
    """Overall share of valid references and the verdict on it."""
    totals = checked.selectExpr(
        f"{total_of('total')} AS total_references",
        f"{total_of('valid')} AS valid_references",
        "count_if(status = 'SKIPPED') AS skipped",
    )
    return totals.selectExpr(
        "total_references",
        "valid_references",
        "total_references - valid_references AS invalid_references",
        f"{percentage('valid_references', 'total_references')} AS valid_pct",
        "if(total_references = valid_references AND skipped = 0, 'PERFECT', 'ISSUES') AS verdict",
    )
