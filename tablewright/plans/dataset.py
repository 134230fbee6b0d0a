"""Whole-dataset jobs: generate, validate, clean, report, export."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from tablewright.catalog import Catalog
from tablewright.functions.sqltext import DEFAULT_SCHEMA
from tablewright.operators.cleanup import CleanedDataset, fk_clean_cascade
from tablewright.operators.integrity import (
    Tables,
    fk_final_status,
    fk_issues,
    fk_summary,
    fk_validate_all,
)
from tablewright.operators.profile import (
    column_profile,
    fk_report,
    quality_score,
    sample_rows,
    table_stats,
    table_stats_total,
)
from tablewright.operators.rows import generated_dataset
from tablewright.operators.scripts import (
    closing_lines,
    row_counts,
    script_lines,
    write_combined_script,
    write_table_scripts,
)
from tablewright.sources.sinks import write_table
from tablewright.sources.tables import read_dataset
from tablewright.sources.workspace import materialized, scratch


def write_dataset(
    tables: Mapping[str, DataFrame], root: str, fmt: str = "csv", *, at_once: int = 4
) -> dict[str, int]:
    """Write every table under ``root``; rows per table, observed while writing.

    A few writes run at once, so small tables do not leave the cluster idle.
    The first failure is raised.
    """

    def write(name: str) -> int:
        return write_table(tables[name], f"{root}/{name}", fmt)

    with ThreadPoolExecutor(at_once) as jobs:
        return dict(zip(tables, jobs.map(write, tables)))


def generate(spark: SparkSession, catalog: Catalog, root: str, **options) -> dict[str, int]:
    """Generate and write every declared table in the catalog's format."""
    with scratch(spark):
        tables = generated_dataset(spark, catalog, **options)
        return write_dataset(tables, root, catalog.output_format)


def validate(spark: SparkSession, catalog: Catalog, tables: Tables) -> dict[str, DataFrame]:
    """Every reference checked: all results, the failures, and the totals.

    The data is read once: the results, one row per reference, are written and
    the views read those.
    """
    checked = materialized(fk_validate_all(spark, catalog.all_edges, tables))
    return {
        "checked": checked,
        "issues": fk_issues(checked),
        "summary": fk_summary(checked),
        "final_status": fk_final_status(checked),
    }


def clean(spark: SparkSession, catalog: Catalog, root: str, target: str) -> CleanedDataset:
    """Clean the dataset under ``root`` into ``target``, which gets every table:
    those that lost rows cleaned, the others as they are; ``root`` stays."""
    fmt = catalog.output_format
    tables = read_dataset(spark, root, catalog, fmt)
    cleaned = fk_clean_cascade(catalog, tables, folder=target, fmt=fmt)
    whole = {
        name: table
        for name, table in cleaned.tables.items()
        if table is not None and name not in cleaned.rewritten
    }
    write_dataset(whole, target, fmt)
    return cleaned


def report(spark: SparkSession, catalog: Catalog, tables: Tables) -> dict[str, DataFrame]:
    """Statistics, references and quality of a dataset; each table is counted
    once and each reference checked once for all views."""
    stats = materialized(table_stats(spark, tables)).orderBy("table_name")
    checked = validate(spark, catalog, tables)["checked"]
    return {
        "stats": stats,
        "totals": table_stats_total(stats),
        "foreign_keys": fk_report(checked),
        "quality": quality_score(checked),
    }


def table_details(catalog: Catalog, name: str, table: DataFrame) -> dict[str, DataFrame]:
    """One table's columns and its first rows by key."""
    order = catalog.tables[name].primary_key or table.columns[0]
    return {"columns": column_profile(table), "sample": sample_rows(table, order)}


def export_sql(
    spark: SparkSession,
    catalog: Catalog,
    tables: Tables,
    root: str,
    *,
    schema: str = DEFAULT_SCHEMA,
    **options,
) -> list[str]:
    """INSERT scripts per table and one over all tables, parents first."""
    counts = row_counts(spark, tables)
    scripts = script_lines(catalog, tables, counts, schema=schema, **options)
    combined = f"{root}/consolidated_dml.sql"
    paths = write_table_scripts(scripts, root)
    write_combined_script(scripts, closing_lines(spark, counts, schema), combined)
    return [*paths, combined]
