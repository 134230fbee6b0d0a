"""Declared relational data sets on Spark: generate, validate, clean, report, export."""

from tablewright.catalog import Catalog, ForeignKey, TableSpec
from tablewright.plans.dataset import (
    clean,
    export_sql,
    generate,
    report,
    table_details,
    validate,
    write_dataset,
)
from tablewright.sources.tables import read_dataset, read_table

__all__ = [
    "Catalog",
    "ForeignKey",
    "TableSpec",
    "clean",
    "export_sql",
    "generate",
    "read_dataset",
    "read_table",
    "report",
    "table_details",
    "validate",
    "write_dataset",
]
