"""Declared type names -> SQL types, and text -> typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

# The first name found inside the declared type decides.
SQL_TYPES = (
    ("pk", "BIGINT"),
    ("fk", "BIGINT"),
    ("int", "BIGINT"),
    ("long", "BIGINT"),
    ("decimal", "DECIMAL(19,2)"),
    ("float", "DOUBLE"),
    ("double", "DOUBLE"),
    ("bool", "BOOLEAN"),
    ("timestamp", "TIMESTAMP"),
    ("datetime", "TIMESTAMP"),
    ("date", "DATE"),
    ("email", "VARCHAR(255)"),
    ("phone", "VARCHAR(20)"),
    ("enum", "VARCHAR(100)"),
)
OTHER_SQL_TYPE = "VARCHAR(255)"


def sql_type(declared: str) -> str:
    name = declared.lower()
    return next((sql for part, sql in SQL_TYPES if part in name), OTHER_SQL_TYPE)


def typed_value(column: str, declared: str) -> str:
    """A text column as its declared type; null where it does not parse."""
    target = sql_type(declared)
    return f"`{column}`" if target.startswith("VARCHAR") else f"try_cast(`{column}` AS {target})"


def typed_projection(texts: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return texts.selectExpr(*[f"{typed_value(c, kind)} AS `{c}`" for c, kind in kinds.items()])


def cast_failures(texts: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Per column, how many non-null texts do not parse: one scan, one row per task."""
    counts = texts.selectExpr(
        *[
            f"count_if(`{c}` IS NOT NULL AND {typed_value(c, kind)} IS NULL) AS `{c}`"
            for c, kind in kinds.items()
        ]
    )
    return counts.unpivot([], list(kinds), "column_name", "failed_casts")
