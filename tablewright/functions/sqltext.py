"""SQL text from rows: identifiers, literals and INSERT statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.types import sql_type

DEFAULT_SCHEMA = "SalesLT"

# Opening and closing identifier quotes of each dialect.
IDENTIFIER_QUOTES = {"mssql": "[]", "mysql": "``", "ansi": '""'}


def quoted(name: str, dialect: str = "mssql") -> str:
    left, right = IDENTIFIER_QUOTES[dialect]
    return left + name.replace(right, right * 2) + right


def qualified(table: str, schema: str = DEFAULT_SCHEMA, dialect: str = "mssql") -> str:
    return f"{quoted(schema, dialect)}.{quoted(table, dialect)}"


def sql_literal(value: str, declared: str) -> str:
    """A value of the declared type as SQL text; null and empty text give NULL."""
    target = sql_type(declared)
    text = f"CAST({value} AS string)"
    if target == "BOOLEAN":
        body = f"if(lower({text}) IN ('true', '1', 'yes'), '1', '0')"
    elif target in ("BIGINT", "DOUBLE", "DECIMAL(19,2)"):
        body = text
    else:
        quote = "chr(39)"
        body = f"concat({quote}, replace({text}, {quote}, concat({quote}, {quote})), {quote})"
    return f"if({value} IS NULL OR {text} = '', 'NULL', {body})"


def insert_statements(
    rows: DataFrame,
    table: str,
    kinds: dict[str, str],
    *,
    schema: str = DEFAULT_SCHEMA,
    dialect: str = "mssql",
    quote_fk: bool = False,
) -> DataFrame:
    """One INSERT per row in column ``stmt``; a map-only projection.

    ``kinds`` gives the declared type per column, text when missing.
    ``quote_fk`` writes foreign key values as quoted text.  Fractions held as
    floating point under a decimal declaration are rendered with two decimals.
    """
    columns = ", ".join(quoted(c, dialect) for c in rows.columns)
    prefix = f"INSERT INTO {qualified(table, schema, dialect)} ({columns}) VALUES ("
    literals = []
    for column in rows.schema.fields:
        kind = kinds.get(column.name, "string")
        if quote_fk and kind == "fk":
            kind = "string"
        value = quoted(column.name, "mysql")
        if kind == "decimal" and isinstance(column.dataType, (T.DoubleType, T.FloatType)):
            value = f"CAST({value} AS decimal(19,2))"
        literals.append(sql_literal(value, kind))
    body = F.expr(f"concat_ws(', ', {', '.join(literals)})")
    return rows.select(F.concat(F.lit(prefix), body, F.lit(");")).alias("stmt"))
