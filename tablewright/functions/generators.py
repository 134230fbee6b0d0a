"""One column expression per declared column type, computed from the row id."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.catalog import ColumnSpec, TableSpec
from tablewright.functions.draws import chance, draw

DEFAULT_AS_OF = datetime(2025, 1, 1, tzinfo=timezone.utc)
SECONDS_PER_DAY = 86_400


@dataclass(frozen=True)
class Context:
    """What a generated value may depend on besides its row id.

    ``constant_timestamps`` gives every row the far end of its range, and
    ``inclusive_ints`` lets whole numbers reach their declared maximum.
    """

    seed: int = 42
    as_of: datetime = DEFAULT_AS_OF
    parent_rows: dict[str, int] = field(default_factory=dict)
    constant_timestamps: bool = False
    inclusive_ints: bool = False


def key_value(row_id: str) -> Column:
    return F.expr(f"CAST({row_id} AS bigint)")


def text_value(name: str, row_id: str) -> Column:
    return F.concat(F.lit(name + "_"), F.expr(row_id))


def email_value(row_id: str) -> Column:
    return F.expr(f"concat('user_', {row_id}, '@example.com')")


def phone_value(row_id: str) -> Column:
    """Always ten digits: a 9, then the last nine digits of the row id."""
    return F.expr(f"concat('9', lpad(CAST({row_id} % 1000000000 AS string), 9, '0'))")


def enum_value(values, tag: str, row_id: str, ctx: Context) -> Column:
    choice = F.expr(f"CAST({draw(ctx.seed, tag, row_id, len(values))} AS int) + 1")
    return F.elt(choice, *[F.lit(v) for v in values])


def decimal_value(low, high, tag: str, row_id: str, ctx: Context) -> Column:
    """Both bounds reachable; drawn in whole cents, so no rounding takes place."""
    first, last = (int((Decimal(str(b)) * 100).to_integral_value()) for b in (low, high))
    cents = f"{first}L + {draw(ctx.seed, tag, row_id, last - first + 1)}"
    return F.expr(f"CAST(CAST({cents} AS decimal(17,0)) * 0.01BD AS decimal(19,2))")


def boolean_value(probability: float, tag: str, row_id: str, ctx: Context) -> Column:
    return F.expr(chance(ctx.seed, tag, row_id, probability))


def timestamp_value(range_days: int, tag: str, row_id: str, ctx: Context) -> Column:
    anchor = int(ctx.as_of.timestamp())
    span = range_days * SECONDS_PER_DAY
    if ctx.constant_timestamps or span == 0:
        return F.expr(f"timestamp_seconds({anchor - span}L)")
    return F.expr(f"timestamp_seconds({anchor}L - {draw(ctx.seed, tag, row_id, span)})")


def int_value(low: int, high: int, tag: str, row_id: str, ctx: Context) -> Column:
    """Half open: the declared maximum is left out unless asked for."""
    width = int(high) - int(low) + (1 if ctx.inclusive_ints else 0)
    if width <= 0:
        return F.lit(int(low)).cast("int")
    return F.expr(f"CAST({int(low)}L + {draw(ctx.seed, tag, row_id, width)} AS int)")


def dense_fk_value(parent_rows: int, tag: str, row_id: str, ctx: Context) -> Column:
    """A key of a parent whose keys are 0..parent_rows-1: no join, no lookup.

    A parent without rows has no key to give, so the column is null.
    """
    if parent_rows < 1:
        return F.lit(None).cast("bigint")
    return F.expr(draw(ctx.seed, tag, row_id, parent_rows))


def nullable_fk_value(
    parent_rows: int, null_ratio: float, tag: str, row_id: str, ctx: Context
) -> Column:
    missing = F.expr(chance(ctx.seed, tag + "/null", row_id, null_ratio))
    return F.when(~missing, dense_fk_value(parent_rows, tag, row_id, ctx))


def column_value(table: TableSpec, column: ColumnSpec, row_id: str, ctx: Context) -> Column:
    tag = f"{table.name}.{column.name}"
    match column.kind:
        case "pk":
            return key_value(row_id)
        case "string":
            return text_value(column.name, row_id)
        case "email":
            return email_value(row_id)
        case "phone":
            return phone_value(row_id)
        case "enum":
            return enum_value(column.values, tag, row_id, ctx)
        case "decimal":
            return decimal_value(column.low, column.high, tag, row_id, ctx)
        case "boolean":
            return boolean_value(column.probability, tag, row_id, ctx)
        case "timestamp":
            return timestamp_value(column.range_days, tag, row_id, ctx)
        case "int":
            low = 0 if column.low is None else column.low
            high = 1000 if column.high is None else column.high
            return int_value(low, high, tag, row_id, ctx)
        case "fk":
            rows = ctx.parent_rows[column.ref_table]
            return nullable_fk_value(rows, column.null_ratio, tag, row_id, ctx)
        case _:
            raise ValueError(f"{tag}: no generator for column type {column.kind!r}")


def table_values(table: TableSpec, row_id: str, ctx: Context) -> dict[str, Column]:
    """Every column of a table in output order: foreign keys first."""
    keys = {
        fk.column: dense_fk_value(
            ctx.parent_rows[fk.parent], f"{table.name}.{fk.column}", row_id, ctx
        )
        for fk in table.foreign_keys
    }
    return keys | {c.name: column_value(table, c, row_id, ctx) for c in table.columns}
