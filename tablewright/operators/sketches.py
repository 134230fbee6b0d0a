"""Column profiles from sketches that can be kept and merged.

Every part of a table (a day, a load) is read once and leaves one row: counts,
typed extremes, and for each column a HyperLogLog sketch of its distinct values
and, for numbers, a KLL sketch of their quantiles.  Profiles of any parts
together are merged from those rows, without a shuffle of values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.literals import literal_frame
from tablewright.operators.profile import distinct_counts, has_order, value_text
from tablewright.sources.workspace import materialized

# A sketch has 2 ** HLL_BITS registers of a byte; an estimate is within three standard errors
# of the true number but in about 3 of 1000 cases.
HLL_BITS = 12
HLL_BOUND = 3 * 1.04 / 2 ** (HLL_BITS / 2)
# Ranks of KLL quantiles of this many items are within 1.65 %, at 99 %.
KLL_ITEMS = 200
QUARTILES = (0.25, 0.5, 0.75)


def _number(field: T.StructField) -> str | None:
    """A number to sketch the quantiles of; null for NaN."""
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return f"if(isnan(`{field.name}`), NULL, CAST(`{field.name}` AS double))"
    return f"CAST(`{field.name}` AS double)" if isinstance(field.dataType, T.NumericType) else None


def column_sketches(table: DataFrame, *parts: str) -> DataFrame:
    """One row for each value of the columns ``parts``, or one for the whole table:
    ``rows`` and, for the column of number i, ``nulls{i}``, ``min{i}``, ``max{i}``,
    ``hll{i}``, and of numbers ``kll{i}`` and how many are in it, ``n{i}``.  One scan; a
    task sends a row a part."""
    measures = ["count(*) AS rows"]
    for i, f in enumerate(f for f in table.schema.fields if f.name not in parts):
        measures += [
            f"count_if(`{f.name}` IS NULL) AS nulls{i}",
            f"hll_sketch_agg({value_text(f.name, f.dataType)}, {HLL_BITS}) AS hll{i}",
        ]
        if has_order(f.dataType):
            measures += [f"{m}(`{f.name}`) AS {m}{i}" for m in ("min", "max")]
        if number := _number(f):
            measures += [f"kll_sketch_agg_double({number}, {KLL_ITEMS}) AS kll{i}", f"count({number}) AS n{i}"]
    return table.groupBy(*parts).agg(*map(F.expr, measures))


def merged_profile(sketches: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """The profile of all parts whose sketches are given, one row a column in the order of
    ``fields``, the profiled columns: ``position, column_name, data_type, nullable,
    row_count, null_rows, min_value, max_value, distinct_values, distinct_low,
    distinct_high, quartiles``.

    Distinct values are estimates between bounds that hold but in 3 of 1000 cases;
    quartiles are null for what is no number."""
    merged, entries = ["sum(rows) AS rows"], []
    for i, f in enumerate(fields):
        merged += [f"sum(nulls{i}) AS nulls{i}", f"coalesce(hll_sketch_estimate(hll_union_agg(hll{i})), 0L) AS d{i}"]
        low = high = quartiles = "NULL"
        if has_order(f.dataType):
            merged += [f"{m}({m}{i}) AS {m}{i}" for m in ("min", "max")]
            low, high = f"CAST(min{i} AS string)", f"CAST(max{i} AS string)"
        if _number(f):
            # Parts without a number have nothing to merge.
            kept = f"kll_merge_agg_double(kll{i}) FILTER (WHERE n{i} > 0)"
            merged += [f"{kept} AS kll{i}", f"sum(n{i}) AS n{i}"]
            found = ", ".join(f"kll_sketch_get_quantile_double(kll{i}, {q}D)" for q in QUARTILES)
            quartiles = f"if(n{i} > 0, array({found}), NULL)"
        entries.append(
            f"struct({i} AS position, coalesce(rows, 0L) AS row_count, coalesce(nulls{i}, 0L) AS null_rows, "
            f"CAST({low} AS string) AS min_value, CAST({high} AS string) AS max_value, d{i} AS distinct_values, "
            f"CAST(floor(d{i} * {1 - HLL_BOUND}D) AS bigint) AS distinct_low, "
            f"CAST(ceil(d{i} * {1 + HLL_BOUND}D) AS bigint) AS distinct_high, "
            f"CAST({quartiles} AS array<double>) AS quartiles)"
        )
    measured = sketches.selectExpr(*merged).selectExpr(f"inline(array({', '.join(entries)}))")
    described = literal_frame(
        sketches.sparkSession,
        "position int, column_name string, data_type string, nullable boolean",
        [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields)],
    )
    return described.join(F.broadcast(measured), "position")


def bounded_profile(table: DataFrame, *, exact_below: int = 10_000) -> DataFrame:
    """The profile of a table in which distinct values are counted exactly only where
    sketches say that there are fewer than ``exact_below``.

    ``estimated`` marks the others, whose number lies between ``distinct_low`` and
    ``distinct_high``.  The exact counts take a second scan, of those columns alone,
    and shuffle about ``exact_below`` values a column and task at most."""
    fields = table.schema.fields
    profile = materialized(merged_profile(column_sketches(table), fields))
    rough = profile.select("position", "distinct_values").collect()  # one row a column
    small = sorted(r["position"] for r in rough if r["distinct_values"] < exact_below)
    return with_exact(profile, table, small).drop("position")


def with_exact(profile: DataFrame, table: DataFrame, small: Sequence[int]) -> DataFrame:
    """Estimates of the columns at the positions ``small`` replaced by counts."""
    marked = profile.withColumn("estimated", ~F.col("position").isin(*small) if small else F.lit(True))
    if not small:
        return marked
    counted = distinct_counts(table.select(*(f"`{table.columns[i]}`" for i in small)))
    places = F.array(*map(F.lit, small))
    exact = counted.select(F.element_at(places, F.col("position") + 1).alias("position"), "n")
    number = F.coalesce("n", F.lit(0))
    return marked.join(F.broadcast(exact), "position", "left").withColumns(
        {
            c: F.when(F.col("estimated"), F.col(c)).otherwise(number)
            for c in ("distinct_values", "distinct_low", "distinct_high")
        }
    ).drop("n")
