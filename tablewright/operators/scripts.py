"""INSERT scripts: statements of whole tables in load order."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.catalog import Catalog
from tablewright.functions.literals import literal_frame
from tablewright.functions.sqltext import DEFAULT_SCHEMA, insert_statements
from tablewright.operators.integrity import Tables
from tablewright.operators.profile import table_counts


def row_counts(spark: SparkSession, tables: Tables) -> dict[str, int]:
    """Rows of every table that is there, counted once; one number a table."""
    counted = table_counts(spark, tables).where("row_count IS NOT NULL")
    return {row.table_name: row.row_count for row in counted.collect()}


def script_lines(
    catalog: Catalog,
    tables: Tables,
    counts: dict[str, int],
    *,
    schema: str = DEFAULT_SCHEMA,
    dialect: str = "mssql",
    quote_fk: bool = False,
) -> dict[str, DataFrame]:
    """Per table, in load order: a heading and one INSERT per row in column ``line``.

    The heading is the first partition, so the part files of a written table
    are in order.
    """
    scripts = {}
    present = [name for name in catalog.load_order() if tables.get(name) is not None]
    for number, name in enumerate(present, start=1):
        rows = tables[name]
        statements = insert_statements(
            rows,
            name,
            catalog.tables[name].kinds,
            schema=schema,
            dialect=dialect,
            quote_fk=quote_fk,
        )
        lines = _heading(f"{number:0{_digits(len(present))}d}", number, name, counts[name])
        heading = literal_frame(rows.sparkSession, "line string", [(line,) for line in lines])
        scripts[name] = heading.union(statements.select(F.col("stmt").alias("line")))
    return scripts


def _digits(count: int) -> int:
    """Digits of a place among ``count``, so that names sort as numbers do."""
    return max(2, len(str(count)))


def _heading(place: str, number: int, table: str, rows: int) -> list[str]:
    # The five heading lines of a table's script.
    return [
        f"-- File Order: {number}",
        f"-- Table: {table}",
        f"-- INSERT statements for {table}",
        f"-- Generated: {rows} rows",
        f"-- Execute in order: {place}_{table}.sql",
    ]


def write_table_scripts(
    scripts: dict[str, DataFrame], root: str, at_once: int = 4, *, compression: str = "none"
) -> list[str]:
    """One folder of text part files per table: ``NN_<Table>.sql``.

    Statements repeat their table's columns in every line; ``compression``, as Spark's
    text files know it, makes them a fraction of their size (`_write_text`).
    """
    width = _digits(len(scripts))
    numbered = enumerate(scripts.items(), start=1)
    paths = {f"{root}/{number:0{width}d}_{name}.sql": lines for number, (name, lines) in numbered}
    _write_text(paths, at_once, compression)
    return list(paths)


def closing_lines(
    spark: SparkSession, counts: dict[str, int], schema: str = DEFAULT_SCHEMA
) -> DataFrame:
    """The end of a script over all tables: the total of its rows."""
    # The three closing lines.
    lines = [
        f"-- Total rows inserted: {sum(counts.values()):,}",
        f"-- Total tables: {len(counts)}",
        f"-- Schema: {schema}",
    ]
    return literal_frame(spark, "line string", [(line,) for line in lines])


def write_combined_script(
    scripts: dict[str, DataFrame], closing: DataFrame, path: str, at_once: int = 4, *, compression: str = "none"
) -> None:
    """All tables' scripts and the closing lines under ``load_order=NN`` folders.

    Sorted by name, the part files of all folders are one script in load order;
    every partition of every table writes its own, with no shuffle and no sort.
    What an earlier export left under ``path`` goes first.
    """
    parts = [*scripts.values(), closing]
    width = _digits(len(parts))
    nothing = closing.where("false").withColumn("load_order", F.lit(""))
    nothing.write.mode("overwrite").partitionBy("load_order").text(path)
    _write_text({f"{path}/load_order={n:0{width}d}": part for n, part in enumerate(parts, 1)}, at_once, compression)


# Lines of a compressed file, which one task reads.
FILE_LINES = 1_000_000


def _write_text(frames: dict[str, DataFrame], at_once: int, compression: str) -> None:
    """Compressed files are ended after ``FILE_LINES``; by name they stay in order."""

    def write(path: str, lines: DataFrame) -> None:
        writer = lines.write.mode("overwrite")
        if compression != "none":
            writer = writer.option("maxRecordsPerFile", FILE_LINES)
        writer.text(path, compression=compression)

    with ThreadPoolExecutor(at_once) as jobs:
        list(jobs.map(write, *zip(*frames.items(), strict=True)))
