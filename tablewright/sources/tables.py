"""Reading tables: declared schemas, all part files, missing tables as None."""

from __future__ import annotations

from collections.abc import Collection
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import types as T

from tablewright.catalog import OUTPUT_FORMATS, Catalog


#: Text comes back as it was written: quotes are doubled, spaces are kept.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


#: What stands for an empty field while a file is read; no file holds it.
NO_TEXT = "\x00null\x00"


#: The raw line of a row that is no row of the table; no table has one of this name.
MALFORMED = "_tablewright_malformed"


def _csv(spark: SparkSession, texts: bool) -> DataFrameReader:
    """Values may hold line breaks where there are texts: such files are read by one
    task each, others are split.  An empty field is null, and a quoted empty one
    is the empty text."""
    return spark.read.options(**CSV_OPTIONS, multiLine=texts, nullValue=NO_TEXT)


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: T.StructType | None = None,
    *,
    single_line: Collection[str] = (),
) -> DataFrame | None:
    """One table, or None when nothing is stored at ``path``.

    With a declared schema nothing is inferred: no extra pass over the data,
    and digits in a text column stay text.  Columns go by name: a csv table may
    hold them in any order, lack some, or have more, which are read as text; a
    file whose header is not that of the first one fails the job that reads it.
    Parquet files bring their own schema.  Without a declared schema, csv and
    json infer theirs.

    ``single_line`` names text columns whose values are promised to hold no line
    break.  Where all texts of a csv table are, its files are split among tasks.
    Lines that are no rows are looked at while reading: one with an open quote
    breaks the promise and fails the job.  What this cannot see, the rest of a
    broken value of the last column that has just the fields of a row, a scan with
    `broken_lines` does.
    """
    if fmt not in OUTPUT_FORMATS:
        raise ValueError(f"format {fmt!r} is not one of {OUTPUT_FORMATS}")
    try:
        if fmt == "parquet":
            return spark.read.parquet(path)
        if fmt == "json":
            reader = spark.read if schema is None else spark.read.schema(schema)
            return reader.json(path)
        if schema is None:
            return _csv(spark, True).option("inferSchema", True).csv(path)
        types = {f.name: f.dataType for f in schema}
        header = read_csv_text(spark, path).columns
        found = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in header])
        texts = {f.name for f in found if isinstance(f.dataType, T.StringType)}
        # Of a single column every line is a row, so nothing would be noticed there.
        if texts and texts <= set(single_line) and len(found) > 1:
            return _split_csv(spark, path, found)
        reader = _csv(spark, bool(texts)).option("enforceSchema", False)
        return reader.schema(found).csv(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _split_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of files that any number of tasks may share, by lines."""
    reader = _csv(spark, False).option("enforceSchema", False).option("columnNameOfCorruptRecord", MALFORMED)
    rows = reader.schema(T.StructType([*schema.fields, T.StructField(MALFORMED, T.StringType())])).csv(path)
    # The message names a value, since a scan of the raw lines alone is not allowed.
    first = f"coalesce(CAST(`{schema.fields[0].name}` AS string), '')"
    return rows.where(
        f"""CASE WHEN {_open_quote(MALFORMED)} THEN raise_error(concat(
        'a text promised to be on a single line is not, near ', {first}, ': ', {MALFORMED})) ELSE true END"""
    ).select(*schema.names)


def _open_quote(line: str) -> str:
    """Whether a line ends within quotes: true of every line in which a value with a
    line break starts, of any csv file with doubled quotes."""
    return f"""coalesce((length({line}) - length(replace({line}, '"', ''))) % 2 = 1, false)"""


def broken_lines(spark: SparkSession, path: str) -> int:
    """How many lines of csv files start or end a value with a line break, by their
    quotes: 0 if and only if every value is on a single line.  One split scan."""
    return spark.read.text(path).where(_open_quote("value")).count()


def read_csv_text(spark: SparkSession, path: str, *, single_line: bool = False) -> DataFrame:
    """Every column as text, over every part file of the folder; ``single_line``
    promises that no value holds a line break, as for `read_table`."""
    whole = _csv(spark, True).csv(path)
    if single_line and len(whole.columns) > 1:
        return _split_csv(spark, path, whole.schema)
    return whole


def read_dataset(
    spark: SparkSession,
    root: str,
    catalog: Catalog,
    fmt: str | None = None,
    *,
    at_once: int = 8,
) -> dict[str, DataFrame | None]:
    """Every declared table under ``root``; missing ones are None.

    Looking for a table and at a file's header takes a small job; a few run at
    once.
    """
    fmt = fmt or catalog.output_format

    def read(name: str) -> DataFrame | None:
        spec = catalog.tables[name]
        return read_table(
            spark, f"{root}/{name}", fmt, spec.schema, single_line=catalog.single_line(name)
        )

    with ThreadPoolExecutor(at_once) as jobs:
        return dict(zip(catalog.tables, jobs.map(read, catalog.tables)))
