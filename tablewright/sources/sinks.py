"""Writing tables: every partition writes its own file, counted on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablewright.catalog import OUTPUT_FORMATS
from tablewright.sources.tables import CSV_OPTIONS


def write_table(
    frame: DataFrame,
    path: str,
    fmt: str = "csv",
    *,
    mode: str = "overwrite",
    max_records_per_file: int = 1_000_000,
) -> int:
    """Write one table and return its row count, observed while writing.

    No file has more than ``max_records_per_file`` rows: a csv file with texts that
    are not promised to be single lines is read by one task.
    """
    if fmt not in OUTPUT_FORMATS:
        raise ValueError(f"format {fmt!r} is not one of {OUTPUT_FORMATS}")
    written = Observation()
    writer = (
        frame.observe(written, F.count(F.lit(1)).alias("rows"))
        .write.format(fmt)
        .mode(mode)
        .option("maxRecordsPerFile", max_records_per_file)
    )
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.save(path)
    return written.get["rows"]
