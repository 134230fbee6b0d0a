"""What all operators share: reading a table, naming a row, writing between jobs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablewright.sources.workspace import materialized

__all__ = [
    "arrow_schema",
    "given",
    "keyed",
    "materialized",
    "record_batch",
    "rejoined",
    "text_key",
    "texts",
]

# Columns of the given tables that the queries read.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def text_key(column: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, text``: rows alike in both are alike in every result,
    so repeated rows and repeated or null ids need no number of their own."""
    return texts(docs).select("doc_id", text_key().alias("text_key"), "text")


def rejoined(docs: DataFrame, results: DataFrame, how: str = "left") -> DataFrame:
    """The rows of ``docs`` as one struct ``row`` (whatever their columns are
    called), with the columns of ``results``, which has one row a key."""
    left = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("_id"), text_key().alias("_key")
    )
    right = results.withColumnsRenamed({"doc_id": "_rid", "text_key": "_rkey"})
    return left.join(
        right, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_key") == F.col("_rkey")), how
    ).drop("_id", "_key", "_rid", "_rkey")


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a result's declared columns."""
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def record_batch(rows: Iterable[Sequence], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch of the declared types, also where there are none."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
