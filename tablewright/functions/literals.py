"""Small constant frames that stay in the JVM."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_frame(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A frame of driver-side constants, bounded by the catalog they come from."""
    row_type = T.StructType.fromDDL(schema)
    text = json.dumps([dict(zip(row_type.fieldNames(), row)) for row in rows])
    parsed = F.from_json(F.lit(text), T.ArrayType(row_type))
    return spark.range(0, 1, 1, 1).select(F.inline(parsed))
