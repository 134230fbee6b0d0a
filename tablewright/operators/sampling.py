"""Dense positions of arbitrary keys, and sampling by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.draws import draw
from tablewright.operators.sizing import BROADCAST_BYTES, key_bytes, partitions_for
from tablewright.sources.workspace import materialized

# A position inside a partition takes the low 33 bits of
# monotonically_increasing_id, the partition number the bits above them.
POSITION_BITS = 33


def dense_index(keys: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """Position ``idx`` of every row in the order of the given columns, from 0.

    The rows are written with a number that breaks ties, so a value that most
    rows hold is cut into ranges like any other.  One range shuffle sorts them;
    they are written again with their place (partition, offset), and the rows
    per partition, one number each, are summed up and joined back.  No task
    sees more than one range, and numbers and places are stored, so retries and
    re-planning cannot move them.
    """
    spark = keys.sparkSession
    numbered = materialized(keys.withColumn("_tie", F.monotonically_increasing_id()))
    parts = partitions or partitions_for(spark, numbered.count())
    placed = materialized(
        numbered.repartitionByRange(parts, *order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright("_place", POSITION_BITS)
    offset = F.col("_place").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    placed = placed.select(part.alias("_part"), offset.alias("_offset"), *keys.columns)
    # One row per partition: the unpartitioned window and the broadcast are
    # bounded by the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    return placed.join(F.broadcast(starts), "_part").select(
        (F.col("_start") + F.col("_offset")).alias("idx"), *keys.columns
    )


def sampled_keys(
    rows: DataFrame,
    row_id: str,
    parents: DataFrame,
    key: str,
    alias: str,
    *,
    seed: int,
    tag: str,
) -> DataFrame:
    """Every row with a uniformly drawn key of ``parents`` in column ``alias``.

    Keys may be of any type and have gaps: rows draw a position, and an
    equi-join on the position brings the key.  Draws are uniform, so the join
    has no hot key; the index is broadcast only when its measured size allows.
    Without parents the column is null.
    """
    keys = parents.select(key)
    count = keys.count()
    if count == 0:
        return rows.withColumn(alias, F.lit(None).cast(parents.schema[key].dataType))
    index = dense_index(keys, key, partitions=partitions_for(rows.sparkSession, count))
    named = index.select(F.col("idx").alias("_slot"), F.col(key).alias(alias))
    if key_bytes(keys, key) <= BROADCAST_BYTES:
        named = F.broadcast(named)
    slots = rows.withColumn("_slot", F.expr(draw(seed, tag, row_id, count)))
    # Every drawn position exists, so a left join keeps the same rows; unlike an
    # inner join it does not evaluate the draw once more to test it for null.
    return slots.join(named, "_slot", "left").drop("_slot")
