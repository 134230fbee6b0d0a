"""A key ledger that is kept, so that growing tables are validated by what was added.

The ledger is a Spark table bucketed by ``entry``, one text for parent and key.
Keys of added rows are combined and dealt to the same buckets; there each
bucket of the stored table meets its share, so stored keys are read but neither
shuffled nor gathered from the original rows again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.catalog import ForeignKey
from tablewright.operators.hierarchy import key_text
from tablewright.operators.integrity import Plan, Tables, key_ledger, validated
from tablewright.sources.workspace import delete, workspace

BUCKETS = 64
ENTRY = "entry"


@dataclass(frozen=True)
class StoredLedger:
    """Ledgers of all references, one table for each type of key: its name and folder."""

    spark: SparkSession
    plan: Plan
    buckets: int
    tables: dict[str, tuple[str, str]]

    def frames(self) -> dict[str, DataFrame]:
        return {kind: self.spark.table(name) for kind, (name, _) in self.tables.items()}

    def checked(self, null_policy: str = "orphan") -> DataFrame:
        """What `fk_validate_all` gives over all rows so far, from the ledger alone."""
        return validated(self.spark, self.plan, null_policy, self.frames())

    def appended(self, added: Tables) -> StoredLedger:
        """The ledger with the keys of added rows, as new tables; this one stays.

        ``added`` has new rows by table name, of parents or children; they are
        read once, their key columns only.  Rows of unknown tables are an error.
        """
        unknown = [n for n in added if self.plan.tables.get(n) is None]
        if unknown:
            raise ValueError(f"the ledger was begun without {unknown}")
        stored = {}
        for kind, before in self.frames().items():
            new = entries(self.plan, kind, added)
            if new is None:
                stored[kind] = self.tables[kind]
                continue
            stored[kind] = _stored(merged(before, new), self.buckets)
        return StoredLedger(self.spark, self.plan, self.buckets, stored)

    def drop(self, keep: StoredLedger | None = None) -> None:
        """Removes the tables and their folders, but for those another ledger shares."""
        shared = set(keep.tables.values()) if keep else set()
        for name, path in set(self.tables.values()) - shared:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, path)


def fk_ledger(
    spark: SparkSession, edges: Iterable[ForeignKey], tables: Tables, *, buckets: int = BUCKETS
) -> StoredLedger:
    """The ledger of all rows of today; ``buckets`` should suit the number of keys, some
    millions each.  References to missing tables are SKIPPED, then and later."""
    plan = Plan(edges, tables)
    # A task a bucket, so each bucket is one file; merging keeps it so.
    ledgers = {kind: entries(plan, kind).repartition(buckets, ENTRY) for kind in plan.kinds}
    stored = {kind: _stored(ledger, buckets) for kind, ledger in ledgers.items()}
    return StoredLedger(spark, plan, buckets, stored)


def entries(plan: Plan, kind: str, tables: Tables | None = None) -> DataFrame | None:
    """The ledger of some tables with the ``entry`` of each row; null without a key."""
    ledger = key_ledger(plan, kind, tables)
    if ledger is None:
        return None
    return ledger.withColumn(ENTRY, F.expr(f"concat(parent, ':', {key_text('key', kind)})"))


def merged(before: DataFrame, new: DataFrame) -> DataFrame:
    """Two ledgers as one.  Entries meet by a plain equi-join, so the buckets of the
    stored one are its partitions already; rows without a key, one a parent, are
    few and are added up apart."""
    counters = [c for c in before.columns if c.startswith("n")]
    own = [c for c in before.columns if c != ENTRY]
    named = new.where("key IS NOT NULL").withColumnsRenamed({c: f"_{c}" for c in own})

    def either(column: str, other) -> Column:
        return F.coalesce(F.col(column), F.lit(other))

    with_key = before.where("key IS NOT NULL").join(named, ENTRY, "full").select(
        F.coalesce("parent", "_parent").alias("parent"),
        F.coalesce("key", "_key").alias("key"),
        (either("present", False) | either("_present", False)).alias("present"),
        *((either(c, 0) + either(f"_{c}", 0)).alias(c) for c in counters),
        ENTRY,
    )
    keyless = before.unionByName(new).where("key IS NULL").groupBy("parent", "key", ENTRY)
    sums = keyless.agg(F.max("present").alias("present"), *(F.sum(c).alias(c) for c in counters))
    return with_key.unionByName(sums)


def _stored(ledger: DataFrame, buckets: int) -> tuple[str, str]:
    name, path = f"key_ledger_{uuid.uuid4().hex}", workspace(ledger.sparkSession)
    dealt = ledger.write.format("parquet").bucketBy(buckets, ENTRY).sortBy(ENTRY)
    dealt.option("path", path).saveAsTable(name)
    return name, path
