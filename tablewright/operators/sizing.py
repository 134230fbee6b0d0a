"""How many tasks a number of rows deserves, and what is safe to broadcast."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROWS_PER_PARTITION = 2_000_000
MIN_ROWS_PER_PARTITION = 50_000

# Keys held by every executor at once, of all joins together; far below what a hash
# relation may take.
BROADCAST_BYTES = 64 << 20
FIXED_KEY_BYTES = 32


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Small inputs use no more tasks than they can fill; large ones get as
    many as keep a partition at ``ROWS_PER_PARTITION``."""
    fill = min(spark.sparkContext.defaultParallelism, -(-rows // MIN_ROWS_PER_PARTITION))
    return max(1, fill, -(-rows // ROWS_PER_PARTITION))


def key_bytes(keys: DataFrame, column: str) -> int:
    """Measured size of a key column in a hash relation.

    Over parquet the row count comes from the footers; only text and binary
    keys need a scan of their lengths.
    """
    size = f"count(*) * {FIXED_KEY_BYTES}"
    if isinstance(keys.schema[column].dataType, (T.StringType, T.BinaryType)):
        size += f" + coalesce(sum(octet_length(`{column}`)), 0)"
    return keys.selectExpr(size).first()[0]


class BroadcastBudget:
    """Bytes that the hash relations of jobs running at once may take together.

    Jobs ask an account for the measured size of each relation; what does not
    fit beside those of the other jobs is refused and has to be joined another
    way.  An account gives back all it was granted when its job is done.
    """

    def __init__(self, limit: int = BROADCAST_BYTES):
        self.limit = limit
        self.granted = 0
        self._lock = threading.Lock()

    @contextmanager
    def account(self) -> Iterator[Account]:
        account = Account(self)
        try:
            yield account
        finally:
            with self._lock:
                self.granted -= account.held

    def take(self, size: int) -> bool:
        with self._lock:
            if self.granted + size > self.limit:
                return False
            self.granted += size
            return True


class Account:
    def __init__(self, budget: BroadcastBudget):
        self.budget = budget
        self.held = 0

    def grants(self, size: int) -> bool:
        granted = self.budget.take(size)
        self.held += size if granted else 0
        return granted
