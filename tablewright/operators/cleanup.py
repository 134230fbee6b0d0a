"""Removing orphaned rows: one reference, one table, a whole cascade."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.catalog import Catalog, ForeignKey
from tablewright.operators.hierarchy import lost_keys
from tablewright.operators.integrity import (
    KEY,
    Tables,
    fk_validate_all,
    joined_by_key,
    joined_to_orphans,
    key_comparison,
    orphan_keys,
)
from tablewright.operators.profile import table_counts
from tablewright.operators.sizing import BROADCAST_BYTES, Account, BroadcastBudget, key_bytes
from tablewright.sources.sinks import write_table
from tablewright.sources.tables import read_table
from tablewright.sources.workspace import scratch, workspace


def fk_filter(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose key the parent has; null keys drop.

    A semi join: repeated parent keys do no harm, the optimizer broadcasts the
    parent's keys when they are small and splits hot child keys when not.
    """
    edge = ForeignKey("child", column, "parent", parent_column)
    form = key_comparison(edge, {"child": child, "parent": parent})
    keys = parent.selectExpr(f"{form.parent} AS {KEY}")
    return joined_by_key(child, form.child, keys, "left_semi")


def fk_clean_table(
    child: DataFrame,
    edges: Iterable[ForeignKey],
    parents: Tables,
    *,
    broadcast_limit: int = BROADCAST_BYTES,
    sizes: dict[tuple[str, str], int] | None = None,
    account: Account | None = None,
    orphans: Account | None = None,
) -> DataFrame:
    """Rows whose every key has its parent; references to missing tables are skipped.

    References to parents whose keys measurably fit every executor, all of them
    together, become map-side semi joins in one pass, smallest parents first.
    For all others together, one pass over key columns finds the orphaned keys;
    dropping those is map-side again as far as ``BROADCAST_BYTES`` hold them, whole
    numbers as bits, so whole rows are shuffled only where they do not.  ``sizes``
    keeps measured key sizes by (parent, column) between calls; ``account`` and, for
    orphaned keys, ``orphans`` are shares of budgets that other jobs draw on as
    well, the first in place of ``broadcast_limit``.
    """
    if account is None:
        with BroadcastBudget(broadcast_limit).account() as own:
            return fk_clean_table(child, edges, parents, sizes=sizes, account=own, orphans=orphans)
    if orphans is None:
        with BroadcastBudget().account() as own:
            return fk_clean_table(child, edges, parents, sizes=sizes, account=account, orphans=own)
    sizes = {} if sizes is None else sizes
    given = child
    large = []
    present = [e for e in edges if parents.get(e.parent) is not None]
    for edge in present:
        place = (edge.parent, edge.parent_column)
        if place not in sizes:
            sizes[place] = key_bytes(parents[edge.parent], edge.parent_column)
    for edge in sorted(present, key=lambda e: sizes[e.parent, e.parent_column]):
        parent, size = parents[edge.parent], sizes[edge.parent, edge.parent_column]
        if not edge.nullable and account.grants(size):
            form = key_comparison(edge, {**parents, edge.child: given})
            keys = F.broadcast(parent.selectExpr(f"{form.parent} AS {KEY}"))
            child = joined_by_key(child, form.child, keys, "left_semi")
        else:
            large.append(edge)
    if large:
        names = {edge.child: given for edge in large}
        for edge, bad in orphan_keys(large, {**parents, **names}).items():
            form = key_comparison(edge, {**parents, **names})
            kept = joined_to_orphans(child, form, bad, "left_anti", orphans)
            child = kept if edge.nullable else kept.where(F.col(edge.column).isNotNull())
    return child


@dataclass(frozen=True)
class CleanedDataset:
    """Tables after the cascade; untouched ones are the very input."""

    before: dict[str, DataFrame | None]
    tables: dict[str, DataFrame | None]
    rewritten: tuple[str, ...]

    def summary(self) -> DataFrame:
        """Rows before, after and removed per table."""
        spark = next(t for t in self.tables.values() if t is not None).sparkSession
        before = table_counts(spark, self.before).withColumnRenamed("row_count", "rows_before")
        after = table_counts(spark, self.tables).withColumnRenamed("row_count", "rows_after")
        return before.join(F.broadcast(after), "table_name").withColumn(
            "rows_removed", F.col("rows_before") - F.col("rows_after")
        )


def fk_clean_cascade(
    catalog: Catalog,
    tables: Tables,
    *,
    folder: str | None = None,
    fmt: str = "parquet",
    broadcast_limit: int = BROADCAST_BYTES,
    at_once: int = 4,
) -> CleanedDataset:
    """Clean every table, parents first, so children see cleaned parents.

    One validation pass tells which references have orphans.  A table is only
    rewritten when one of its own references has some, or one of its parents
    lost rows.  Rewritten tables go to a new folder, in ``fmt``; the input is
    never changed, and each written table is what its children are joined to.
    Tables cleaned at once share ``broadcast_limit``; what they wrote on the way
    is deleted at the end.
    Of tables that refer to themselves or to each other only the keys are
    followed, to the end (`hierarchy.lost_keys`); their rows are written once.
    """
    present = [t for t in tables.values() if t is not None]
    if not present:
        return CleanedDataset(dict(tables), dict(tables), ())
    spark = present[0].sparkSession
    with scratch(spark):
        return _cascaded(
            spark, catalog, tables, folder or workspace(spark), fmt, BroadcastBudget(broadcast_limit), at_once
        )


def _cascaded(
    spark: SparkSession,
    catalog: Catalog,
    tables: Tables,
    folder: str,
    fmt: str,
    budget: BroadcastBudget,
    at_once: int,
) -> CleanedDataset:
    checked = fk_validate_all(spark, catalog.all_edges, tables)
    dirty = {
        (row.child_table, row.fk_column)
        for row in checked.where("orphaned > 0").select("child_table", "fk_column").collect()
    }
    references = {name: t.foreign_keys + t.nullable_keys for name, t in catalog.tables.items()}
    cleaned = dict(tables)
    rewritten: list[str] = []
    sizes: dict[tuple[str, str], int] = {}
    orphan_budget = BroadcastBudget()

    def concerned(name: str, parents: Tables) -> list[ForeignKey]:
        """References of a table that are to be applied now."""
        if parents.get(name) is None:
            return []
        return [e for e in references[name] if (name, e.column) in dirty or e.parent in rewritten]

    def applied(
        name: str, edges: list[ForeignKey], parents: Tables, account: Account, orphans: Account
    ) -> DataFrame:
        return fk_clean_table(parents[name], edges, parents, sizes=sizes, account=account, orphans=orphans)

    def stored(name: str, kept: DataFrame) -> DataFrame:
        write_table(kept, f"{folder}/{name}", fmt)
        return read_table(
            spark, f"{folder}/{name}", fmt, tables[name].schema, single_line=catalog.single_line(name)
        )

    def clean_one(name: str, parents: Tables, *accounts: Account) -> dict[str, DataFrame]:
        edges = concerned(name, parents)
        return {name: stored(name, applied(name, edges, parents, *accounts))} if edges else {}

    def clean_together(names: list[str], parents: Tables, *accounts: Account) -> dict[str, DataFrame]:
        now = {name: parents[name] for name in names if parents.get(name) is not None}
        if not any(concerned(name, parents) for name in now):
            return {}
        inner = [e for name in now for e in references[name] if e.parent in now]
        for name in now:
            outer = [e for e in concerned(name, parents) if e.parent not in names]
            now[name] = applied(name, outer, parents, *accounts)
        lost = lost_keys(inner, now) if inner else None
        done = {}
        for name, kept in now.items():
            for edge in (e for e in inner if e.child == name):
                gone = lost.keys.withColumnRenamed("node", KEY)
                kept = joined_by_key(kept, lost.nodes[edge], gone, "left_anti")
                kept = kept if edge.nullable else kept.where(F.col(edge.column).isNotNull())
            # Counting reads keys; whole rows are written once, and only where some go.
            if kept.count() < parents[name].count():
                done[name] = stored(name, kept)
        return done

    def clean(names: list[str], parents: Tables) -> dict[str, DataFrame]:
        own = {e.parent for n in names for e in references[n]} & set(names)
        with budget.account() as account, orphan_budget.account() as orphans:
            if own:
                return clean_together(names, parents, account, orphans)
            return clean_one(names[0], parents, account, orphans)

    # Tables of one load level wait for no other of it: they run at once, and
    # all see the tables as the levels before left them.
    levels = catalog.levels()
    ordered = sorted(catalog.components(), key=lambda names: levels[names[0]])
    with ThreadPoolExecutor(at_once) as jobs:
        for _, level in groupby(ordered, key=lambda names: levels[names[0]]):
            before = dict(cleaned)
            begun = [jobs.submit(copy_context().run, clean, names, before) for names in level]
            for done in [job.result() for job in begun]:
                cleaned |= done
                rewritten += done
    return CleanedDataset(dict(tables), cleaned, tuple(rewritten))
