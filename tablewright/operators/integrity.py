"""Referential integrity: counts, orphaned rows, keys, nulls.

Every count over foreign keys comes from one *key ledger*: child keys of all
declared references and the parents' own keys in one union, aggregated by
(parent, key).  Keys are combined before the shuffle, so a key that a third of
all rows hold crosses the network once per task; only (parent, key, counters)
move, never whole rows; and nothing is joined, broadcast or sorted.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.catalog import ForeignKey
from tablewright.functions.comparison import Comparison, comparison
from tablewright.functions.literals import literal_frame
from tablewright.operators.sizing import BROADCAST_BYTES, Account, BroadcastBudget, key_bytes
from tablewright.sources.workspace import materialized

Tables = Mapping[str, DataFrame | None]
# Key ledgers by the type of their keys.
Ledgers = Mapping[str, DataFrame]

EDGE_SCHEMA = (
    "child_table string, fk_column string, parent_table string, parent_column string, "
    "_parent int, _slot int, _readable boolean, _nullable boolean"
)
# The column of keys in comparable form; no table has one of this name.
KEY = "_tablewright_key"
# The columns of whole keys as bits: ``WORDS`` words of 64 bits, and the number of the row.
ROW, BITS, WORDS = "_tablewright_row", "_tablewright_bits", 8
ROW_BYTES = 160
WHOLE_KINDS = ("tinyint", "smallint", "int", "bigint")
EDGE_COLUMNS = ("child_table", "fk_column", "parent_table", "parent_column")


def total_of(column: str) -> str:
    return f"coalesce(sum({column}), 0L)"


class Plan:
    """Numbers the parents and the references into each of them."""

    def __init__(self, edges: Iterable[ForeignKey], tables: Tables):
        self.edges = list(edges)
        self.tables = tables
        self.parents: dict[tuple[str, str, str], int] = {}
        self.slots: dict[ForeignKey, int] = {}
        self.forms: dict[ForeignKey, Comparison] = {}
        self.used: dict[int, int] = {}
        for edge in self.edges:
            if not self.readable(edge):
                continue
            form = key_comparison(edge, tables)
            self.forms[edge] = form
            parent = self.parents.setdefault(
                (edge.parent, form.parent, form.kind), len(self.parents)
            )
            self.slots[edge] = self.used.get(parent, 0)
            self.used[parent] = self.slots[edge] + 1
        self.width = max(self.used.values(), default=0)

    def readable(self, edge: ForeignKey) -> bool:
        return None not in (self.tables.get(edge.child), self.tables.get(edge.parent))

    def parent_number(self, edge: ForeignKey) -> int:
        form = self.forms[edge]
        return self.parents[(edge.parent, form.parent, form.kind)]

    @property
    def kinds(self) -> list[str]:
        return list(dict.fromkeys(form.kind for form in self.forms.values()))

    def edges_frame(self, spark: SparkSession) -> DataFrame:
        rows = []
        for e in self.edges:
            ok = self.readable(e)
            place = (self.parent_number(e), self.slots[e]) if ok else (None, None)
            rows.append((e.child, e.column, e.parent, e.parent_column, *place, ok, e.nullable))
        return literal_frame(spark, EDGE_SCHEMA, rows)


def key_comparison(edge: ForeignKey, tables: Tables) -> Comparison:
    """How this reference's keys compare; the same for counting and for joining."""
    return comparison(
        tables[edge.child].schema[edge.column].dataType,
        f"`{edge.column}`",
        tables[edge.parent].schema[edge.parent_column].dataType,
        f"`{edge.parent_column}`",
    )


def _entries(entries: list[tuple]) -> list[str]:
    """(parent, key, slot) of every reference of a row, as one row each."""
    if len(entries) == 1:
        return [f"{value} AS {name}" for value, name in zip(entries[0], ("parent", "key", "slot"))]
    listed = ", ".join(str(value) for entry in entries for value in entry)
    return [f"stack({len(entries)}, {listed}) AS (parent, key, slot)"]


def key_ledger(plan: Plan, kind: str, tables: Tables | None = None) -> DataFrame | None:
    """Per (parent, key): is it a key of the parent, and how many rows of each
    reference hold it.  Each table is read once, its key columns only, whether
    child or parent or both.  ``tables`` are rows to read in place of the plan's;
    tables that it lacks add nothing, and None comes back if all do."""
    tables = plan.tables if tables is None else tables
    by_table: dict[str, list[tuple]] = {}
    for edge, slot in plan.slots.items():
        if plan.forms[edge].kind == kind:
            entry = (plan.parent_number(edge), plan.forms[edge].child, slot)
            by_table.setdefault(edge.child, []).append(entry)
    for (parent, form, parent_kind), number in plan.parents.items():
        if parent_kind == kind:
            by_table.setdefault(parent, []).append((number, form, -1))
    parts = [
        tables[table].selectExpr(*_entries(e)).where("slot >= 0 OR key IS NOT NULL")
        for table, e in by_table.items()
        if tables.get(table) is not None
    ]
    if not parts:
        return None
    counters = [F.expr(f"count_if(slot = {i}) AS n{i}") for i in range(plan.width)]
    entries = reduce(DataFrame.union, parts)
    return entries.groupBy("parent", "key").agg(F.expr("min(slot) < 0 AS present"), *counters)


def _per_edge(plan: Plan, measures: dict[str, str], ledgers: Ledgers | None) -> DataFrame | None:
    """Sum the ledgers up per reference.  ``measures`` are aggregates by name,
    over the counter ``n`` of the reference."""
    frames = []
    slots = range(plan.width)
    for kind in plan.kinds:
        sums = [
            F.expr(f"{measure.format(n=f'n{i}')} AS {name}{i}")
            for i in slots
            for name, measure in measures.items()
        ]
        ledger = key_ledger(plan, kind) if ledgers is None else ledgers[kind]
        totals = ledger.groupBy("parent").agg(*sums)
        rows = [
            f"struct({i} AS slot, {', '.join(f'{name}{i} AS {name}' for name in measures)})"
            for i in slots
        ]
        frames.append(totals.selectExpr("parent", f"inline(array({', '.join(rows)}))"))
    return reduce(DataFrame.union, frames) if frames else None


def _joined_to_edges(
    spark: SparkSession, plan: Plan, measures: dict[str, str], ledgers: Ledgers | None = None
) -> DataFrame:
    """One row per declared reference, measures 0 where no row was seen and
    null where a table is missing; both sides are bounded by the catalog."""
    edges = plan.edges_frame(spark)
    per_edge = _per_edge(plan, measures, ledgers)
    if per_edge is None:
        nothing = [f"CAST(NULL AS bigint) AS {name}" for name in measures]
        return edges.selectExpr(*EDGE_COLUMNS, "_readable", "_nullable", *nothing)
    on = (F.col("_parent") == F.col("parent")) & (F.col("_slot") == F.col("slot"))
    known = [f"if(_readable, coalesce({name}, 0L), NULL) AS {name}" for name in measures]
    return edges.join(F.broadcast(per_edge), on, "left").selectExpr(
        *EDGE_COLUMNS, "_readable", "_nullable", *known
    )


def percentage(part: str, whole: str) -> str:
    """Share in percent, two decimals; 0 of nothing."""
    return f"round(if({whole} > 0, {part} * 100.0D / {whole}, 0.0D), 2)"


def fk_validate_all(
    spark: SparkSession,
    edges: Iterable[ForeignKey],
    tables: Tables,
    *,
    null_policy: str = "orphan",
) -> DataFrame:
    """Total, valid and orphaned rows of every reference.

    A null key is an orphan, counted apart in ``nulls``; with
    ``null_policy="ignore"``, and for nullable references always, it is neither
    total, valid nor orphan, as in SQL.
    A reference whose child or parent is missing is SKIPPED, with null counts.
    """
    return validated(spark, Plan(edges, tables), null_policy)


def validated(
    spark: SparkSession, plan: Plan, null_policy: str = "orphan", ledgers: Ledgers | None = None
) -> DataFrame:
    """`fk_validate_all` over the plan's tables, or over ledgers kept of them."""
    if null_policy not in ("orphan", "ignore"):
        raise ValueError(f"null policy {null_policy!r} is neither 'orphan' nor 'ignore'")
    measures = {
        "total": "sum({n})",
        "valid": "sum(if(present, {n}, 0))",
        "nulls": "sum(if(key IS NULL, {n}, 0))",
    }
    ignored = "nulls" if null_policy == "ignore" else "if(_nullable, nulls, 0L)"
    counted = _joined_to_edges(spark, plan, measures, ledgers)
    counted = counted.withColumn("total", F.expr(f"total - {ignored}"))
    return counted.selectExpr(
        *EDGE_COLUMNS,
        "total",
        "valid",
        "total - valid AS orphaned",
        "nulls",
        f"if(_readable, {percentage('valid', 'total')}, NULL) AS valid_pct",
        "CASE WHEN NOT _readable THEN 'SKIPPED' WHEN total = valid THEN 'OK' ELSE 'FAIL' END "
        "AS status",
    )


def _session(tables: Tables) -> SparkSession:
    given = [t for t in tables.values() if t is not None]
    return given[0].sparkSession if given else SparkSession.active()


def fk_valid_count(edge: ForeignKey, tables: Tables) -> DataFrame:
    """Total, valid, orphaned and percentage of one reference; nulls where a
    table is missing."""
    checked = fk_validate_all(_session(tables), [edge], tables)
    return checked.select("total", "valid", "orphaned", "valid_pct")


def fk_issues(checked: DataFrame) -> DataFrame:
    """References with orphans."""
    return checked.where("orphaned > 0").select(*EDGE_COLUMNS, "orphaned")


def fk_summary(checked: DataFrame) -> DataFrame:
    """Rows scanned, valid and orphaned over all references; a reference that
    was skipped leaves nothing valid."""
    return checked.selectExpr(
        f"{total_of('total')} AS scanned",
        f"{total_of('valid')} AS valid",
        f"{total_of('orphaned')} AS orphaned",
        f"{total_of('orphaned')} = 0 AND count_if(status = 'SKIPPED') = 0 AS is_valid",
    )


def fk_final_status(checked: DataFrame) -> DataFrame:
    """Fully valid references of all declared ones, and the orphans left.

    A skipped reference counts as declared and not valid, and adds no orphans.
    """
    return checked.selectExpr(
        "count_if(orphaned = 0) AS valid_fks",
        "count(*) AS total_fks",
        f"{total_of('orphaned')} AS orphaned",
    )


def fk_fan_in(spark: SparkSession, edges: Iterable[ForeignKey], tables: Tables) -> DataFrame:
    """Per reference: parent keys, how many are referenced, children per key."""
    plan = Plan(edges, tables)

    measures = {
        "parents": "count_if(present)",
        "referenced": "count_if(present AND {n} > 0)",
        "min_children": "min(if(present, {n}, NULL))",
        "max_children": "max(if(present, {n}, NULL))",
        "children": "sum(if(present, {n}, 0))",
    }
    return _joined_to_edges(spark, plan, measures).selectExpr(
        *EDGE_COLUMNS,
        "parents",
        "referenced",
        "parents - referenced AS never_referenced",
        "min_children",
        "max_children",
        "round(if(parents > 0, children / parents, NULL), 4) AS avg_children",
    )


def orphan_keys(edges: Iterable[ForeignKey], tables: Tables) -> dict[ForeignKey, DataFrame]:
    """Per reference, the distinct non-null child keys that no parent has.

    One ledger over key columns finds them for all references at once; they are
    written, so their true size decides how rows are joined to them.  Keys are in
    comparable form, as ``KEY``, with their row counts.
    """
    plan = Plan(edges, tables)
    found = {}
    for kind in plan.kinds:
        orphans = materialized(key_ledger(plan, kind).where("NOT present AND key IS NOT NULL"))
        for edge, slot in plan.slots.items():
            if plan.forms[edge].kind != kind:
                continue
            own = orphans.where(f"parent = {plan.parent_number(edge)} AND n{slot} > 0")
            found[edge] = own.selectExpr(f"key AS {KEY}", f"n{slot} AS orphaned")
    return found


def fk_orphan_rows(
    edge: ForeignKey, tables: Tables, *, broadcast_limit: int = BROADCAST_BYTES
) -> DataFrame | None:
    """Whole child rows that violate the reference, null keys included unless
    it is nullable; None where a table is missing, as nothing can be said.

    With a small parent one map-side anti join does.  With a large one, whole
    child rows are not shuffled to meet it: the orphaned keys are found first,
    and the child is joined to those, map-side where they fit (`joined_to_orphans`).
    """
    child, parent = tables.get(edge.child), tables.get(edge.parent)
    if child is None or parent is None:
        return None
    form = key_comparison(edge, tables)
    if key_bytes(parent, edge.parent_column) <= broadcast_limit:
        keys = parent.selectExpr(f"{form.parent} AS {KEY}")
        found = joined_by_key(child, form.child, F.broadcast(keys), "left_anti")
        return found.where(F.col(edge.column).isNotNull()) if edge.nullable else found
    keys = orphan_keys([edge], tables)[edge]
    with BroadcastBudget().account() as account:
        unmatched = joined_to_orphans(child, form, keys, "left_semi", account)
    if edge.nullable:
        return unmatched
    return child.where(F.col(edge.column).isNull()).unionByName(unmatched)


def joined_by_key(child: DataFrame, form: str, keys: DataFrame, how: str) -> DataFrame:
    """Child rows semi or anti joined to keys in comparable form."""
    return child.join(keys.select(KEY), F.expr(form) == F.col(KEY), how).select(*child.columns)


def joined_to_orphans(
    child: DataFrame, form: Comparison, orphans: DataFrame, how: str, account: Account
) -> DataFrame:
    """Child rows semi or anti joined to orphaned keys, however many, without a
    shuffle of the rows: whole numbers become bits, 512 keys that follow each
    other in one row, and are sent to every executor if the account grants their
    measured size.  Keys of other types, or too many, are joined as keys, and all
    are in a session that broadcasts nothing."""
    nothing = child.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")
    if form.kind in WHOLE_KINDS and not nothing:
        bits = materialized(key_bits(orphans))
        if account.grants(bits.count() * ROW_BYTES):
            key = f"CAST({form.child} AS bigint)"
            words = " ".join(f"WHEN {i} THEN {BITS}{i}" for i in range(WORDS))
            held = F.expr(
                f"shiftright({key}, 9) = {ROW} AND "
                f"bit_get(CASE shiftright({key}, 6) & {WORDS - 1} {words} END, CAST({key} & 63 AS int)) = 1"
            )
            return child.join(F.broadcast(bits), held, how).select(*child.columns)
    return joined_by_key(child, form.child, orphans, how)


def key_bits(keys: DataFrame) -> DataFrame:
    """Whole keys as bits; they move as keys, so that a row is put together once."""
    words = [
        F.expr(
            f"bit_or(shiftleft(1L, CAST({KEY} & 63 AS int))) "
            f"FILTER (WHERE shiftright({KEY}, 6) & {WORDS - 1} = {i}) AS {BITS}{i}"
        )
        for i in range(WORDS)
    ]
    whole = keys.selectExpr(f"CAST({KEY} AS bigint) AS {KEY}")
    return whole.withColumn(ROW, F.shiftright(KEY, 9)).repartition(ROW).groupBy(ROW).agg(*words)


def fk_orphan_count(edge: ForeignKey, tables: Tables) -> DataFrame:
    """How many child rows violate the reference, null keys included."""
    return fk_valid_count(edge, tables).select(F.col("orphaned").alias("orphaned_records"))


def fk_self_check(edge: ForeignKey, tables: Tables) -> DataFrame:
    """A table referring to itself: null keys are roots, not orphans."""
    checked = fk_validate_all(_session(tables), [edge], tables, null_policy="ignore")
    return checked.selectExpr("total + nulls AS total", "nulls", "valid", "orphaned")


def duplicate_keys(table: DataFrame, *key: str) -> DataFrame:
    """Key values held by several rows, and null keys, with their row counts."""
    missing = " OR ".join(f"`{k}` IS NULL" for k in key)
    counted = table.groupBy(*key).agg(F.expr("count(*) AS rows"))
    return counted.where(f"rows > 1 OR {missing}")


def distinct_keys(table: DataFrame, *key: str) -> DataFrame:
    return table.select(*key).distinct()


def null_counts(table: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Null rows per column: one scan, one row of counters per task."""
    columns = list(columns or table.columns)
    counts = table.selectExpr(*[f"count_if(`{c}` IS NULL) AS `{c}`" for c in columns])
    return counts.unpivot([], columns, "column_name", "null_rows")
