"""Declarations of related tables: what the operators work from.

A catalog is plain driver-side data, bounded by the number of declared
tables.  It is built from the typed helpers below or loaded from a JSON
declaration; no Spark work happens here except in the ``*_frame`` views.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablewright.functions.literals import literal_frame

OUTPUT_FORMATS = ("csv", "parquet", "json")

# Column type declared -> Spark type of the column.
SPARK_TYPES = {
    "pk": T.LongType(),
    "fk": T.LongType(),
    "string": T.StringType(),
    "email": T.StringType(),
    "phone": T.StringType(),
    "enum": T.StringType(),
    "decimal": T.DecimalType(19, 2),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "datetime": T.TimestampType(),
    "date": T.DateType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.DoubleType(),
    "double": T.DoubleType(),
}


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` must hold a value of ``parent.parent_column``; a
    ``nullable`` one may also be null."""

    child: str
    column: str
    parent: str
    parent_column: str
    nullable: bool = False


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    probability: float = 0.5
    range_days: int = 0
    null_ratio: float = 0.0
    ref_table: str | None = None
    ref_column: str | None = None
    pool: str | None = None
    pool_group: str | None = None
    single_line: bool = False

    @property
    def one_line(self) -> bool:
        """Whether its texts are promised to hold no line break, or have none by nature."""
        breaks = any("\n" in v or "\r" in v for v in self.values)
        return self.single_line or self.kind in ("email", "phone") or self.kind == "enum" and not breaks


@dataclass(frozen=True)
class TableSpec:
    name: str
    rows: int
    primary_key: str | None
    columns: tuple[ColumnSpec, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()

    @property
    def kinds(self) -> dict[str, str]:
        """Column name -> declared type, in output order: foreign keys first."""
        return {fk.column: "fk" for fk in self.foreign_keys} | {
            c.name: c.kind for c in self.columns
        }

    @property
    def schema(self) -> T.StructType:
        unknown = [k for k in self.kinds.values() if k not in SPARK_TYPES]
        if unknown:
            raise ValueError(f"{self.name}: no such column type: {unknown}")
        return T.StructType(
            [T.StructField(name, SPARK_TYPES[kind]) for name, kind in self.kinds.items()]
        )

    @property
    def nullable_keys(self) -> tuple[ForeignKey, ...]:
        """References declared as ``fk`` columns, which may be null."""
        return tuple(
            ForeignKey(self.name, c.name, c.ref_table, c.ref_column, True)
            for c in self.columns
            if c.kind == "fk" and c.ref_table
        )


@dataclass(frozen=True)
class Catalog:
    domain: str
    tables: dict[str, TableSpec]
    seed: int = 42
    output_format: str = "csv"
    #: A promise for every text column: generated text, of pools without line breaks.
    single_line_text: bool = False

    def __post_init__(self):
        if self.output_format not in OUTPUT_FORMATS:
            raise ValueError(
                f"output format {self.output_format!r} is not one of {OUTPUT_FORMATS}"
            )
        for edge in self.all_edges:
            if edge.parent not in self.tables:
                raise ValueError(f"{edge.child}.{edge.column}: no table {edge.parent!r}")

    @property
    def edges(self) -> list[ForeignKey]:
        """References every row must satisfy."""
        return [edge for table in self.tables.values() for edge in table.foreign_keys]

    @property
    def nullable_edges(self) -> list[ForeignKey]:
        """References that rows may leave null."""
        return [edge for table in self.tables.values() for edge in table.nullable_keys]

    @property
    def all_edges(self) -> list[ForeignKey]:
        return self.edges + self.nullable_edges

    def single_line(self, name: str) -> set[str]:
        """Columns of a table that are promised to hold no line break."""
        return {c.name for c in self.tables[name].columns if self.single_line_text or c.one_line}

    def components(self) -> list[list[str]]:
        """Tables that reach each other over references, as one list; every list
        after those its tables refer to."""
        parents: dict[str, list[str]] = {name: [] for name in self.tables}
        for edge in self.all_edges:
            parents[edge.child].append(edge.parent)
        reach = {name: self._reached(name, parents) for name in self.tables}
        found: dict[str, list[str]] = {}
        for name in self.tables:
            mates = [n for n in reach[name] if name in reach[n]] or [name]
            found.setdefault(min(mates), []).append(name)
        # A component reaches strictly more tables than any it refers to.
        return sorted(found.values(), key=lambda c: len(reach[c[0]] | set(c)))

    @staticmethod
    def _reached(name: str, parents: dict[str, list[str]]) -> set[str]:
        seen: set[str] = set()
        ahead = list(parents[name])
        while ahead:
            table = ahead.pop()
            if table not in seen:
                seen.add(table)
                ahead += parents[table]
        return seen

    def levels(self) -> dict[str, int]:
        """0 for tables without parents, else one more than the deepest parent.

        A reference of a table to itself adds no level.  Tables on a cycle share
        one, above 0, and the tables that refer to them come after it.
        """
        placed: dict[str, int] = {}
        for mates in self.components():
            above = [
                placed[e.parent] + 1
                for e in self.all_edges
                if e.child in mates and e.parent not in mates
            ]
            level = max(above, default=0)
            placed |= dict.fromkeys(mates, max(level, 1) if len(mates) > 1 else level)
        return placed

    def load_order(self) -> list[str]:
        """Every table after its parents; declaration order within a level."""
        level = self.levels()
        return sorted(self.tables, key=level.__getitem__)

    def scaled(self, numerator: int, denominator: int) -> Catalog:
        """The same tables with row counts times numerator/denominator, 1 at least."""
        return replace(
            self,
            tables={
                name: replace(t, rows=max(1, t.rows * numerator // denominator))
                for name, t in self.tables.items()
            },
        )

    @classmethod
    def of(cls, domain: str, *tables: TableSpec, **options) -> Catalog:
        return cls(domain, {t.name: t for t in tables}, **options)

    @classmethod
    def from_dict(cls, config: dict) -> Catalog:
        tables = {}
        for name, spec in config["tables"].items():
            pools = spec.get("_data_sources", {})
            columns = tuple(
                _column_from_dict(column, meta, pools.get(column))
                for column, meta in spec["columns"].items()
            )
            keys = tuple(
                ForeignKey(name, column, ref["ref_table"], ref["ref_column"])
                for column, ref in spec.get("foreign_keys", {}).items()
            )
            tables[name] = TableSpec(
                name, spec["row_count"], spec.get("primary_key"), columns, keys
            )
        return cls(
            config.get("domain", ""),
            tables,
            config.get("seed", 42),
            config.get("output_format", "csv").lower(),
            config.get("single_line_text", False),
        )

    @classmethod
    def from_json(cls, path: str) -> Catalog:
        return cls.from_dict(json.loads(Path(path).read_text()))

    def tables_frame(self, spark: SparkSession) -> DataFrame:
        level = self.levels()
        return literal_frame(
            spark,
            "table_name string, declared_rows bigint, primary_key string, load_level int",
            [(t.name, t.rows, t.primary_key, level[t.name]) for t in self.tables.values()],
        )

    def columns_frame(self, spark: SparkSession) -> DataFrame:
        return literal_frame(
            spark,
            "table_name string, position int, column_name string, declared_type string",
            [
                (t.name, i, name, kind)
                for t in self.tables.values()
                for i, (name, kind) in enumerate(t.kinds.items())
            ],
        )

    def keys_frame(self, spark: SparkSession) -> DataFrame:
        return literal_frame(
            spark,
            "child_table string, fk_column string, parent_table string, parent_column string",
            [
                (e.child, e.column, e.parent, e.parent_column)
                for e in self.edges + self.nullable_edges
            ],
        )


def _column_from_dict(name: str, meta: dict, source: str | dict | None) -> ColumnSpec:
    return ColumnSpec(
        name,
        meta["type"],
        values=tuple(meta.get("values", ())),
        low=meta.get("min"),
        high=meta.get("max"),
        probability=meta.get("probability", 0.5),
        range_days=int(meta.get("range_days", 0)),
        null_ratio=meta.get("null_ratio", 0.0),
        ref_table=meta.get("ref_table"),
        ref_column=meta.get("ref_column"),
        pool=source.get("pool") if isinstance(source, dict) else source,
        pool_group=source.get("group") if isinstance(source, dict) else None,
        single_line=meta.get("single_line", False),
    )


# Typed helpers to declare a catalog in Python.


def table(name: str, rows: int, *columns: ColumnSpec) -> TableSpec:
    """A table; ``pk`` names its key and each ``ref`` becomes a foreign key."""
    key = next((c.name for c in columns if c.kind == "pk"), None)
    refs = tuple(
        ForeignKey(name, c.name, c.ref_table, c.ref_column) for c in columns if c.kind == "ref"
    )
    return TableSpec(name, rows, key, tuple(c for c in columns if c.kind != "ref"), refs)


def pk(name):
    return ColumnSpec(name, "pk")


def ref(name, target):
    parent, column = target.split(".")
    return ColumnSpec(name, "ref", ref_table=parent, ref_column=column)


def nullable_ref(name, target, null_ratio):
    parent, column = target.split(".")
    return ColumnSpec(name, "fk", ref_table=parent, ref_column=column, null_ratio=null_ratio)


def string(name, pool=None, group=None, single_line=False):
    """``group``: the column that names the group of the pool to draw from;
    ``single_line``: no value holds a line break, so csv files can be split."""
    return ColumnSpec(name, "string", pool=pool, pool_group=group, single_line=single_line)


def email(name):
    return ColumnSpec(name, "email")


def phone(name):
    return ColumnSpec(name, "phone")


def enum(name, *values):
    return ColumnSpec(name, "enum", values=values)


def decimal(name, low=None, high=None):
    return ColumnSpec(name, "decimal", low=low, high=high)


def boolean(name, probability=0.5):
    return ColumnSpec(name, "boolean", probability=probability)


def timestamp(name, range_days=0):
    return ColumnSpec(name, "timestamp", range_days=range_days)


def whole(name):
    """Any whole number of 64 bits."""
    return ColumnSpec(name, "long")


def integer(name, low=0, high=1000):
    return ColumnSpec(name, "int", low=low, high=high)
