import gzip
from decimal import Decimal
from pathlib import Path

import pytest

from tablewright import export_sql
from tablewright.catalog import Catalog, decimal, integer, pk, ref, string, table
from tablewright.functions.sqltext import insert_statements, qualified, quoted, sql_literal
from tablewright.operators import scripts
from tablewright.plans.queries import QUERIES

KINDS = {"id": "pk", "p": "fk", "name": "string", "ok": "boolean", "price": "decimal"}


def rows(spark):
    return spark.createDataFrame(
        [(1, 17, "O'Neil", True, Decimal("2.50")), (2, None, "", None, None)],
        "id bigint, p bigint, name string, ok boolean, price decimal(19,2)",
    )


def statements(spark, **options):
    frame = insert_statements(rows(spark), "T", KINDS, **options)
    return sorted(r.stmt for r in frame.collect())


def test_statement_text(spark):
    assert statements(spark) == [
        "INSERT INTO [SalesLT].[T] ([id], [p], [name], [ok], [price]) "
        "VALUES (1, 17, 'O''Neil', 1, 2.50);",
        "INSERT INTO [SalesLT].[T] ([id], [p], [name], [ok], [price]) "
        "VALUES (2, NULL, NULL, NULL, NULL);",
    ]


def test_dialects_and_quoted_keys(spark):
    first = statements(spark, dialect="mysql", schema="shop", quote_fk=True)[0]
    assert first == (
        "INSERT INTO `shop`.`T` (`id`, `p`, `name`, `ok`, `price`) "
        "VALUES (1, '17', 'O''Neil', 1, 2.50);"
    )
    assert qualified("T", "s", "ansi") == '"s"."T"'
    assert quoted("a]b") == "[a]]b]"


@pytest.mark.parametrize(
    "value, declared, expected",
    [
        ("'Yes'", "bool", "1"), ("'0'", "boolean", "0"), ("'TRUE'", "boolean", "1"),
        ("12L", "long", "12"), ("'a''b'", "enum", "'a''b'"), ("''", "int", "NULL"),
        ("CAST(NULL AS string)", "string", "NULL"), ("DATE'2025-01-02'", "date", "'2025-01-02'"),
        ("1.5D", "double", "1.5"),
    ],
)
def test_literals(spark, value, declared, expected):
    got = spark.range(1).selectExpr(f"{sql_literal(value, declared)} AS v").first().v
    assert got == expected


def test_export_orders_parents_first_and_counts(spark, tmp_path):
    catalog = Catalog.of(
        "x",
        table("Child", 0, ref("p_id", "Parent.p_id"), pk("c_id"), decimal("price")),
        table("Parent", 0, pk("p_id"), string("name")),
        table("Absent", 0, pk("a_id")),
    )
    tables = {
        "Parent": spark.range(0, 1200, 1, 3).selectExpr("id AS p_id", "concat('n', id) AS name"),
        "Child": spark.range(2).selectExpr("id AS p_id", "id AS c_id", "id * 1.5D AS price"),
        "Absent": None,
    }
    paths = export_sql(spark, catalog, tables, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == [
        "01_Parent.sql",
        "02_Child.sql",
        "consolidated_dml.sql",
    ]
    parent = [
        line
        for part in sorted((tmp_path / "01_Parent.sql").glob("part-*"))
        for line in part.read_text().splitlines()
    ]
    assert parent[0] == "-- File Order: 1" and parent[3] == "-- Generated: 1200 rows"
    assert len(parent) == 5 + 1200
    whole = [
        line
        for folder in sorted((tmp_path / "consolidated_dml.sql").glob("load_order=*"))
        for part in sorted(folder.glob("part-*"))
        for line in part.read_text().splitlines()
    ]
    inserts = [line for line in whole if line.startswith("INSERT")]
    assert len(inserts) == 1202
    assert "[Parent]" in inserts[1199] and "[Child]" in inserts[1200]
    assert whole[-3:] == ["-- Total rows inserted: 1,202", "-- Total tables: 2", "-- Schema: SalesLT"]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_written_scripts_are_in_order_and_small_if_compressed(spark, tmp_path, monkeypatch, compression):
    monkeypatch.setattr(scripts, "FILE_LINES", 300)
    catalog = Catalog.of("one", table("item", 0, pk("item_id"), integer("size")))
    tables = {"item": spark.range(0, 1000, 1, 2).selectExpr("id AS item_id", "CAST(id % 7 AS int) AS size")}
    counts = scripts.row_counts(spark, tables)
    lines = scripts.script_lines(catalog, tables, counts)
    plain = [r.line for r in lines["item"].collect()]
    closing = scripts.closing_lines(spark, counts)
    (path,) = scripts.write_table_scripts(lines, str(tmp_path / "text"), compression=compression)
    scripts.write_combined_script(lines, closing, str(tmp_path / "all"), compression=compression)
    opened = {"none": open, "gzip": gzip.open}[compression]

    def read(folder, files):
        parts = sorted(p for p in folder.rglob("part-*") if p.is_file())
        assert len(parts) >= files
        texts = [opened(p, "rt").read() for p in parts]
        return "".join(texts).splitlines(), sum(p.stat().st_size for p in parts)

    files = {"none": 3, "gzip": 5}[compression]
    got, size = read(Path(path), files)
    assert got == plain
    assert (size < sum(map(len, plain)) / 5) == (compression == "gzip")
    got, _ = read(tmp_path / "all", files + 1)
    assert got == plain + [r.line for r in closing.collect()]


@pytest.mark.parametrize("query", ["sink_sql_text", "sink_sql_all"])
def test_queries_write_their_scripts_compressed(spark, query):
    files = QUERIES[query](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all(name.endswith(".txt.gz") for name in files)
