import pytest
from pyspark.sql import functions as F

from tablewright.catalog import Catalog, decimal, email, enum, integer, phone, pk, string, table, timestamp
from tablewright.catalogs import SHOP
from tablewright.functions.types import cast_failures, sql_type, typed_projection
from tablewright.operators.profile import column_profile, table_stats
from tablewright.operators.rows import generated_dataset
from tablewright.plans.dataset import write_dataset
from tablewright.sources.sinks import write_table
from tablewright.sources.tables import broken_lines, read_csv_text, read_dataset, read_table
from tablewright.sources.workspace import workspace

ONE = Catalog.of(
    "one",
    table(
        "T", 500, pk("id"), string("name"), phone("phone"), decimal("price", 0, 9),
        timestamp("at", 10), integer("n", 0, 9),
    ),
    table("Gone", 1, pk("id")),
)


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json"])
def test_round_trip_keeps_rows_and_types(spark, tmp_path, fmt):
    written = generated_dataset(spark, ONE)["T"]
    assert write_dataset({"T": written}, str(tmp_path), fmt) == {"T": 500}
    tables = read_dataset(spark, str(tmp_path), ONE, fmt)
    assert tables["Gone"] is None
    assert tables["T"].dtypes == written.dtypes
    assert tables["T"].exceptAll(written).isEmpty() and tables["T"].count() == 500


def test_every_partition_writes_a_file(spark, tmp_path):
    frame = spark.range(0, 100, 1, 4)
    assert write_table(frame, str(tmp_path / "t"), "parquet") == 100
    assert len(list((tmp_path / "t").glob("part-*"))) == 4
    assert write_table(frame, str(tmp_path / "t"), "parquet", max_records_per_file=10) == 100
    assert len(list((tmp_path / "t").glob("part-*"))) > 4


def test_csv_columns_go_by_name(spark, tmp_path):
    frame = spark.createDataFrame([("7", 1, "x")], "phone string, id bigint, extra string")
    write_table(frame, str(tmp_path / "T"), "csv")
    back = read_table(spark, str(tmp_path / "T"), "csv", ONE.tables["T"].schema)
    assert back.dtypes == [("phone", "string"), ("id", "bigint"), ("extra", "string")]
    assert tuple(back.first()) == ("7", 1, "x")


def test_unknown_format(spark, tmp_path):
    for call in (
        lambda: write_table(spark.range(1), str(tmp_path / "x"), "orc"),
        lambda: read_table(spark, str(tmp_path / "x"), "orc"),
    ):
        with pytest.raises(ValueError, match="orc"):
            call()


def test_text_scan_and_typed_projection(spark, tmp_path):
    rows = [("1", "2.50", "true", "2025-01-02 03:04:05"), ("x", None, "maybe", "soon")]
    names = ["a", "b", "c", "d"]
    frame = spark.createDataFrame(rows, names).repartition(3)
    write_table(frame, str(tmp_path / "t"), "csv")
    texts = read_csv_text(spark, str(tmp_path / "t"))
    assert {t for _, t in texts.dtypes} == {"string"} and texts.count() == 2
    kinds = {"a": "int", "b": "decimal", "c": "boolean", "d": "timestamp"}
    typed = typed_projection(texts, kinds)
    assert [t for _, t in typed.dtypes] == ["bigint", "decimal(19,2)", "boolean", "timestamp"]
    assert typed.where("a IS NULL AND b IS NULL AND c IS NULL AND d IS NULL").count() == 1
    assert dict(map(tuple, cast_failures(texts, kinds).collect())) == {"a": 1, "b": 0, "c": 1, "d": 1}


@pytest.mark.parametrize(
    "declared, expected",
    [
        ("pk", "BIGINT"), ("fk", "BIGINT"), ("int", "BIGINT"), ("LONG", "BIGINT"),
        ("decimal", "DECIMAL(19,2)"), ("float", "DOUBLE"), ("double", "DOUBLE"),
        ("boolean", "BOOLEAN"), ("timestamp", "TIMESTAMP"), ("datetime", "TIMESTAMP"),
        ("date", "DATE"), ("email", "VARCHAR(255)"), ("phone", "VARCHAR(20)"),
        ("enum", "VARCHAR(100)"), ("string", "VARCHAR(255)"), ("anything", "VARCHAR(255)"),
    ],
)
def test_sql_types(declared, expected):
    assert sql_type(declared) == expected


def test_workspace_is_under_the_named_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = workspace(spark), workspace(spark)
    assert first.startswith(base) and first != second


class Settings:
    """Stands in for a session where only its settings matter."""

    def __init__(self, **values):
        self.conf = self
        self.values = {name.replace("_", "."): value for name, value in values.items()}

    def get(self, name, default=None):
        return self.values.get(name, default)


def test_workspace_without_a_named_folder():
    assert "tablewright-" in workspace(Settings(spark_master="local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace(Settings(spark_master="yarn"))


def test_stats_show_missing_and_empty_tables(spark):
    tables = {"b": spark.range(3), "a": None, "c": spark.range(0)}
    assert [tuple(r) for r in table_stats(spark, tables).collect()] == [
        ("a", None, None, "MISSING"),
        ("b", 3, 1, "OK"),
        ("c", 0, 1, "OK"),
    ]


def test_approximate_profile_agrees_on_small_tables(spark):
    frame = spark.range(200).select("id", (F.col("id") % 7).cast("string").alias("s"))
    exact = column_profile(frame)
    approx = column_profile(frame, distinct="approx")
    assert exact.columns == approx.columns
    found = {r.column_name: r for r in exact.collect()}
    assert (found["s"].distinct_values, found["id"].distinct_values) == (7, 200)
    near = {r.column_name: r.distinct_values for r in approx.collect()}
    assert near["s"] == 7 and abs(near["id"] - 200) < 20


def test_csv_returns_any_text_as_it_was(spark, tmp_path):
    texts = ["a\nb", "c\r\nd", 'say "hi"', "back\\slash", '\\"', " spaced ", "", None, "x,y", "#z", "\n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(3)
    path = str(tmp_path / "t")
    assert write_table(frame, path, "csv") == len(texts)
    back = read_table(spark, path, "csv", frame.schema)
    assert sorted(back.collect()) == sorted(frame.collect(), key=lambda r: r.id)


SMALL = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get(SMALL)
    spark.conf.set(SMALL, 4096)
    yield
    spark.conf.set(SMALL, before)


GENERATED = Catalog.of(
    "made", table("T", 3000, pk("id"), string("name"), phone("phone"), integer("n", 0, 9)),
    single_line_text=True,
)


def test_one_file_of_generated_text_is_read_by_many_tasks(spark, tmp_path, small_splits):
    frame = generated_dataset(spark, GENERATED)["T"].withColumn("name", F.expr("concat(name, ', \"x\" ', id)"))
    write_table(frame.coalesce(1), str(tmp_path / "T"), "csv")
    back = read_dataset(spark, str(tmp_path), GENERATED)["T"]
    assert back.rdd.getNumPartitions() > 5
    assert back.count() == 3000 and back.columns == frame.columns
    assert sorted(back.collect()) == sorted(frame.collect())
    whole = read_table(spark, str(tmp_path / "T"), "csv", GENERATED.tables["T"].schema)
    assert whole.rdd.getNumPartitions() == 1 and sorted(whole.collect()) == sorted(frame.collect())
    texts = read_csv_text(spark, str(tmp_path / "T"), single_line=True)
    assert texts.rdd.getNumPartitions() > 5 and texts.count() == 3000
    assert broken_lines(spark, str(tmp_path / "T")) == 0


@pytest.mark.parametrize("column", ["a", "b"])
@pytest.mark.parametrize("text", ["x\ny", "x\r\ny", "\n", "1\n\n\n2", 'say "x"\n"y"'])
def test_a_broken_promise_fails(spark, tmp_path, column, text):
    rows = [(n, "plain", "text, too") for n in range(50)]
    frame = spark.createDataFrame(rows, "id bigint, a string, b string")
    frame = frame.withColumn(column, F.when(F.col("id") == 30, F.lit(text)).otherwise(F.col(column)))
    write_table(frame.coalesce(1), str(tmp_path / "t"), "csv")
    broken = read_table(spark, str(tmp_path / "t"), "csv", frame.schema, single_line=["a", "b"])
    for job in (broken.count, broken.collect, broken.select("id").distinct().count):
        with pytest.raises(Exception, match="promised to be on a single line"):
            job()
    assert broken_lines(spark, str(tmp_path / "t")) >= 2
    for kept in ((), ["a"], ["b"]):
        back = read_table(spark, str(tmp_path / "t"), "csv", frame.schema, single_line=kept)
        assert sorted(back.collect()) == sorted(frame.collect())


def test_numbers_that_are_none_break_no_promise(spark, tmp_path):
    frame = spark.createDataFrame([("1", "x"), ("none", "y"), ("3", None)], "n string, t string")
    write_table(frame.coalesce(1), str(tmp_path / "t"), "csv")
    schema = "n bigint, t string"
    schema = spark.createDataFrame([], schema).schema
    back = read_table(spark, str(tmp_path / "t"), "csv", schema, single_line=["t"])
    assert sorted(back.collect(), key=repr) == sorted([(1, "x"), (None, "y"), (3, None)], key=repr)


def test_promises_of_a_catalog():
    catalog = Catalog.of(
        "p", table("T", 1, pk("id"), string("free"), string("line", single_line=True), phone("phone"), enum("e", "a\nb")),
        table("U", 1, pk("id"), enum("e", "a", "b"), email("mail")),
    )
    assert catalog.single_line("T") >= {"line", "phone"} and not catalog.single_line("T") & {"free", "e"}
    assert catalog.single_line("U") >= {"e", "mail"}
    assert SHOP.single_line("Users") >= {"name", "email", "phone_number"}
    declared = Catalog.from_dict(
        {"tables": {"T": {"row_count": 1, "columns": {"a": {"type": "string", "single_line": True}, "b": {"type": "string"}}}}}
    )
    assert declared.single_line("T") == {"a"}
