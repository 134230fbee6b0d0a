"""Sketched profiles against exact ones."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators.profile import column_profile
from tablewright.operators.sketches import bounded_profile, column_sketches, merged_profile


def wide(spark, rows=20_000):
    return spark.range(rows).selectExpr(
        "id", "CAST(id % 7 AS int) AS few", "if(id % 3 = 0, NULL, concat('t', id % 900)) AS text",
        "CASE WHEN id % 5 = 0 THEN double('NaN') WHEN id % 5 = 1 THEN -0.0D ELSE id / 4 END AS number",
        "CAST(NULL AS string) AS nothing", "CAST(id % 40 AS decimal(10,2)) AS money",
        "date_add(date'2024-01-01', CAST(id % 100 AS int)) AS day", "map('k', id % 11) AS entries",
        "array(id % 13) AS list", "CAST(CAST(id % 17 AS string) AS binary) AS bytes", "double('NaN') AS nan",
    )


def by_name(frame):
    return {r.column_name: r for r in frame.collect()}


def test_small_columns_are_exact_and_large_ones_bounded(spark):
    table = wide(spark)
    exact, found = by_name(column_profile(table)), by_name(bounded_profile(table, exact_below=5000))
    assert found.keys() == exact.keys()
    for name, row in found.items():
        for c in ("data_type", "row_count", "null_rows", "min_value", "max_value"):
            assert row[c] == exact[name][c], (name, c)
        assert row.estimated == (exact[name].distinct_values > 5000), name
        assert row.distinct_low <= exact[name].distinct_values <= row.distinct_high
        if not row.estimated:
            assert row.distinct_values == row.distinct_low == row.distinct_high
            assert row.distinct_values == exact[name].distinct_values
    assert {n for n, r in found.items() if r.estimated} == {"id", "number"}
    low, middle, high = found["id"].quartiles
    for q, v in ((0.25, low), (0.5, middle), (0.75, high)):
        assert abs(v / 20_000 - q) < 0.03
    assert found["few"].quartiles[1] in (2.0, 3.0, 4.0)
    assert {found[n].quartiles for n in ("text", "nothing", "day", "nan")} == {None}


def test_parts_merge_into_the_whole(spark, tmp_path):
    """Sketches of one part at a time, kept, with a part without any row of a column."""
    table = wide(spark, 9000).withColumn("part", F.when(F.col("id") < 10, F.lit("first")).otherwise((F.col("id") % 3).cast("string")))
    table = table.withColumn("few", F.when(F.col("part") != "first", F.col("few")))
    path = str(tmp_path / "kept")
    for part in ("first", "0", "1", "2"):
        column_sketches(table.where(F.col("part") == part), "part").write.mode("append").parquet(path)
    kept = spark.read.parquet(path)
    assert kept.count() == 4
    fields = [f for f in table.schema if f.name != "part"]
    got, want = by_name(merged_profile(kept, fields)), by_name(column_profile(table.drop("part")))
    for name, row in got.items():
        for c in ("row_count", "null_rows", "min_value", "max_value"):
            assert row[c] == want[name][c], (name, c)
        assert row.distinct_low <= want[name].distinct_values <= row.distinct_high, name
    some = by_name(merged_profile(kept.where("part = 'first'"), fields))
    assert some["id"].row_count == 10 and some["few"].null_rows == 10 and some["few"].quartiles is None


@pytest.mark.parametrize("limit", [0, 10])
def test_empty_table(spark, limit):
    found = by_name(bounded_profile(wide(spark).limit(0), exact_below=limit))
    assert all((r.row_count, r.null_rows, r.distinct_values, r.min_value) == (0, 0, 0, None) for r in found.values())
    assert {r.estimated for r in found.values()} == {limit == 0}


def test_exact_counts_read_small_columns_alone(spark, tmp_path):
    wide(spark).write.parquet(str(tmp_path / "t"))
    frame = bounded_profile(spark.read.parquet(str(tmp_path / "t")).select("id", "few"), exact_below=100)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "few:int" in plan and "id:bigint" not in plan
