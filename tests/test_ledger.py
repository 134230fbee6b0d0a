"""A kept ledger against validating all rows anew."""

import random

import pytest

from tablewright.catalog import ForeignKey
from tablewright.operators import ledger as ledgers
from tablewright.operators.integrity import fk_validate_all
from tablewright.operators.ledger import fk_ledger
from tablewright.sources.workspace import delete

EDGES = [
    ForeignKey("child", "p", "parent", "id"),
    ForeignKey("child", "code", "parent", "code"),
    ForeignKey("child", "up", "child", "k", nullable=True),
    ForeignKey("other", "p", "parent", "id"),
    ForeignKey("other", "gone", "nowhere", "id"),
]
SCHEMAS = {
    "child": "k bigint, p bigint, code string, up bigint",
    "parent": "id bigint, code string",
    "other": "p string, gone int",
}


def some(spark, rnd, n):
    def pick(*values):
        return rnd.choice([None, *values])

    rows = {
        "child": [(rnd.randrange(60), rnd.choice([7, 7, pick(*range(40))]), pick("a", "b", "c"), pick(*range(70))) for _ in range(n)],
        "parent": [(pick(*range(30)), pick("a", "b")) for _ in range(n // 2)],
        "other": [(pick("1", "2", "x", "007"), 1) for _ in range(n // 3)],
    }
    return {t: spark.createDataFrame(own, SCHEMAS[t]) for t, own in rows.items()}


def listed(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


@pytest.mark.parametrize("policy", ["orphan", "ignore"])
def test_appending_equals_validating_all(spark, tmp_path, policy):
    """The rows of the start are gone by the time others are added."""
    rnd = random.Random(1)
    first = some(spark, rnd, 90)
    for name, frame in first.items():
        frame.write.parquet(f"file://{tmp_path}/{name}")
    tables = {name: spark.read.parquet(f"file://{tmp_path}/{name}") for name in first} | {"nowhere": None}
    whole = dict(first)
    ledger = fk_ledger(spark, EDGES, tables, buckets=3)
    assert listed(ledger.checked(policy)) == listed(fk_validate_all(spark, EDGES, tables, null_policy=policy))
    for name in first:
        delete(spark, f"file://{tmp_path}/{name}")
    for names in (["child"], ["parent"], ["child", "parent", "other"], []):
        new = some(spark, rnd, 50)
        added = {n: new[n] for n in names}
        after = ledger.appended(added)
        ledger.drop(keep=after)
        ledger = after
        whole |= {n: whole[n].unionByName(new[n]) for n in names}
        want = fk_validate_all(spark, EDGES, whole | {"nowhere": None}, null_policy=policy)
        assert listed(ledger.checked(policy)) == listed(want)
    with pytest.raises(ValueError, match="nowhere"):
        ledger.appended({"nowhere": new["parent"]})
    ledger.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("key_ledger")]


def test_stored_keys_are_not_shuffled(spark):
    """The one exchange that meets the stored table is of the added rows' keys."""
    tables = {"child": spark.range(1000).selectExpr("id AS k", "id % 50 AS p"), "parent": spark.range(40)}
    edge = ForeignKey("child", "p", "parent", "id")
    ledger = fk_ledger(spark, [edge], tables, buckets=8)
    added = {"child": spark.range(5).selectExpr("id AS k", "id + 38 AS p")}
    (before,) = ledger.frames().values()
    merged = ledgers.merged(before, ledgers.entries(ledger.plan, "bigint", added))
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("Initial Plan")]
    stored, new = plan[plan.index("SortMergeJoin") :].split("FileScan", 1)
    assert "Exchange" not in stored and "Bucketed: true" in new
    after = ledger.appended(added)
    files = after.frames()["bigint"].inputFiles()
    assert len(files) <= 8 + 1
    assert after.checked().first().orphaned == 200 + 3
    ledger.drop()
    after.drop()
