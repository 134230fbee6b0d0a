"""Folders of intermediate tables, and what broadcasts may take together."""

import uuid
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from pathlib import Path

import pytest

import tablewright as tw
from tablewright import Catalog
from tablewright.catalog import ForeignKey, nullable_ref, pk, ref, string, table
from tablewright.operators.cleanup import fk_clean_cascade, fk_clean_table
from tablewright.operators.sizing import FIXED_KEY_BYTES, BroadcastBudget
from tablewright.sources import workspace
from tablewright.sources.workspace import materialized, scratch


@pytest.fixture
def base(tmp_path, monkeypatch):
    """The folder that intermediate tables go to."""
    folder = tmp_path / "shared"
    folder.mkdir()
    monkeypatch.setattr(workspace, "workspace", lambda spark: f"file://{folder}/{uuid.uuid4().hex}")
    return folder


def names(folder: Path) -> list[str]:
    return sorted(p.name for p in folder.iterdir())


def test_folders_go_with_their_scope(spark, base):
    kept = materialized(spark.range(3))
    (own,) = names(base)
    with scratch(spark):
        outer = materialized(spark.range(5))
        with scratch(spark):
            materialized(spark.range(7))
            assert len(names(base)) == 3
        assert len(names(base)) == 2 and outer.count() == 5
        with ThreadPoolExecutor(2) as jobs:
            jobs.submit(copy_context().run, materialized, spark.range(2)).result()
        assert len(names(base)) == 3
    assert names(base) == [own] and kept.count() == 3


def test_folders_go_after_a_failure_and_named_ones_stay(spark, base, tmp_path):
    with pytest.raises(ZeroDivisionError), scratch(spark):
        materialized(spark.range(5))
        materialized(spark.range(5), str(tmp_path / "named"))
        raise ZeroDivisionError
    assert names(base) == [] and spark.read.parquet(str(tmp_path / "named")).count() == 5


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "yarn", "spark://host:1", "localhost"])
def test_only_a_session_on_one_machine_may_do_without_a_shared_folder(master):
    class Conf:
        def get(self, name, default=None):
            return master if name == "spark.master" else None

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        workspace.workspace(Session())
    master = "local[4]"
    assert workspace.workspace(Session())


CATALOG = Catalog.of(
    "shop",
    table("a", 0, pk("a_id"), string("text")),
    table("b", 0, ref("a", "a.a_id"), pk("b_id"), nullable_ref("up", "b.b_id", 0.0)),
    table("c", 0, ref("b", "b.b_id"), ref("a", "a.a_id"), pk("c_id")),
    output_format="parquet",
)


def shop(spark):
    return {
        "a": spark.range(50).selectExpr("id AS a_id", "'x' AS text"),
        "b": spark.range(200).selectExpr("id % 60 AS a", "id AS b_id", "if(id > 9, id - 9, NULL) AS up"),
        "c": spark.range(900).selectExpr("id % 230 AS b", "id % 55 AS a", "id AS c_id"),
    }


def test_cleaning_leaves_only_its_target(spark, base, tmp_path):
    """Every table is there, and nothing that was written on the way."""
    tw.generate(spark, CATALOG, str(tmp_path / "data"))
    for name, frame in shop(spark).items():
        frame.write.mode("overwrite").parquet(str(tmp_path / "data" / name))
    for limit in (0, 1 << 20):
        folder = tmp_path / f"out{limit}"
        cleaned = fk_clean_cascade(CATALOG, shop(spark), folder=str(folder), broadcast_limit=limit)
        assert cleaned.rewritten == ("b", "c") and names(folder) == ["b", "c"]
    cleaned = tw.clean(spark, CATALOG, str(tmp_path / "data"), str(tmp_path / "target"))
    assert names(tmp_path / "target") == ["a", "b", "c"] and names(base) == []
    assert cleaned.tables["c"].count() > 0
    assert names(tmp_path) == ["data", "out0", "out1048576", "shared", "target"]


def test_references_share_one_budget(spark):
    """One parent is broadcast, the other one's keys beside it are not, and the rows
    are those that either way gives."""
    tables = {
        "c": spark.range(0, 3000, 1, 3).selectExpr("id % 130 AS x", "id % 1100 AS y", "id AS k"),
        "p": spark.range(100).withColumnRenamed("id", "pid"),
        "q": spark.range(1000).withColumnRenamed("id", "qid"),
    }
    edges = [ForeignKey("c", "y", "q", "qid"), ForeignKey("c", "x", "p", "pid")]
    want = sorted(k for k in range(3000) if k % 130 < 100 and k % 1100 < 1000)
    for limit, kinds in {0: "LeftAnti", 500: "both", 1099: "both", 1100: "LeftSemi"}.items():
        kept = fk_clean_table(tables["c"], edges, tables, broadcast_limit=limit * FIXED_KEY_BYTES)
        assert sorted(r.k for r in kept.select("k").collect()) == want
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        found = {k for k in ("LeftAnti", "LeftSemi") if k in plan}
        assert found == ({"LeftAnti", "LeftSemi"} if kinds == "both" else {kinds})


def test_budget_is_shared_and_given_back():
    budget = BroadcastBudget(100)
    with budget.account() as one, budget.account() as two:
        assert one.grants(60) and not two.grants(41) and two.grants(40) and not one.grants(1)
    with pytest.raises(ZeroDivisionError), budget.account() as three:
        assert three.grants(100)
        raise ZeroDivisionError
    assert budget.granted == 0
