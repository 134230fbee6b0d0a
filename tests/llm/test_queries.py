"""The registered queries against their SQL, and the pipeline from end to end."""

import os

import duckdb
import pytest

import corpus_pipeline
from tablewright.llm import decontamination, nearduplicates, quality, secrets
from tablewright.llm.columns import given
from tablewright.llm.oracles import ORACLES
from tablewright.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    frame = QUERIES[name](spark, SF_DIR)
    result = connection.sql(ORACLES[name])
    assert sorted(result.columns) == sorted(frame.columns)
    columns = ", ".join(f'"{c}"' for c in frame.columns)
    want = connection.sql(f"SELECT {columns} FROM result").fetchall()
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, want))


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    """Each stage, on what the one before kept, does what its operator found."""
    small = "/root/testdata/sf0.001"
    docs = given(spark, small, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "secrets", "encoding"]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], small).cache())
    raw, good, single, clean, masked, coded = frames
    assert all(f.columns == docs.columns for f in (good, single, clean, masked))

    def ids(frame):
        return {r.doc_id for r in frame.select("doc_id").collect()}

    kept = {r.doc_id for r in quality.quality_verdicts(raw).where("kept").collect()}
    assert ids(good) == kept and len(kept) < raw.count()
    classes = nearduplicates.near_duplicates(good).collect()
    assert ids(single) == {r.component_id for r in classes}
    found = decontamination.leaks(single, given(spark, small, "benchmark")).collect()
    assert ids(clean) == ids(single) - {r.doc_id for r in found}
    assert ids(masked) == ids(clean) == ids(coded)
    assert not secrets.secrets(masked).where("exists(spans, s -> s.kind <> 'markov')").count()
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert all(r.decoded == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in coded.collect())
    assert corpus_pipeline.run(spark, small).count() == coded.count()
