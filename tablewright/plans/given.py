"""The given tables, and the same with faults put in.

The given tables are clean, so they have no orphans to find.  Each fault is an
expression both Spark SQL and the checking database read the same way.  All
rows stay; keys are moved out of range or emptied, and some parents are
repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.catalogs import STAR

# Columns of the given tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

FAULTS = {
    "region": {
        "r_regionkey": "CASE WHEN r_name = 'ASIA' THEN r_regionkey + 1000 ELSE r_regionkey END",
    },
    "nation": {
        "n_regionkey": "CASE WHEN n_name = 'NATION_7' THEN NULL ELSE n_regionkey END",
    },
    "customer": {
        "c_custkey": "CASE WHEN c_mktsegment = 'BUILDING' "
        "THEN c_custkey + 1000000000 ELSE c_custkey END",
        "c_nationkey": "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END",
    },
    "part": {
        "p_partkey": "CASE WHEN p_size >= 40 THEN p_partkey + 1000000000 ELSE p_partkey END",
    },
    "orders": {
        "o_orderkey": "CASE WHEN o_orderstatus = 'P' "
        "THEN o_orderkey + 1000000000 ELSE o_orderkey END",
        "o_custkey": "CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_custkey END",
    },
    "lineitem": {
        "l_suppkey": "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' "
        "THEN l_suppkey + 1000000000 ELSE l_suppkey END",
        "l_partkey": "CASE WHEN l_quantity > 45 THEN NULL ELSE l_partkey END",
    },
    "documents": {
        "doc_id": "CASE WHEN lang = 'fr' THEN doc_id + 1000000000 ELSE doc_id END",
    },
    "events": {
        "user_id": "CASE WHEN event_type = 'error' THEN NULL ELSE user_id END",
    },
}
REPEATED = {"supplier": "s_acctbal > 5000"}


def given_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table under its known schema: no job to read a footer first."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def star_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {name: given_table(spark, sf_dir, name) for name in names or STAR.tables}


def dirty_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The given tables with their faults; all of the star unless named."""
    tables = star_tables(spark, sf_dir, *names)
    for name, frame in tables.items():
        if name in FAULTS:
            frame = frame.withColumns({c: F.expr(e) for c, e in FAULTS[name].items()})
        if name in REPEATED:
            frame = frame.unionByName(frame.where(REPEATED[name]))
        tables[name] = frame
    return tables


# Free-form replies made of the customers, in the shapes such replies take:
# the asked-for object, quoted words, a numbered list, an object without the
# asked-for list, an object with an empty one, and a bare JSON list.
REPLY = """CASE
  WHEN c_mktsegment = 'AUTOMOBILE' THEN
    concat('{"names": ["', c_name, '", "Second ', c_custkey, '", "Third"]}')
  WHEN c_mktsegment = 'BUILDING' THEN
    concat('Try "', c_name, '" or else ''Spare ', c_custkey, ''' as well.')
  WHEN c_mktsegment = 'FURNITURE' THEN
    concat('Names:', chr(10), '1. Alpha ', c_custkey, chr(10), '  2.  Beta ', c_custkey,
           chr(10), 'no item')
  WHEN c_mktsegment = 'HOUSEHOLD' AND c_acctbal < 5000 THEN
    concat('{"items": ["', c_name, '"]}')
  WHEN c_mktsegment = 'HOUSEHOLD' THEN '{"names": null, "note": "none"}'
  ELSE concat('["', c_name, '", "Listed ', c_custkey, '"]')
END"""
