"""One registered query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright import catalog as c
from tablewright.catalog import Catalog, ForeignKey, nullable_ref, pk, table
from tablewright.catalogs import SHOP, STAR
from tablewright.functions import generators as g
from tablewright.functions.draws import chance, draw
from tablewright.functions.sqltext import insert_statements, sql_literal
from tablewright.functions.types import cast_failures, typed_projection
from tablewright.operators import cleanup, hierarchy, integrity, profile, sketches
from tablewright.operators.ledger import fk_ledger
from tablewright.operators.pools import (
    TEMPLATES,
    USER_TEMPLATE,
    drawn_from_group,
    drawn_from_pool,
    indexed_pools,
    items_from_text,
    numbered_values,
    pool_rows,
    selected_pools,
)
from tablewright.operators.rows import generated_dataset, generated_table, range_source
from tablewright.operators.sampling import dense_index, sampled_keys
from tablewright.operators.scripts import (
    closing_lines,
    row_counts,
    script_lines,
    write_combined_script,
    write_table_scripts,
)
from tablewright.plans.dataset import write_dataset
from tablewright.plans.given import REPLY, dirty_tables, given_table, star_tables
from tablewright.sources.sinks import write_table
from tablewright.sources.tables import read_csv_text, read_dataset, read_table
from tablewright.sources.workspace import materialized, workspace

Query = Callable[[SparkSession, str], DataFrame]

SEED = 42
CTX = g.Context(seed=SEED)
ENUM_VALUES = ("CARD", "UPI", "NETBANKING", "COD", "O'NEIL")
EDGES = {f"{e.child}.{e.column}": e for e in STAR.edges}


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))


def _generated(value: Callable) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _ids(spark, sf_dir).select("id", value("id").alias("value"))

    return query


def _plain(frame: DataFrame) -> DataFrame:
    """Money as double, so that results compare as numbers."""
    money = {
        f.name: F.col(f.name).cast("double")
        for f in frame.schema.fields
        if isinstance(f.dataType, T.DecimalType)
    }
    return frame.withColumns(money) if money else frame


def _declared(frame: DataFrame, name: str) -> DataFrame:
    """A given table in its declared column order and types."""
    schema = STAR.tables[name].schema
    return frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def _round_trip(name: str, fmt: str) -> Query:
    """Write a whole given table and read it back with its declared schema."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{workspace(spark)}/{name}"
        write_table(_declared(given_table(spark, sf_dir, name), name), path, fmt)
        return _plain(read_table(spark, path, fmt, STAR.tables[name].schema))

    return query


def q_scan_csv_split(spark, sf_dir):
    """One file of a table whose texts are promised to be single lines, read by tasks of
    64 kB each."""
    path = f"{workspace(spark)}/customer"
    customer = _declared(given_table(spark, sf_dir, "customer"), "customer")
    write_table(customer.coalesce(1), path, "csv")
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, 64 << 10)
    try:
        texts = {f.name for f in customer.schema if isinstance(f.dataType, T.StringType)}
        rows = read_table(spark, path, "csv", customer.schema, single_line=texts)
        return _plain(materialized(rows))
    finally:
        spark.conf.set(size, before)


# Scans and sinks


def q_range_source(spark, sf_dir):
    return range_source(spark, given_table(spark, sf_dir, "orders").count())


def q_scan_parquet(spark, sf_dir):
    return read_table(spark, f"{sf_dir}/lineitem.parquet", "parquet")


def _customer_texts(spark, sf_dir):
    """Customers written as csv, with some balances that are no numbers."""
    path = f"{workspace(spark)}/customer"
    customer = given_table(spark, sf_dir, "customer")
    spoiled = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("x")).otherwise(
        F.col("c_acctbal").cast("string")
    )
    write_table(customer.withColumn("c_acctbal", spoiled), path, "csv")
    return read_csv_text(spark, path)


def q_scan_typed(spark, sf_dir):
    return _plain(typed_projection(_customer_texts(spark, sf_dir), STAR.tables["customer"].kinds))


def q_scan_typed_failures(spark, sf_dir):
    return cast_failures(_customer_texts(spark, sf_dir), STAR.tables["customer"].kinds)


def q_sink_cleaned(spark, sf_dir):
    tables = dirty_tables(spark, sf_dir, "customer", "orders")
    edge = EDGES["orders.o_custkey"]
    kept = cleanup.fk_clean_table(tables["orders"], [edge], tables)
    path = f"{workspace(spark)}/orders"
    write_table(_declared(kept, "orders"), path, "csv")
    return _plain(read_table(spark, path, "csv", STAR.tables["orders"].schema))


def _scripts(spark, sf_dir):
    tables = star_tables(spark, sf_dir)
    counts = row_counts(spark, tables)
    return counts, script_lines(STAR, tables, counts)


def q_sink_sql_text(spark, sf_dir):
    _, scripts = _scripts(spark, sf_dir)
    paths = write_table_scripts(scripts, workspace(spark), compression="gzip")
    return spark.read.text(paths, lineSep="\n").select(F.col("value").alias("line"))


def q_sink_sql_all(spark, sf_dir):
    counts, scripts = _scripts(spark, sf_dir)
    path = workspace(spark)
    write_combined_script(scripts, closing_lines(spark, counts), path, compression="gzip")
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.col("load_order").cast("int"), F.col("value").alias("line"))


# Generators


def q_gen_nullable_fk(spark, sf_dir):
    parents = given_table(spark, sf_dir, "customer").count()
    nullable = _generated(lambda i: g.nullable_fk_value(parents, 0.7, "gen.parent", i, CTX))
    return nullable(spark, sf_dir)


def q_fk_sample_dense(spark, sf_dir):
    parents = given_table(spark, sf_dir, "customer").count()
    return _generated(lambda i: g.dense_fk_value(parents, "gen.customer", i, CTX))(spark, sf_dir)


def q_fk_sample_lookup(spark, sf_dir):
    parents = dirty_tables(spark, sf_dir, "customer")["customer"]
    ids = _ids(spark, sf_dir)
    return sampled_keys(ids, "id", parents, "c_custkey", "value", seed=SEED, tag="gen.lookup")


def q_dense_index(spark, sf_dir):
    return dense_index(dirty_tables(spark, sf_dir, "customer")["customer"].select("c_custkey"), "c_custkey")


def sample_table(rows: int) -> c.TableSpec:
    """A table with a column of every declared type."""
    return c.table(
        "Sample",
        rows,
        c.ref("customer_id", "customer.c_custkey"),
        c.pk("sample_id"),
        c.nullable_ref("parent_id", "Sample.sample_id", 0.7),
        c.string("name"),
        c.email("email"),
        c.phone("phone"),
        c.enum("method", *ENUM_VALUES),
        c.decimal("price", 0.1, 20.0),
        c.decimal("balance", -1000000, 2000000),
        c.boolean("is_active", 0.9),
        c.timestamp("created", 365),
        c.integer("quantity", 1, 5),
    )


def q_gen_table(spark, sf_dir):
    rows = given_table(spark, sf_dir, "orders").count()
    parents = given_table(spark, sf_dir, "customer").count()
    ctx = g.Context(seed=SEED, parent_rows={"customer": parents, "Sample": rows})
    return _plain(generated_table(spark, sample_table(rows), ctx))


def shop_at_scale(orders: int) -> Catalog:
    """The shop catalog sized so that it has as many orders as the given table."""
    return SHOP.scaled(orders, SHOP.tables["Orders"].rows)


def q_gen_dataset(spark, sf_dir):
    """Generate, write and read back all tables of a shop as large as the given
    one; rows, columns and orphaned references of each."""
    shop = shop_at_scale(given_table(spark, sf_dir, "orders").count())
    root = workspace(spark)
    write_dataset(generated_dataset(spark, shop), root, "parquet")
    tables = read_dataset(spark, root, shop, "parquet")
    orphans = (
        integrity.fk_validate_all(spark, shop.edges, tables)
        .groupBy(F.col("child_table").alias("table_name"))
        .agg(F.sum("orphaned").alias("orphaned"))
    )
    stats = profile.table_stats(spark, tables).drop("status")
    return stats.join(F.broadcast(orphans), "table_name", "left").fillna(0, ["orphaned"])


# Pools


def q_gen_pool_name(spark, sf_dir):
    names = given_table(spark, sf_dir, "customer").select(
        F.lit("user_names").alias("pool"), F.lit("").alias("grp"), F.col("c_name").alias("value")
    )
    pools = indexed_pools(names)
    ids = _ids(spark, sf_dir)
    return drawn_from_pool(ids, "id", "user_names", pools, "name", seed=SEED, tag="gen.name")


def _brand_values(spark, sf_dir):
    brands = given_table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    return brands.select(
        F.lit("brands").alias("pool"), F.col("p_type").alias("grp"), F.col("p_brand").alias("value")
    )


def q_gen_pool_brand(spark, sf_dir):
    parts = given_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    pools = indexed_pools(_brand_values(spark, sf_dir))
    return drawn_from_group(
        parts, "p_partkey", "p_type", "brands", pools, "brand", seed=SEED, tag="gen.brand"
    )


def _pool_groups(spark, sf_dir):
    """Pools as large as the given tables: users and addresses per customer,
    product values per part of a type."""
    customer = given_table(spark, sf_dir, "customer")
    part = given_table(spark, sf_dir, "part")
    nation = given_table(spark, sf_dir, "nation")
    users = customer.agg(F.count(F.lit(1)).alias("size")).select(
        F.lit("user_names").alias("pool"),
        F.lit("").alias("grp"),
        "size",
        F.lit(USER_TEMPLATE).alias("template"),
    )
    by_type = part.groupBy("p_type").agg(F.count(F.lit(1)).alias("size"))
    by_city = (
        customer.groupBy("c_nationkey")
        .agg(F.count(F.lit(1)).alias("size"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )

    def grouped(sizes, group, pools):
        entries = [
            F.struct(F.lit(p).alias("pool"), F.lit(TEMPLATES[p]).alias("template")) for p in pools
        ]
        return sizes.select(F.col(group).alias("grp"), "size", F.inline(F.array(*entries)))

    return users.unionByName(
        grouped(by_type, "p_type", ("product_names", "brands", "descriptions"))
    ).unionByName(grouped(by_city, "n_name", ("addresses", "warehouse_names")))


def q_pool_build(spark, sf_dir):
    return pool_rows(_pool_groups(spark, sf_dir))


def q_pool_select(spark, sf_dir):
    supplied = _brand_values(spark, sf_dir).where("grp <> 'PROMO'")
    given = numbered_values(indexed_pools(supplied))
    return selected_pools(given, _pool_groups(spark, sf_dir))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of the customers, and every conversation turn as it is."""
    made = given_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
        F.expr(REPLY).alias("response"),
    )
    turns = given_table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("t"), "conv_id", "turn").alias("id"), F.col("text").alias("response")
    )
    return made.unionByName(turns)


def q_pool_from_text(spark, sf_dir):
    return items_from_text(replies(spark, sf_dir), "names", 500)


def q_pool_from_documents(spark, sf_dir):
    documents = given_table(spark, sf_dir, "documents").select("doc_id", "text")
    return items_from_text(documents, "names", 1_000_000, text="text")


# Integrity


def _checked(spark, sf_dir):
    return integrity.fk_validate_all(spark, STAR.edges, dirty_tables(spark, sf_dir))


def _on_checked(view: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: view(_checked(spark, sf_dir))


def _on_edge(name: str, operator: Callable, **options) -> Query:
    edge = EDGES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(edge, dirty_tables(spark, sf_dir, edge.child, edge.parent), **options)

    return query


def q_fk_validate_append(spark, sf_dir):
    """A ledger of two thirds of the rows, to which the others are added."""
    tables = dirty_tables(spark, sf_dir)
    added = {name: F.pmod(F.hash(*t.columns), F.lit(3)) == 0 for name, t in tables.items()}
    ledger = fk_ledger(spark, STAR.edges, {n: t.where(~added[n]) for n, t in tables.items()}, buckets=8)
    whole = ledger.appended({n: t.where(added[n]) for n, t in tables.items()})
    checked = materialized(whole.checked())
    ledger.drop()
    whole.drop()
    return checked


def q_fk_final_status(spark, sf_dir):
    """One parent is missing altogether: its references are not valid."""
    tables = dirty_tables(spark, sf_dir) | {"documents": None}
    return integrity.fk_final_status(integrity.fk_validate_all(spark, STAR.edges, tables))


def q_fk_self(spark, sf_dir):
    """Parts under drawn parents: some without one, some with one that is not there."""
    part = given_table(spark, sf_dir, "part")
    drawn = draw(SEED, "self.parent", "p_partkey", 2 * part.count())
    missing = chance(SEED, "self.null", "p_partkey", 0.3)
    tree = part.selectExpr("p_partkey", f"if({missing}, NULL, {drawn}) AS parent_key")
    edge = ForeignKey("part", "parent_key", "part", "p_partkey")
    return hierarchy.fk_self_summary(edge, {"part": tree})


def q_fk_hierarchy(spark, sf_dir):
    """A tree of parts in which some lead around in rings of five, after some were lost."""
    tree = given_table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").selectExpr(
        "p_partkey",
        "CASE WHEN p_partkey % 50 >= 45 THEN p_partkey - p_partkey % 5 + (p_partkey + 1) % 5 "
        "WHEN p_partkey > 5 THEN p_partkey DIV 3 END AS parent_key",
    )
    edge = ForeignKey("part", "parent_key", "part", "p_partkey")
    return hierarchy.fk_hierarchy(edge, {"part": tree})


def q_pk_unique(spark, sf_dir):
    orders = given_table(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey")).alias("o_orderkey")
    repeated = orders.unionByName(orders.where("o_orderstatus = 'F'"))
    return integrity.duplicate_keys(repeated.select(key), "o_orderkey")


# Cleanup


def q_fk_filter(spark, sf_dir):
    tables = dirty_tables(spark, sf_dir, "customer", "orders")
    return cleanup.fk_filter(tables["orders"], "o_custkey", tables["customer"], "c_custkey")


def _clean_table(**options) -> Query:
    def query(spark, sf_dir):
        edges = STAR.tables["lineitem"].foreign_keys
        tables = dirty_tables(spark, sf_dir, "lineitem", *[e.parent for e in edges])
        return cleanup.fk_clean_table(tables["lineitem"], edges, tables, **options)

    return query


def _clean_cascade(**options) -> Query:
    def query(spark, sf_dir):
        cleaned = cleanup.fk_clean_cascade(STAR, dirty_tables(spark, sf_dir), **options)
        return cleaned.tables["lineitem"]

    return query


def q_fk_clean_summary(spark, sf_dir):
    return cleanup.fk_clean_cascade(STAR, dirty_tables(spark, sf_dir)).summary()


# Statistics


def _with_missing(spark, sf_dir):
    return star_tables(spark, sf_dir) | {"archive": None}


def q_table_stats(spark, sf_dir):
    return profile.table_stats(spark, _with_missing(spark, sf_dir))


def q_table_stats_total(spark, sf_dir):
    return profile.table_stats_total(q_table_stats(spark, sf_dir))


def q_column_profile(spark, sf_dir):
    return profile.column_profile(dirty_tables(spark, sf_dir, "orders")["orders"])


def q_column_profile_bounded(spark, sf_dir):
    """Orders by status, sketched part by part, merged, and counted where few; estimates
    are shown only as whether the true number is within their bounds."""
    orders = dirty_tables(spark, sf_dir, "orders")["orders"]
    limit = 5000
    profiled = sketches.bounded_profile(orders, exact_below=limit)
    parts = materialized(sketches.column_sketches(orders, "o_orderpriority"))
    fields = [f for f in orders.schema if f.name != "o_orderpriority"]
    merged = sketches.merged_profile(parts, fields).select(
        "column_name", F.col("row_count").alias("merged_rows"), F.col("null_rows").alias("merged_nulls"),
        F.col("min_value").alias("merged_min"), F.col("max_value").alias("merged_max"),
        F.col("distinct_low").alias("low"), F.col("distinct_high").alias("high"),
    )
    true = profile.column_profile(orders).select("column_name", F.col("distinct_values").alias("true"))
    within = [F.col("true").between(F.col(a), F.col(b)) for a, b in (("distinct_low", "distinct_high"), ("low", "high"))]
    return profiled.join(true, "column_name").join(merged, "column_name", "left").select(
        "column_name", "data_type", "row_count", "null_rows", "min_value", "max_value", "estimated",
        F.when(~F.col("estimated"), F.col("distinct_values")).alias("distinct_values"),
        within[0].alias("within"), within[1].alias("merged_within"),
        "merged_rows", "merged_nulls", "merged_min", "merged_max",
    )


def q_sample_rows(spark, sf_dir):
    return profile.sample_rows(given_table(spark, sf_dir, "orders"), "o_orderkey")


def q_distinct_keys(spark, sf_dir):
    return integrity.distinct_keys(given_table(spark, sf_dir, "orders"), "o_custkey")


# SQL text


def q_sql_format_value(spark, sf_dir):
    """Text with quotes, empty and missing text, money and flags."""
    rows = given_table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS key",
        "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN concat('O', chr(39), c_name) "
        "WHEN 'BUILDING' THEN '' WHEN 'MACHINERY' THEN NULL ELSE c_name END AS text",
        "CAST(if(c_acctbal > 0, c_acctbal, NULL) AS decimal(19,2)) AS money",
        "c_acctbal > 5000 AS flag",
        "if(c_acctbal > 0, 'Yes', 'no') AS word",
    )
    kinds = {"key": "pk", "text": "string", "money": "decimal", "flag": "boolean", "word": "bool"}
    return rows.selectExpr(*[f"{sql_literal(c, kind)} AS {c}_sql" for c, kind in kinds.items()])


def q_sql_insert(spark, sf_dir):
    orders = given_table(spark, sf_dir, "orders")
    return insert_statements(orders, "orders", STAR.tables["orders"].kinds)


# Keys of one value written in other types, as SQL over the parent's key.
KEY_FORMS = {
    "decimal": "CAST(c_custkey AS decimal(19,2))",
    "double": "CAST(c_custkey AS double)",
    "padded": "lpad(CAST(c_custkey AS string), 12, '0')",
}


def q_fk_mixed_keys(spark, sf_dir):
    """Whole-number keys against parents of other types: valid rows by the ledger,
    and rows kept by each way of joining."""
    tables = dirty_tables(spark, sf_dir, "orders", "customer")
    edge, orders = EDGES["orders.o_custkey"], tables["orders"]
    rows = None
    for form, key in KEY_FORMS.items():
        given = {"orders": orders, "customer": tables["customer"].selectExpr(f"{key} AS c_custkey")}
        counted = {
            "valid": integrity.fk_valid_count(edge, given).select(F.col("valid").alias("n")),
            "kept": cleanup.fk_clean_table(orders, [edge], given).select(F.lit(1).alias("n")),
            "kept_large": cleanup.fk_clean_table(
                orders, [edge], given, broadcast_limit=0
            ).select(F.lit(1).alias("n")),
        }
        for measure, frame in counted.items():
            one = frame.agg(F.sum("n").cast("bigint").alias("n")).select(
                F.lit(form).alias("form"), F.lit(measure).alias("measure"), "n"
            )
            rows = one if rows is None else rows.unionByName(one)
    return rows


def q_csv_documents(spark, sf_dir):
    """Texts with line breaks and quotes, written as csv and read again."""
    path = f"{workspace(spark)}/documents"
    docs = given_table(spark, sf_dir, "documents")
    write_table(docs, path, "csv")
    return read_table(spark, path, "csv", docs.schema)


TREE = Catalog.of(
    "tree", table("part", 0, pk("p_partkey"), nullable_ref("parent_key", "part.p_partkey", 0.0))
)


def q_fk_clean_self(spark, sf_dir):
    """A tree of parts that lost nodes: what hangs below them goes, level by level."""
    part = given_table(spark, sf_dir, "part")
    tree = part.selectExpr(
        "p_partkey", "if(p_partkey <= 5, NULL, p_partkey DIV 3) AS parent_key"
    ).where("p_partkey % 7 <> 0")
    return cleanup.fk_clean_cascade(TREE, {"part": tree}).tables["part"]


QUERIES: dict[str, Query] = {
    "range_source": q_range_source,
    "scan_csv": _round_trip("orders", "csv"),
    "scan_csv_split": q_scan_csv_split,
    "scan_parquet": q_scan_parquet,
    "scan_json": _round_trip("supplier", "json"),
    "scan_csv_strings": _customer_texts,
    "scan_typed": q_scan_typed,
    "scan_typed_failures": q_scan_typed_failures,
    "sink_csv": _round_trip("customer", "csv"),
    "sink_parquet": _round_trip("lineitem", "parquet"),
    "sink_json": _round_trip("part", "json"),
    "sink_cleaned": q_sink_cleaned,
    "sink_sql_text": q_sink_sql_text,
    "sink_sql_all": q_sink_sql_all,
    "gen_pk": _generated(g.key_value),
    "gen_string": _generated(lambda i: g.text_value("name", i)),
    "gen_email": _generated(g.email_value),
    "gen_phone": _generated(g.phone_value),
    "gen_enum": _generated(lambda i: g.enum_value(ENUM_VALUES, "gen.enum", i, CTX)),
    "gen_decimal": _generated(
        lambda i: g.decimal_value(0.1, 20000, "gen.decimal", i, CTX).cast("double")
    ),
    "gen_boolean": _generated(lambda i: g.boolean_value(0.9, "gen.boolean", i, CTX)),
    "gen_timestamp": _generated(lambda i: g.timestamp_value(1500, "gen.timestamp", i, CTX)),
    "gen_int": _generated(lambda i: g.int_value(1, 5, "gen.int", i, CTX)),
    "gen_pool_name": q_gen_pool_name,
    "gen_pool_brand": q_gen_pool_brand,
    "gen_nullable_fk": q_gen_nullable_fk,
    "gen_table": q_gen_table,
    "gen_dataset": q_gen_dataset,
    "fk_sample_dense": q_fk_sample_dense,
    "fk_sample_lookup": q_fk_sample_lookup,
    "dense_index": q_dense_index,
    "fk_valid_count": _on_edge("lineitem.l_suppkey", integrity.fk_valid_count),
    "fk_validate_all": _checked,
    "fk_validate_append": q_fk_validate_append,
    "fk_issues": _on_checked(integrity.fk_issues),
    "fk_summary": _on_checked(integrity.fk_summary),
    "fk_orphan_rows": _on_edge("orders.o_custkey", integrity.fk_orphan_rows),
    "fk_orphan_rows_by_key": _on_edge(
        "lineitem.l_orderkey", integrity.fk_orphan_rows, broadcast_limit=0
    ),
    "fk_orphan_count": _on_edge("lineitem.l_partkey", integrity.fk_orphan_count),
    "fk_final_status": q_fk_final_status,
    "fk_self": q_fk_self,
    "fk_hierarchy": q_fk_hierarchy,
    "pk_unique": q_pk_unique,
    "null_check": lambda s, d: integrity.null_counts(dirty_tables(s, d, "lineitem")["lineitem"]),
    "fk_filter": q_fk_filter,
    "fk_mixed_keys": q_fk_mixed_keys,
    "fk_clean_self": q_fk_clean_self,
    "csv_documents": q_csv_documents,
    "fk_clean_table": _clean_table(),
    "fk_clean_table_by_key": _clean_table(broadcast_limit=0),
    "fk_clean_cascade": _clean_cascade(),
    "fk_clean_cascade_by_key": _clean_cascade(broadcast_limit=0),
    "fk_clean_summary": q_fk_clean_summary,
    "table_stats": q_table_stats,
    "table_stats_total": q_table_stats_total,
    "column_profile": q_column_profile,
    "column_profile_bounded": q_column_profile_bounded,
    "sample_rows": q_sample_rows,
    "row_count": lambda s, d: profile.row_count(given_table(s, d, "lineitem")),
    "fk_report": _on_checked(profile.fk_report),
    "quality_score": _on_checked(profile.quality_score),
    "fk_fan_in": lambda s, d: integrity.fk_fan_in(s, STAR.edges, dirty_tables(s, d)),
    "level_rollup": lambda s, d: profile.level_rollup(s, STAR, star_tables(s, d)),
    "union_counts": lambda s, d: profile.union_counts(s, star_tables(s, d)),
    "total_records": lambda s, d: profile.total_records(s, star_tables(s, d)),
    "distinct_keys": q_distinct_keys,
    "sql_format_value": q_sql_format_value,
    "sql_insert": q_sql_insert,
    "pool_build": q_pool_build,
    "pool_select": q_pool_select,
    "pool_from_text": q_pool_from_text,
    "pool_from_documents": q_pool_from_documents,
}
