"""Value pools: fallback values, supplied values, and drawing from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.draws import draw
from tablewright.functions.literals import literal_frame
from tablewright.operators.sampling import dense_index
from tablewright.operators.sizing import BROADCAST_BYTES, key_bytes, partitions_for
from tablewright.sources.workspace import materialized

POOL_SCHEMA = "pool string, grp string, size bigint, template string"

# Names of the named part of the user pool.
USER_NAMES = (
    "Mara Lindqvist", "Tomas Okafor", "Yuki Arden", "Selma Brandt", "Ivo Castellan",
    "Noor Haddad", "Pavel Dorn", "Lucia Ferrand", "Emeka Stone", "Hanna Weiss",
    "Mateo Quill", "Aino Saarinen", "Joris Vance", "Farah Demir", "Callum Reyes",
    "Ines Moreau", "Stellan Ho", "Beatriz Nolan", "Kofi Armand", "Greta Solis",
)
# Groups, fallback patterns and sizes; {i} is the position and
# {group} the group.
CATEGORIES = (
    "Electronics", "Fashion", "Home", "Sports", "Books",
    "Food", "Health", "Toys", "Beauty", "Garden",
)
CITIES = ("Bangalore", "Mumbai", "Delhi", "Hyderabad", "Chennai")
USER_TEMPLATE = "User_{i}"
TEMPLATES = {
    "product_names": "{group}_Product_{i}",
    "brands": "Brand_{i}",
    "descriptions": "A {group} article made to last, batch {i}",
    "addresses": "House {i}, Old Market Road, {group}",
    "warehouse_names": "Warehouse_{group}_{i}",
    "delivery_partner_names": "Delivery_Partner_{i}",
}
POOL_SIZES = {
    "user_names": 500,
    "product_names": 100,
    "brands": 50,
    "descriptions": 50,
    "addresses": 200,
    "warehouse_names": 5,
    "delivery_partner_names": 200,
}
CATEGORY_POOLS = ("product_names", "brands", "descriptions")
CITY_POOLS = ("addresses", "warehouse_names")

# How items stand in a reply that is no object.
QUOTED_ITEM = r"""["']([^"']+)["']"""
NUMBERED_ITEM = r"(?mdU)^\s*\d+\.\s*(.+)$"

CHUNK = 100_000
# Shares that the rows of one task are made of; a larger group is cut into shares.
SHARES = 32


def fallback_groups(spark: SparkSession) -> DataFrame:
    """One row per fallback pool and group: its size and pattern."""
    rows = [("user_names", "", POOL_SIZES["user_names"], USER_TEMPLATE)]
    for pools, groups in ((CATEGORY_POOLS, CATEGORIES), (CITY_POOLS, CITIES)):
        rows += [(p, g, POOL_SIZES[p], TEMPLATES[p]) for p in pools for g in groups]
    last = "delivery_partner_names"
    rows.append((last, "", POOL_SIZES[last], TEMPLATES[last]))
    return literal_frame(spark, POOL_SCHEMA, rows)


def pool_rows(groups: DataFrame) -> DataFrame:
    """Expand (pool, grp, size, template) to one row per value: (pool, grp, idx, value).

    A group is first cut into chunks, which are spread over as many tasks as
    the values deserve, so a group holding most values is not expanded by one.
    """
    spark = groups.sparkSession
    values = groups.selectExpr("coalesce(sum(size), 0)").first()[0]
    chunks = groups.where("size > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(CHUNK))).alias("_from")
    )
    last = F.least(F.col("_from") + F.lit(CHUNK), F.col("size")) - 1
    spread = chunks.repartition(partitions_for(spark, values), "pool", "grp", "_from")
    positions = spread.select(
        "pool", "grp", "template", F.explode(F.sequence("_from", last)).alias("idx")
    )
    return positions.select("pool", "grp", "idx", pool_value().alias("value"))


def pool_value() -> Column:
    """Value at ``idx``: named users first, the rest counted from 0 by pattern."""
    named = F.array(*[F.lit(n) for n in USER_NAMES])
    users = F.col("pool") == "user_names"
    number = F.when(users, F.col("idx") - len(USER_NAMES)).otherwise(F.col("idx"))
    text = F.replace(F.col("template"), F.lit("{i}"), number.cast("string"))
    text = F.replace(text, F.lit("{group}"), F.col("grp"))
    is_named = users & (F.col("idx") < len(USER_NAMES))
    return F.when(is_named, F.get(named, F.col("idx").cast("int"))).otherwise(text)


def selected_pools(supplied: DataFrame, groups: DataFrame) -> DataFrame:
    """Supplied values (pool, grp, idx, value) where a group has any, else fallback.

    The choice is made on the group rows, before they are expanded.
    """
    present = supplied.select("pool", "grp").distinct()
    missing = groups.join(present, ["pool", "grp"], "left_anti")
    return supplied.select("pool", "grp", "idx", "value").unionByName(pool_rows(missing))


@dataclass(frozen=True)
class PoolSet:
    """Pool values by global position, and where each group starts and ends."""

    values: DataFrame  # idx, pool, grp, value
    directory: DataFrame  # pool, grp, first, size


def indexed_pools(values: DataFrame) -> PoolSet:
    """Give (pool, grp, value) rows global positions, contiguous per group.

    Sorting by group and value over all tasks numbers a group of any size
    without gathering it; its first position and size are plain aggregates.
    """
    values = materialized(values.select("pool", "grp", "value"))
    index = materialized(dense_index(values, "pool", "grp", "value"))
    directory = index.groupBy("pool", "grp").agg(
        F.min("idx").alias("first"), F.count(F.lit(1)).alias("size")
    )
    return PoolSet(index, materialized(directory))


def numbered_values(pools: PoolSet) -> DataFrame:
    """(pool, grp, idx, value) with ``idx`` counted from 0 inside each group."""
    starts = pools.directory.select("pool", "grp", "first")
    return _met(pools.values, "idx", starts, ["pool", "grp"]).select(
        "pool", "grp", (F.col("idx") - F.col("first")).alias("idx"), "value"
    )


def _met(rows: DataFrame, row_id: str, groups: DataFrame, on: list[str]) -> DataFrame:
    """Rows with their group's one row, or nulls: broadcast where the groups
    measurably fit every executor, else by a join in which no group is more than
    a small share of a task.

    Rows are counted by group first.  A group, or the rows without one, of more
    than a share is cut into as many parts as it has shares, by the rows' ids, and
    only its row is copied for them; there are never more such groups than
    ``SHARES`` times the tasks, so they go by broadcast.
    """
    if key_bytes(groups, on[-1]) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), on, "left")
    sizes = materialized(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")))
    total = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, total // (SHARES * tasks))
    parts = F.ceil(F.col("_rows") / share).cast("int").alias("_parts")
    heavy = F.broadcast(
        sizes.where(F.col("_rows") > share).select(*(F.col(c).alias(f"_of_{c}") for c in on), parts)
    )
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on))
    own = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(row_id), F.col("_parts")))
    dealt = rows.join(heavy, same, "left").withColumn("_part", F.coalesce(own, F.lit(0)).cast("int"))
    copies = groups.join(heavy, same, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    )
    extra = ["_parts", *(f"_of_{c}" for c in on)]
    return dealt.drop(*extra).join(copies.drop(*extra), [*on, "_part"], "left").drop("_part")


def drawn_from_group(
    rows: DataFrame, row_id: str, group: str, pool: str, pools: PoolSet, alias: str, *, seed, tag
) -> DataFrame:
    """A value of the row's own group of ``pool`` per row; null without such a group.

    The value join has one key per value; both sides' sizes are known from
    written tables, and a value most rows draw is split by the skew join.  Rows
    without a value are spread by their ids.
    """
    groups = pools.directory.where(F.col("pool") == pool).select(
        F.col("grp").alias(group), "first", "size"
    )
    placed = _met(rows, row_id, groups, [group])
    position = F.expr(f"first + {draw(seed, tag, row_id, 'size')}")
    # No value has a place below 0.
    nowhere = -1 - F.pmod(F.xxhash64(row_id), F.lit(1 << 30))
    slots = placed.withColumn("_slot", F.coalesce(position, nowhere)).drop("first", "size")
    return slots.join(_slots(pools, alias), "_slot", "left").drop("_slot")


def drawn_from_pool(
    rows: DataFrame, row_id: str, pool: str, pools: PoolSet, alias: str, *, seed, tag
) -> DataFrame:
    """A value of an ungrouped pool per row; draws are uniform over its positions."""
    entry = pools.directory.where((F.col("pool") == pool) & (F.col("grp") == "")).first()
    if entry is None:
        return rows.withColumn(alias, F.lit(None).cast("string"))
    position = F.expr(f"{entry['first']}L + {draw(seed, tag, row_id, entry['size'])}")
    slots = rows.withColumn("_slot", position)
    return slots.join(_slots(pools, alias), "_slot", "left").drop("_slot")


def _slots(pools: PoolSet, alias: str) -> DataFrame:
    return pools.values.select(F.col("idx").alias("_slot"), F.col("value").alias(alias))


def with_pool_values(
    ids: DataFrame, table: str, pooled: dict[str, tuple[str, str | None]], pools: PoolSet, seed: int
) -> DataFrame:
    """Add ``pool_<column>`` for every column that draws from a pool: from the whole
    of it, or from the group that another column of ``ids`` names."""
    for column, (pool, group) in pooled.items():
        tag, alias = f"{table}.{column}", f"pool_{column}"
        own = pools.directory.where(F.col("pool") == pool)
        if own.where(F.lit(True) if group else F.col("grp") == "").isEmpty():
            raise ValueError(f"{tag}: no {'' if group else 'ungrouped '}pool {pool!r}")
        if group:
            ids = drawn_from_group(ids, "id", group, pool, pools, alias, seed=seed, tag=tag)
        else:
            ids = drawn_from_pool(ids, "id", pool, pools, alias, seed=seed, tag=tag)
    return ids


def items_from_text(
    responses: DataFrame, key: str, count: int, *, text: str = "response"
) -> DataFrame:
    """List items out of free-form replies: one row (pos, item) per item.

    A reply that parses as a JSON object gives the list under ``key`` (nothing
    when the key is absent).  Any other reply, and an object whose value there
    is no list, gives its quoted strings, or else its numbered lines.
    """
    body = F.col(text)
    parsed = F.try_parse_json(body)
    shape = F.schema_of_variant(parsed)
    found = F.try_variant_get(parsed, f"$.{key}", "variant")
    listed = F.try_variant_get(parsed, f"$.{key}", "array<string>")
    quoted = F.regexp_extract_all(body, F.lit(QUOTED_ITEM), F.lit(1))
    numbered = F.regexp_extract_all(body, F.lit(NUMBERED_ITEM), F.lit(1))
    nothing = F.array().cast("array<string>")
    is_object = F.coalesce(shape.startswith("OBJECT<"), F.lit(False))
    items = (
        F.when(is_object & found.isNull(), nothing)
        .when(is_object & listed.isNotNull(), listed)
        .when(F.size(quoted) > 0, quoted)
        .otherwise(numbered)
    )
    kept = [c for c in responses.columns if c != text]
    return responses.select(*kept, F.posexplode(F.slice(items, 1, count)).alias("pos", "item"))
