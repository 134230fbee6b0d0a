"""References within a table, or around a cycle of tables, followed to their end.

Only keys are followed, never rows: every key points to the key its row refers
to.  A self-join lets each pointer jump to where the key it points to points, so
distances double and a chain of any depth takes as many rounds as its depth has
binary digits.  Each round is written; keys that have reached an end are not
touched again.  What is left when a round brings none to an end leads into a ring.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.catalog import ForeignKey
from tablewright.operators.integrity import Tables, fk_self_check, key_comparison
from tablewright.sources.workspace import materialized

# How a chain of keys ends.  OPEN: not followed to the end yet, or for ever in a ring.
OPEN, ROOT, MISSING, RING, FORK = "open", "root", "missing", "ring", "fork"


def key_text(sql: str, kind: str) -> str:
    """A key in comparable form as text: equal keys, and only those, are alike."""
    if kind in ("double", "float"):
        return f"CAST({sql} + 0.0D AS string)"  # one zero
    if kind == "timestamp":
        return f"CAST(unix_micros({sql}) AS string)"  # not every local time is one moment
    return f"hex({sql})" if kind == "binary" else f"CAST({sql} AS string)"


def unions(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def followed(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains to their ends.  ``links`` has ``node, up, state, steps, last``: one row a
    node; rows that are OPEN point to another node of the table, ``steps`` away, all
    others have ended at ``last``.  Returns the ended ones, and those still OPEN."""
    start = materialized(links)
    open_, ended = start.where(F.col("state") == OPEN), [start.where(F.col("state") != OPEN)]
    ahead, done = not open_.isEmpty(), None
    while ahead and done != 0:
        known = unions([*ended, open_]).select(*(F.col(c).alias(f"_{c}") for c in start.columns))
        moved = materialized(
            open_.join(known, F.col("up") == F.col("_node")).select(
                "node",
                F.col("_up").alias("up"),
                F.col("_state").alias("state"),
                (F.col("steps") + F.col("_steps")).alias("steps"),
                F.col("_last").alias("last"),
            )
        )
        open_ = moved.where(F.col("state") == OPEN)
        ahead, done = moved.agg(F.count_if(F.col("state") == OPEN), F.count_if(F.col("state") != OPEN)).first()
        ended += [moved.where(F.col("state") != OPEN)] if done else []
    return unions(ended), open_


def rings(links: DataFrame) -> DataFrame:
    """``node, ring, on_ring`` of keys that lead into rings, from ``node, up``; ``ring`` is
    the least key on it.  Pointers as long as there are keys end on the ring, and
    have been all around it once they start there."""
    paths = materialized(links.select("node", "up", F.col("node").alias("low")))
    covered, count = 1, paths.count()
    while covered < count:
        known = paths.select(*(F.col(c).alias(f"_{c}") for c in paths.columns))
        paths = materialized(
            paths.join(known, F.col("up") == F.col("_node")).select(
                "node", F.col("_up").alias("up"), F.least("low", "_low").alias("low")
            )
        )
        covered *= 2
    ends = paths.select(F.col("up").alias("_end")).distinct()
    lows = paths.select(F.col("node").alias("_to"), F.col("low").alias("ring"))
    return (
        paths.join(lows, F.col("up") == F.col("_to"))
        .join(ends, F.col("node") == F.col("_end"), "left")
        .select("node", "ring", F.col("_end").isNotNull().alias("on_ring"))
    )


def fk_hierarchy(edge: ForeignKey, tables: Tables) -> DataFrame:
    """Every key of a table that refers to itself, with where its chain of parents ends:
    ``node, parent, state, depth, last, on_ring``.

    ``state`` is ``root`` (a null parent at the top; ``depth`` steps below it),
    ``missing`` (a parent that is not there, ``last``) or ``ring`` (``last`` is the least
    key of it, ``depth`` null).  Keys are text in comparable form.  A key that
    several rows hold goes by its least parent, null first; null keys have no row.
    """
    form = key_comparison(edge, tables)
    table = tables[edge.child]
    pairs = table.selectExpr(
        f"{key_text(form.parent, form.kind)} AS node", f"{key_text(form.child, form.kind)} AS up"
    ).where("node IS NOT NULL")
    # The least struct is the one with the least flag, so null comes first.
    least = F.min(F.struct(F.col("up").isNotNull(), F.col("up")))["up"]
    keys = materialized(pairs.groupBy("node").agg(least.alias("up")))
    there = keys.select(F.col("node").alias("_there"))
    links = keys.join(there, F.col("up") == F.col("_there"), "left").select(
        "node",
        "up",
        F.when(F.col("up").isNull(), ROOT).when(F.col("_there").isNull(), MISSING).otherwise(OPEN).alias("state"),
        F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("steps"),
        F.when(F.col("up").isNull(), F.col("node")).when(F.col("_there").isNull(), F.col("up")).alias("last"),
    )
    ended, open_ = followed(links)
    around = rings(keys.join(open_.select("node"), "node", "left_semi"))
    ends = unions(
        [
            ended.select("node", "state", F.col("steps").alias("depth"), "last", F.lit(False).alias("on_ring")),
            around.select(
                "node",
                F.lit(RING).alias("state"),
                F.lit(None).cast("bigint").alias("depth"),
                F.col("ring").alias("last"),
                "on_ring",
            ),
        ]
    )
    return keys.withColumnRenamed("up", "parent").join(ends, "node").select(
        "node", "parent", "state", "depth", "last", "on_ring"
    )


def fk_self_summary(edge: ForeignKey, tables: Tables) -> DataFrame:
    """A table referring to itself, in one row: the counts of direct parents, then
    ``rings`` of keys that no root is above, ``max_depth`` of a row below its root
    (0 for roots, null without any), and ``unrooted`` rows, whose chain ends at a
    missing parent or in a ring.
    """
    counts = fk_self_check(edge, tables)
    form = key_comparison(edge, tables)
    held = tables[edge.child].selectExpr(f"{key_text(form.child, form.kind)} AS _up")
    held = held.groupBy("_up").agg(F.count(F.lit(1)).alias("rows"))
    keys = materialized(fk_hierarchy(edge, tables))
    # A row without a parent is a root; any other one is a step below its parent.
    below = held.join(keys, F.col("_up") == F.col("node"), "left")
    rooted = (F.col("_up").isNull()) | F.coalesce(F.col("state") == ROOT, F.lit(False))
    depth = F.when(F.col("_up").isNull(), 0).when(F.col("state") == ROOT, F.col("depth") + 1)
    chains = below.agg(
        F.max(depth).cast("bigint").alias("max_depth"),
        F.coalesce(F.sum(F.when(~rooted, F.col("rows"))), F.lit(0)).alias("unrooted"),
    )
    number = keys.where("on_ring").agg(F.countDistinct("last").alias("rings"))
    return counts.crossJoin(number).crossJoin(chains)  # one row each


@dataclass(frozen=True)
class LostKeys:
    """Keys that rows refer to and that are gone or will be, ``keys`` of ``node``, and for
    each reference the expression of its node in the child's rows."""

    keys: DataFrame
    nodes: dict[ForeignKey, str]


def lost_keys(edges: list[ForeignKey], tables: Tables) -> LostKeys:
    """What rows of tables that refer to themselves or to each other lose, to the end.

    A row stays if each of its references is null, where that is allowed, or has
    a row that stays; rings stay.  A key held by one row, or by rows alike, with one
    such reference is followed by doubling.  Only keys whose rows refer to
    several keys, or differ in them, are settled round by round, after all chains
    between them have been cut short; a round reads and writes what is
    left of them, keys alone.
    """
    places: dict[tuple[str, str, str], int] = {}
    nodes, provided, wanted = {}, {}, {}
    for edge in edges:
        form = key_comparison(edge, tables)
        place = places.setdefault((edge.parent, form.parent, form.kind), len(places))
        nodes[edge] = f"'{place}:' || {key_text(form.child, form.kind)}"
        provided.setdefault(edge.parent, {})[place] = f"'{place}:' || {key_text(form.parent, form.kind)}"
        wanted.setdefault(edge.child, []).append(edge)
    parts = []
    for name, forms in provided.items():
        rows, own = tables[name], wanted.get(name, [])
        for edge in own:
            if not edge.nullable:
                rows = rows.where(F.col(edge.column).isNotNull())
        targets = ", ".join(nodes[e] for e in own) or "CAST(NULL AS string)"
        parts.append(
            rows.selectExpr(
                f"explode(array({', '.join(forms.values())})) AS node",
                f"array_sort(array_distinct(array_compact(array({targets})))) AS targets",
            ).where("node IS NOT NULL")
        )
    held = unions(parts)
    # One row a key: all its rows are alike where the least and the greatest are.
    keys = materialized(
        held.groupBy("node").agg(
            F.min("targets").alias("targets"),
            F.when(F.min(F.size("targets")) == 0, ROOT)
            .when((F.min("targets") == F.max("targets")) & (F.max(F.size("targets")) == 1), OPEN)
            .otherwise(FORK)
            .alias("state"),
        )
    )
    kinds = keys.select(F.col("node").alias("_there"), F.col("state").alias("_kind"))
    single = keys.where(F.col("state") == OPEN).select("node", F.col("targets")[0].alias("up"))
    links = single.join(kinds, F.col("up") == F.col("_there"), "left").select(
        "node",
        "up",
        F.coalesce("_kind", F.lit(MISSING)).alias("state"),
        F.lit(1).cast("bigint").alias("steps"),
        F.when(F.col("_kind") != OPEN, F.col("up")).alias("last"),
    )
    ended, open_ = followed(links)
    roots, forks = keys.where(F.col("state") == ROOT), keys.where(F.col("state") == FORK)
    alive = [roots.select("node"), ended.where(F.col("state") == ROOT).select("node"), open_.select("node")]
    if not forks.isEmpty():
        ends = unions(
            [
                ended.select("node", "state", "last"),
                open_.select("node", F.lit(ROOT).alias("state"), F.lit(None).cast("string").alias("last")),
                roots.select("node", "state", F.lit(None).cast("string").alias("last")),
                forks.select("node", "state", F.col("node").alias("last")),
            ]
        )
        left = surviving(held.join(forks.select("node"), "node", "left_semi"), ends)
        alive.append(left)
        on_forks = ended.where(F.col("state") == FORK).select("node", "last")
        alive.append(on_forks.join(left.withColumnRenamed("node", "last"), "last", "left_semi").select("node"))
    targets = unions(tables[e.child].selectExpr(f"{nodes[e]} AS node") for e in edges)
    targets = targets.where("node IS NOT NULL").distinct()
    return LostKeys(materialized(targets.join(unions(alive), "node", "left_anti")), nodes)


def surviving(held: DataFrame, ends: DataFrame) -> DataFrame:
    """The keys of ``held`` (``node, targets``, all FORK) that have a row all of whose
    targets stay, given where the chains of all keys end."""
    ends = ends.select(F.col("node").alias("_node"), F.col("state").alias("_state"), F.col("last").alias("_last"))
    each = held.distinct().select("node", "targets", F.explode("targets").alias("target"))
    # A row is settled but for those of its targets that are keys of this kind themselves.
    state = F.coalesce("_state", F.lit(MISSING))
    rows = (
        each.join(ends, F.col("target") == F.col("_node"), "left")
        .groupBy("node", "targets")
        .agg(
            F.max(state == MISSING).alias("gone"),
            F.collect_set(F.when(state == FORK, F.col("_last"))).alias("waits"),
        )
        .where("NOT gone")
    )
    rows = materialized(rows.select("node", "targets", "waits"))
    while True:
        there = rows.select(F.col("node").alias("wait")).distinct()
        waiting = rows.select("node", "targets", F.explode("waits").alias("wait"))
        lost = waiting.join(there, "wait", "left_anti").select("node", "targets").distinct()
        lost = materialized(lost)
        if lost.isEmpty():
            return rows.select("node").distinct()
        rows = materialized(rows.join(lost, ["node", "targets"], "left_anti"))
