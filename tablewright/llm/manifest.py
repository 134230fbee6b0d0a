"""Merkle manifest of a data set, with a proof for every row.

Rows are leaves of one tree a group; the trees' roots are the leaves of a tree
of their own, whose root stands for the whole data set.  Trees are built level
by level, each level an eighth of the one below.  Proofs come by pointer
jumping: every inner node starts with a pointer to its parent and the digests
of its siblings; a self-join lets it take over the pointer and the siblings of
the node it points to, so distances double until all pointers are at the root.
Leaves wait as runs of siblings, whose parents hold all that they share, and
take one last join.  Digests are kept as bytes and hashed as hexadecimal text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.columns import materialized
from tablewright.operators.sampling import dense_index

# What a leaf holds, in this order, and how many nodes make one.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
DIGEST_BYTES = 32

# The tree of the groups' roots.
TOP = -1
ID = ("tree", "level", "pos")
UP = ("up_tree", "up_level", "up_pos")
RESULT = (
    "doc_id bigint, lang string, pos bigint, leaf binary, altered binary, subroot binary, "
    "root binary, path array<struct<before:binary,after:binary>>"
)


def hashed(digests: Column) -> Column:
    """The digest, as bytes, of digests that stand one after the other."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def leaf_of(text: Column) -> Column:
    """The digest of a row that holds ``text``: its fields in a fixed order, each
    with its length in bytes before it, so no two rows are written alike."""
    values = [text if name == "text" else F.col(name).cast("string") for name in FIELDS]
    written = [
        F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values
    ]
    return F.unhex(F.sha2(F.concat(*written), 256))


def leaves(docs: DataFrame, altered: Column | None) -> DataFrame:
    """``tree`` (number of the group), ``n`` leaves in it, ``pos`` of the leaf among
    them, ``digest``, ``lang``, ``doc_id`` and the digest of the altered text."""
    own = docs.select(*FIELDS, (F.lit(None) if altered is None else altered).cast("string").alias("_altered"))
    text = F.col("text").cast("string")
    rows = own.select(
        F.col("lang").cast("string").alias("lang"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf_of(text).alias("digest"),
        F.when(F.col("_altered").isNotNull(), leaf_of(F.col("_altered"))).alias("altered"),
    )
    placed = materialized(dense_index(rows, "lang", "doc_id", "digest"))
    groups = placed.groupBy("lang").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n"))
    numbered = materialized(dense_index(groups, "first").withColumnRenamed("idx", "tree"))
    named = numbered.withColumnRenamed("lang", "_lang")
    return placed.join(named, F.col("lang").eqNullSafe(F.col("_lang"))).select(
        "tree", "n", (F.col("idx") - F.col("first")).alias("pos"), "digest", "lang", "doc_id", "altered"
    )


def runs(nodes: DataFrame, *more: str) -> DataFrame:
    """Every ``FAN`` consecutive nodes of a tree as one row: ``members`` in order, their
    digests one after the other in ``digests``, and the ``digest`` of the run."""
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", *more)))
    gathered = nodes.groupBy("tree", "n", F.expr(f"pos div {FAN}").alias("run")).agg(members.alias("members"))
    joined = F.aggregate("members", F.lit(b""), lambda all_, m: F.concat(all_, m["digest"]))
    return gathered.withColumn("digests", joined).withColumn("digest", hashed(F.col("digests")))


def climbed(lowest: DataFrame, most: int) -> Iterator[DataFrame]:
    """The written runs of every level, up from the lowest one, where the largest tree
    has ``most`` nodes."""
    level = lowest
    yield level
    while most > FAN:
        above = level.where(F.col("n") > FAN).select(
            "tree", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("run").alias("pos"), "digest"
        )
        level, most = materialized(runs(above)), -(-most // FAN)
        yield level


def siblings(digests: str, pos: Column) -> Column:
    """Digests before and after the one of ``pos`` among those of its run."""
    at = (F.pmod(pos, F.lit(FAN)) * DIGEST_BYTES).cast("int")
    whole = F.col(digests)
    return F.struct(
        F.substring(whole, F.lit(1), at).alias("before"),
        F.substring(whole, at + DIGEST_BYTES + 1, F.lit(FAN * DIGEST_BYTES)).alias("after"),
    )


def parent(tree: Column, level: int, run: Column, n: Column) -> list[Column]:
    """The node over a run of nodes of ``level``: the root of a group's tree is a leaf
    of the top one, and over the top one's root there is none."""
    is_root, in_top = n <= FAN, tree == TOP
    return [
        F.when(~is_root, tree).when(~in_top, F.lit(TOP)).cast("bigint").alias("up_tree"),
        F.when(~is_root, F.lit(level + 1)).when(~in_top, F.lit(0)).cast("int").alias("up_level"),
        F.when(~is_root, run).when(~in_top, tree).cast("bigint").alias("up_pos"),
    ]


def inner_nodes(level: int, level_runs: DataFrame) -> DataFrame:
    """The nodes of a level, each pointing to its parent, with its siblings as path.
    Leaves of the top tree know the root of their group: themselves."""
    each = level_runs.select("tree", "n", "run", "digests", F.explode("members").alias("m"))
    is_subroot = (F.col("tree") == TOP) & F.lit(level == 0)
    return each.select(
        F.col("tree").cast("bigint").alias("tree"),
        F.lit(level).alias("level"),
        F.col("m")["pos"].cast("bigint").alias("pos"),
        *parent(F.col("tree"), level, F.col("run"), F.col("n")),
        F.array(siblings("digests", F.col("m")["pos"])).alias("path"),
        F.when(is_subroot, F.col("m")["digest"]).alias("subroot"),
    )


def jumped(nodes: DataFrame) -> DataFrame:
    """Pointers twice as far, with the siblings of the way; written."""
    reached, open_ = nodes.where("up_tree IS NULL"), nodes.where("up_tree IS NOT NULL")
    further = nodes.select(*(F.col(c).alias(f"_{c}") for c in nodes.columns))
    same = [F.col(up) == F.col(f"_{own}") for up, own in zip(UP, ID, strict=True)]
    moved = open_.join(further, same).select(
        *ID,
        *(F.col(f"_{up}").alias(up) for up in UP),
        F.concat("path", "_path").alias("path"),
        F.coalesce("subroot", "_subroot").alias("subroot"),
    )
    return materialized(reached.unionByName(moved))


def paths_to_root(nodes: DataFrame) -> DataFrame:
    nodes = materialized(nodes)
    while not nodes.where("up_tree IS NOT NULL").isEmpty():
        nodes = jumped(nodes)
    return nodes


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """One row a row of ``docs`` (``doc_id, source, lang, n_chars, text``): ``doc_id,
    lang, pos, leaf, altered, subroot, root, path``.

    Leaves of one ``lang`` ascend by ``doc_id`` (null first), then by digest, and
    make one tree; trees ascend by ``lang`` (null first, then by bytes).  ``path``
    has for each level, from the leaf up to the root, the digests of the siblings
    ``before`` and ``after``; it is empty for a single row.  ``altered`` is a text
    to be judged in place of the row's own: its leaf is returned beside the
    original one, null where it is null.

    Nulls are written unlike any value, empty and very long texts are texts like
    others, repeated rows are leaves of their own, an empty table gives an empty
    one, and columns of other names play no part.
    """
    spark = docs.sparkSession
    rows = leaves(docs, altered)
    lowest = materialized(runs(rows, "lang", "doc_id", "altered"))
    # Numbers of trees and of the largest one's leaves.
    trees, most = lowest.agg(F.expr("max(tree) + 1"), F.max("n")).first()
    if trees is None:
        return spark.createDataFrame([], RESULT)
    levels = list(climbed(lowest, most))
    alone = lowest.where("n = 1").select("tree", F.col("members")[0]["digest"].alias("digest"))
    roots = [level.where((F.col("n") > 1) & (F.col("n") <= FAN)).select("tree", "digest") for level in levels]
    subroots = reduce(DataFrame.unionByName, roots, alone).select(
        F.lit(TOP).cast("bigint").alias("tree"), F.lit(trees).cast("bigint").alias("n"), F.col("tree").alias("pos"), "digest"
    )
    tops = list(climbed(materialized(runs(subroots)), trees))
    inner = [inner_nodes(k, level) for k, level in enumerate(levels) if k]
    if trees > 1:
        root = tops[-1].select("digest").first()[0]
        inner += [inner_nodes(k, level) for k, level in enumerate(tops)]
    else:  # the one tree's root is the whole's, and no run
        root = subroots.select("digest").first()[0]
        only = inner_nodes(0, tops[0])
        inner.append(only.withColumn("path", F.slice("path", 1, 0)))
    nodes = paths_to_root(reduce(DataFrame.unionByName, inner)).select(
        *(F.col(c).alias(f"_{c}") for c in ID), F.col("path").alias("above"), "subroot"
    )
    over = parent(F.col("tree"), 0, F.col("run"), F.col("n"))
    below = lowest.select("n", "members", "digests", *over)
    same = [F.col(up) == F.col(f"_{own}") for up, own in zip(UP, ID, strict=True)]
    each = below.join(nodes, same).select("n", "digests", "above", "subroot", F.explode("members").alias("m"))
    member = F.col("m")
    # A leaf alone in its tree is the tree's root already.
    own = F.when(F.col("n") > 1, F.concat(F.array(siblings("digests", member["pos"])), "above"))
    return each.select(
        member["doc_id"].alias("doc_id"),
        member["lang"].alias("lang"),
        member["pos"].alias("pos"),
        member["digest"].alias("leaf"),
        member["altered"].alias("altered"),
        "subroot",
        F.lit(bytes(root)).alias("root"),
        own.otherwise(F.col("above")).alias("path"),
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root, as bytes, that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda own, step: hashed(F.concat(step["before"], own, step["after"])))


def proof_digest(path: Column) -> Column:
    """The digest, as text, of all siblings of a path."""
    return F.sha2(
        F.array_join(F.transform(path, lambda s: F.lower(F.hex(F.concat(s["before"], s["after"])))), ""), 256
    )


def tampered(parts: int = 3) -> Column:
    """Texts with A-Z in lower case, of the rows whose id's crc32 ``parts`` divides;
    of others, null texts and null ids, null."""
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")), F.lit(parts)) == 0
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(chosen, F.translate(F.col("text").cast("string"), upper, upper.lower()))


def checked(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, and whether each row, some of them tampered with,
    still proves to be in it; digests as text."""
    found = manifest(docs, tampered()).withColumn(
        "folded", folded(F.coalesce("altered", "leaf"), F.col("path"))
    )
    as_text = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root")}
    return found.select(
        "doc_id",
        *(value.alias(name) for name, value in as_text.items()),
        proof_digest(F.col("path")).alias("proof_sha256"),
        F.lower(F.hex("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
