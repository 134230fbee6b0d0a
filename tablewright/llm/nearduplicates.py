"""Near-duplicate classes by a signature-coordinate inverted join.

Documents with equal shingle sets are one class, and a class is posted once
under each (coordinate, value) pair of its MinHash signature.  Two sets over the
limit agree in at least ``threshold`` coordinates but for a chance of about
1e-7, so they meet in the ``coordinates - threshold + 1`` rarest pairs of
either: only that prefix is merged.  The lists of frequent pairs are skipped;
candidates count their collisions there by comparing signatures.  Links are
confirmed on full sets.

No list is expanded into its pairs.  Lists that share a class are one group,
found by linking each member of a list to its least one, so every link lies
within a group.  Groups are dealt into bins of bounded size, and a group larger
than a bin into blocks that meet two by two, so every pair is looked at in some
task and no task gathers more than two blocks.  A task puts out only the links
that span what it found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewright.llm import wordarrays as wa
from tablewright.llm.columns import keyed, materialized, rejoined
from tablewright.operators.sizing import BROADCAST_BYTES

# What a term with its count, and the id of a row, take in a hash relation at most.
TERM_BYTES, ID_BYTES = 32, 64
# Posts of a term from which on it goes by broadcast.
HOT_POSTS = 1000


@dataclass(frozen=True)
class NearSettings:
    """``words`` in a shingle; ``percent``: least similarity of a link;
    ``coordinates`` of a signature and the ``threshold`` of equal ones;
    ``bin_shingles``: shingles that a task is meant to compare at once."""

    words: int = 5
    percent: int = 80
    coordinates: int = 64
    threshold: int = 33
    bin_shingles: int = 2_000_000

    @property
    def prefix(self) -> int:
        return self.coordinates - self.threshold + 1


def multipliers(settings: NearSettings) -> np.ndarray:
    draws = np.random.default_rng(7).integers(0, 2**63, settings.coordinates, np.uint64)
    return draws * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of ``size`` words with
    A-Z in lower case, the whole sequence where there are fewer words."""
    data, begins = wa.joined(texts)
    data = wa.LOWER[data]
    starts, ends = wa.word_bounds(data)
    words = wa.word_hashes(data, starts, ends)
    runs = wa.run_hashes(words, size)
    bounds = np.append(np.searchsorted(starts, begins), len(words)).tolist()
    sets = []
    for low, high in zip(bounds, bounds[1:]):
        if high - low >= size:
            sets.append(np.unique(runs[low : high - size + 1]))
        elif high > low:
            whole = hashlib.blake2b(words[low:high].tobytes(), digest_size=8).digest()
            sets.append(np.frombuffer(whole, np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray], settings: NearSettings) -> np.ndarray:
    """One row of coordinates for each set that is not empty: the least hash, whole.

    Least hashes crowd at the low end of their range, so the upper bits of
    unrelated sets agree by chance the more often the larger the corpus is; all
    64 bits together do not."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.zeros((0, settings.coordinates), np.int64)
    flat = np.concatenate(full)
    sizes = np.array([len(s) for s in full])
    begins = np.cumsum(sizes) - sizes
    out = np.empty((len(full), settings.coordinates), np.uint64)
    for k, factor in enumerate(multipliers(settings)):
        out[:, k] = np.minimum.reduceat(flat * factor, begins)
    return out.view(np.int64)


def short(drawn: np.ndarray) -> np.ndarray:
    """Signatures to compare row by row: the lower halves, which are spread evenly."""
    return drawn.astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame, settings: NearSettings) -> DataFrame:
    """``doc_id, text_key, n_shingles, class, signature``; class and signature are
    null for an empty set."""
    schema = (
        "doc_id bigint, text_key bigint, n_shingles bigint, class binary, signature array<bigint>"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in wa.byte_chunks(batches, ("doc_id", "text_key")):
            sets = shingle_sets(texts, settings.words)
            rest = iter(signatures(sets, settings))
            ids, keys = zip(*rows, strict=True)
            names = [
                hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                for s in sets
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(keys, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(names, pa.binary()),
                    pa.array([next(rest) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "text_key", "n_shingles", "class", "signature"],
            )

    return keyed(docs).mapInArrow(work, schema)


def prefix_posts(classes: DataFrame, settings: NearSettings) -> DataFrame:
    """``term, id``: each class, by a short hash of its name, under the rarest of its
    pairs.  Classes that share an id by chance are only grouped together.

    A pair no other class has is in the prefix but links nothing, so it only
    takes up room there.  Classes that share fewer than ``threshold`` of their
    pairs with anyone are near to none."""
    posted = classes.select("id", F.posexplode("signature").alias("k", "value")).select(
        F.xxhash64("k", "value").alias("term"), "id"
    )
    shared = materialized(posted.groupBy("term").agg(F.count("*").alias("n")).where("n > 1"))
    own = W.partitionBy("id")
    ranked = (
        joined_by_term(posted, shared)
        .withColumn("shared", F.count("*").over(own))
        .where(F.col("shared") >= settings.threshold)
        .withColumn("rank", F.row_number().over(own.orderBy("n", "term")))
    )
    room = F.lit(settings.prefix) - (F.lit(settings.coordinates) - F.col("shared"))
    return ranked.where(F.col("rank") <= room).select("term", "id")


def joined_by_term(posts: DataFrame, counted: DataFrame) -> DataFrame:
    """Posts with what is known of their term (``term, n`` and more; written).

    Terms that very many hold go by broadcast, so no task gets all posts of one.
    They are those of over ``limit`` posts, which grows with the posts: there
    are never more than fit ``BROADCAST_BYTES``."""
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(HOT_POSTS, total * TERM_BYTES // BROADCAST_BYTES)
    hot = F.broadcast(counted.where(F.col("n") > limit))
    rest = posts.join(hot.select("term"), "term", "left_anti")
    columns = [*posts.columns, *(c for c in counted.columns if c != "term")]
    return posts.join(hot, "term").select(columns).unionByName(
        rest.join(counted.where(F.col("n") <= limit), "term").select(columns)
    )


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the least node that each linked node (columns ``a, b``)
    reaches.  Every step takes the least root among the neighbours and then
    that root's own root, so chains shorten by half and more."""
    # Read twice: links that span a bin depend on the order of its rows.
    links = materialized(links.select("a", "b"))
    edges = materialized(
        links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        .distinct()
    )
    roots = materialized(edges.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("node"), F.least("u", "m").alias("root")
    ))
    while True:
        around = (
            edges.join(roots.select(F.col("node").alias("v"), "root"), "v")
            .groupBy("u")
            .agg(F.min("root").alias("m"))
        )
        lower = roots.join(around, roots["node"] == around["u"]).select(
            "node", F.least("root", "m").alias("root"), F.col("root").alias("old")
        )
        lower = materialized(lower)
        jumped = lower.join(
            lower.select(F.col("node").alias("up"), F.col("root").alias("top")),
            F.col("root") == F.col("up"),
            "left",
        ).select("node", F.least("root", F.coalesce("top", "root")).alias("root"), "old")
        roots = materialized(jumped)
        if not roots.where("root <> old").limit(1).count():
            return roots.select("node", "root")


def dealt(groups: DataFrame, settings: NearSettings) -> DataFrame:
    """``class, bin, side``: where each class (``class, root, n_shingles``) is compared.

    Groups that fit a bin together share one.  A larger group is cut into blocks
    by class, each pair of blocks has a bin of its own, and ``side`` tells the
    two apart (null where all are compared with all)."""
    sizes = materialized(
        groups.groupBy("root").agg(F.sum("n_shingles").alias("size"))
    )
    limit = settings.bin_shingles
    small = sizes.where(F.col("size") <= limit).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bins = max(1, -(-2 * small // limit))
    named = groups.join(sizes, "root")
    together = named.where(F.col("size") <= limit).select(
        "class",
        F.concat(F.lit("bin "), F.pmod(F.xxhash64("root"), F.lit(bins))).alias("bin"),
        F.lit(None).cast("boolean").alias("side"),
    )
    blocks = F.ceil(F.col("size") / limit)
    alone = (
        named.where(F.col("size") > limit)
        .withColumn("own", F.pmod(F.xxhash64("class"), blocks))
        .select("class", "root", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other"))
        .select(
            "class",
            F.concat_ws(" ", "root", F.least("own", "other"), F.greatest("own", "other")).alias("bin"),
            F.when(F.col("own") != F.col("other"), F.col("own") < F.col("other")).alias("side"),
        )
    )
    return together.unionByName(alone)


class Merger:
    """Counts collisions of signatures through inverted lists, and confirms."""

    def __init__(self, sets: list[np.ndarray], drawn: np.ndarray, sides: list, settings: NearSettings):
        self.drawn, self.settings = drawn, settings
        self.sides = np.array([-1 if s is None else int(s) for s in sides])
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.cumsum(self.sizes) - self.sizes
        _, self.shingles = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(int(self.shingles.max()) + 1, bool)
        self.lists, self.prefixes = self.inverted()

    def inverted(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Lists of the prefix pairs, and each row's prefix; pairs are numbered
        from the rarest on."""
        n, width = self.drawn.shape
        flat = (np.arange(width, dtype=np.int64) << 32) + self.drawn.view(np.uint32)
        _, pair, number = np.unique(flat, return_inverse=True, return_counts=True)
        place = np.empty(len(number), np.int64)
        place[np.argsort(number, kind="stable")] = np.arange(len(number))
        prefix = np.sort(place[pair].reshape(n, width), axis=1)[:, : self.settings.prefix]
        order = np.argsort(prefix.ravel(), kind="stable")
        rows = order // prefix.shape[1]
        cuts = np.searchsorted(prefix.ravel()[order], np.arange(len(number) + 1))
        return [rows[a:b] for a, b in zip(cuts, cuts[1:])], prefix

    def near(self, row: int, roots: np.ndarray) -> np.ndarray:
        """Later rows of other components that are linked with this one."""
        met = np.concatenate([self.lists[t] for t in self.prefixes[row].tolist()])
        met = np.unique(met[met > row])
        met = met[(roots[met] != roots[row]) & ((self.sides[met] != self.sides[row]) | (self.sides[row] < 0))]
        agree = (self.drawn[met] == self.drawn[row]).sum(axis=1)
        met = met[agree >= self.settings.threshold]
        if not len(met):
            return met
        own = self.shingles[self.starts[row] : self.starts[row] + self.sizes[row]]
        self.mark[own] = True
        sizes = self.sizes[met]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[met] - (ends - sizes), sizes)
        common = np.add.reduceat(self.mark[self.shingles[at]].astype(np.int64), ends - sizes)
        self.mark[own] = False
        union = sizes + self.sizes[row] - common
        return met[100 * common >= self.settings.percent * union]

    def links(self) -> Iterator[tuple[int, int]]:
        """Links that span the components of these rows."""
        roots = np.arange(len(self.sizes))
        for row in range(len(roots)):
            for other in self.near(row, roots).tolist():
                if roots[other] != roots[row]:
                    roots[roots == roots[other]] = roots[row]
                    yield row, other


def class_links(docs: DataFrame, classes: DataFrame, settings: NearSettings) -> DataFrame:
    """Confirmed links ``a, b`` between classes, enough to span every component."""
    posts = materialized(prefix_posts(classes, settings))
    least = posts.groupBy("term").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    meetings = joined_by_term(posts, materialized(least)).select("a", F.col("id").alias("b"))
    # A class is linked to the least of its lists' least members alone, and that one to
    # the others: of a group of copies these are few, and the same for all.
    hubs = meetings.withColumn("hub", F.min("a").over(W.partitionBy("b")))
    stars = hubs.select(F.col("hub").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    groups = components(stars.where("a <> b").distinct()).select(
        F.col("node").alias("id"), "root"
    )
    groups = materialized(
        groups.join(classes.select("id", "class", "rep", "n_shingles", "signature"), "id")
    )
    places = dealt(groups.select("class", "root", "n_shingles"), settings)
    wanted = groups.join(places, "class").select(
        F.col("rep.doc_id").alias("_id"), F.col("rep.text_key").alias("_key"), "class", "signature", "bin", "side"
    )
    listed = wanted.groupBy("_id", "_key").agg(
        F.collect_list(F.struct("class", "signature", "bin", "side")).alias("own")
    )
    # Only texts that are compared leave their place, as long as their ids are few enough.
    listed = materialized(listed)
    asked, same = listed.select("_id", "_key"), (
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    )
    if asked.count() * ID_BYTES <= BROADCAST_BYTES:
        asked = F.broadcast(asked)
    rows = (
        keyed(docs)
        .join(asked, same, "left_semi")
        .dropDuplicates(["doc_id", "text_key"])
        .join(listed, same)
        .select("text", F.explode("own").alias("o"))
        .select("text", "o.*")
    )

    def compare(table: pa.Table) -> pa.Table:
        texts = table.column("text").cast(pa.binary()).to_pylist()
        drawn = short(np.array(table.column("signature").to_pylist(), np.int64))
        sets = shingle_sets(texts, settings.words)
        merger = Merger(sets, drawn, table.column("side").to_pylist(), settings)
        names = table.column("class").to_pylist()
        found = [(names[a], names[b]) for a, b in merger.links()]
        a, b = zip(*found, strict=True) if found else ([], [])
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows.groupBy("bin").applyInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, settings: NearSettings | None = None) -> DataFrame:
    """One row a document: ``doc_id, text_key, n_shingles, component_id, kept``.

    ``component_id`` is the least ``doc_id`` that a document reaches over links,
    itself included.  Null and empty texts, and texts of white space, have no
    set and are linked with nothing.  Repeated rows are exact copies of each other.  A null
    ``doc_id`` counts after every other: such a row takes the component's least
    id and is not kept, or has none and is kept where all ids are null.
    """
    settings = settings or NearSettings()
    drawn = materialized(sketches(docs, settings))
    classes = materialized(
        drawn.where("class IS NOT NULL")
        .groupBy("class")
        .agg(
            F.min("doc_id").alias("least"),
            F.min(F.struct("doc_id", "text_key")).alias("rep"),
            F.first("signature").alias("signature"),
            F.first("n_shingles").alias("n_shingles"),
        )
        .withColumn("id", F.xxhash64("class"))
    )
    roots = components(class_links(docs, classes, settings))
    rooted = classes.select("class", "least").join(
        roots, classes["class"] == roots["node"], "left"
    ).select("class", "least", F.coalesce("root", "class").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select(F.col("class").alias("_class"), "component")
    out = drawn.drop("signature").join(named, drawn["class"] == F.col("_class"), "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select(
        "doc_id",
        "text_key",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns; repeated rows alike in
    id and text stay once."""
    kept = near_duplicates(docs).where("kept").select("doc_id", "text_key").distinct()
    return rejoined(docs, kept, "inner").select("row.*").dropDuplicates(["doc_id", "text"])
