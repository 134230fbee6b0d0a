"""The Merkle manifest against trees built one node at a time."""

import hashlib
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tablewright.llm import manifest
from tests.llm.texts import DOC_SCHEMA, EXTRA, ascii_lower, documents, sample_texts


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(fields):
    written = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields]
    return digest("".join(written))


def plain_tree(nodes):
    """The root, and for each node its siblings (before, after) level by level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, k in zip(paths, place):
            low = k - k % 8
            path.append(("".join(nodes[low:k]), "".join(nodes[k + 1 : low + 8])))
        nodes = [digest("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
        place = [k // 8 for k in place]
    return nodes[0], paths


def plain_manifest(rows):
    """Rows of doc_id, source, lang, n_chars, text."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row, plain_leaf(row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0][0] is not None, r[0][0] or 0, r[1]))
    trees = [plain_tree([leaf for _, leaf in groups[name]]) for name in names]
    root, tops = plain_tree([subroot for subroot, _ in trees])
    out = []
    for name, (subroot, paths), top in zip(names, trees, tops):
        for (row, leaf), path in zip(groups[name], paths):
            whole = path + top
            folded, tampers = leaf, row[0] is not None and crc32(str(row[0]).encode()) % 3 == 0
            if tampers and row[4] is not None:
                folded = plain_leaf((*row[:4], ascii_lower(row[4])))
            for before, after in whole:
                folded = digest(before + folded + after)
            proof = digest("".join(b + a for b, a in whole))
            out.append((row[0], leaf, subroot, root, proof, folded, folded == root))
    return out


def plain_rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def same(docs):
    got, want = manifest.checked(docs).collect(), plain_manifest(plain_rows(docs))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    return want


@pytest.mark.parametrize("sizes", [[1], [2], [8], [9], [65], [1, 1], [8, 1, 64], [530, 1, 7, 16, 2, 9, 1, 3, 10]])
def test_trees_of_all_shapes(spark, sizes):
    rows = [(None if g == 2 else f"l{g}", k) for g, size in enumerate(sizes) for k in range(size)]
    docs = spark.createDataFrame(
        [(n * 7, f"Text {n}", lang, f"s{k}", k) for n, (lang, k) in enumerate(rows)], DOC_SCHEMA
    )
    want = same(docs.repartition(3))
    assert len({r[3] for r in want}) == 1
    if len(rows) > 20:
        assert {r[-1] for r in want} == {True, False}


def test_odd_rows(spark):
    docs = documents(spark, sample_texts(), extra=True)
    odd = [(None, None, None, None, None), (None, None, None, None, None), (5, "Ä a\x00B", "", "", -1), (5, "x", "", "", -1)]
    more = spark.createDataFrame([(*r, 1, "k", "s", "c", "r") for r in odd], DOC_SCHEMA + EXTRA)
    languages = ["en", "dé", "", None, "EN"]
    docs = docs.withColumn("lang", F.element_at(F.array(*map(F.lit, languages)), F.coalesce(F.col("doc_id") % 5, F.lit(0)).cast("int") + 1))
    same(docs.unionByName(more))


def test_many_groups(spark):
    """More groups than one run, most of them of a single row."""
    rows = [(n, f"T{n}", f"l{min(n, 150):03}", "s", 1) for n in range(200)]
    same(spark.createDataFrame(rows, DOC_SCHEMA))


def test_path_proves_a_row_and_nothing_else(spark):
    docs = spark.createDataFrame([(n, f"T{n}", "l", "s", 1) for n in range(100)], DOC_SCHEMA)
    rows = manifest.manifest(docs, F.lit("other")).collect()
    for row in rows:
        for start, good in ((row.leaf, True), (row.altered, False)):
            own = start.hex()
            for step in row.path:
                own = digest(step.before.hex() + own + step.after.hex())
            assert (own == row.root.hex()) is good
    assert sorted(r.pos for r in rows) == list(range(100))


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOC_SCHEMA)
    assert manifest.checked(docs).count() == 0
