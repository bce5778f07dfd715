"""The Merkle manifest against a plain recursive tree, and its nodes and proofs."""

import hashlib
import os
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyworks.llm import merkle, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_hand(row):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(value, row))


def tree(leaves, arity):
    """Root, and for each leaf the sibling runs (before, after) of each level."""
    paths = [[] for _ in leaves]
    level = [(d, [i]) for i, d in enumerate(leaves)]
    while len(level) > 1:
        above = []
        for i in range(0, len(level), arity):
            run = level[i : i + arity]
            for k, (_, covered) in enumerate(run):
                for leaf in covered:
                    paths[leaf].append(([d for d, _ in run[:k]], [d for d, _ in run[k + 1 :]]))
            above.append((h(*[d for d, _ in run]), [x for _, c in run for x in c]))
        level = above
    return level[0][0], paths


def by_hand(rows, arity=3):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    trees = []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        held = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_by_hand(r)))
        trees.append((held, *tree([leaf_by_hand(r) for r in held], arity)))
    root, tops = tree([t[1] for t in trees], arity)
    found = []
    for (held, subroot, paths), top in zip(trees, tops):
        for row, path in zip(held, paths):
            doc_id, text = row[0], row[-1]
            hit = zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 2 == 0
            now = leaf_by_hand((*row[:-1], text.replace("\n", "") if hit and text is not None else text))
            steps = path + top
            for before, after in steps:
                now = h(*before, now, *after)
            proof = h(*[d for step in steps for side in step for d in side])
            found.append((doc_id, leaf_by_hand(row), subroot, root, proof, now, now == root))
    return sorted(found, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def fields(docs):
    return [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]


def found(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("name", ["given", "messy"])
def test_against_a_recursive_tree(request, name):
    docs = request.getfixturevalue(name)
    assert found(merkle.digest(docs)) == by_hand(fields(docs))


def test_query(spark):
    result = queries.QUERIES["op12_merkle_manifest"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert found(result) == by_hand(fields(docs))
    kinds = dict(result.dtypes)
    assert [kinds[c] for c in COLUMNS] == ["bigint", *["string"] * 5, "boolean"]


@pytest.mark.parametrize("n,stride", [(1, 2), (2, 2), (3, 1), (4, 1), (9, 2), (10, 2), (28, 1), (81, 2), (82, 2), (250, 3)])
def test_heights_and_strides(spark, n, stride):
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.lit("a")).alias("source"), F.lit("en").alias("lang"),
        F.lit(1).alias("n_chars"), F.concat_ws("\n", "id", F.lit("x")).alias("text"),
    )
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    lost = F.when(hit, merkle.text_without_breaks(F.col("text"))).otherwise(F.col("text"))
    result = merkle.verify(docs, tampered=lambda own: [*list(own.values())[:-1], lost], stride=stride)
    assert found(result) == by_hand(fields(docs))


def test_nodes_nest(spark):
    rows = spark.range(100).select(
        F.when(F.col("id") < 99, F.lit("big")).alias("group_key"), F.col("id").alias("order_key"),
        F.sha2(F.col("id").cast("string"), 256).alias("leaf"),
    )
    leaves, nodes = merkle.manifest(rows, arity=3, stride=2)
    told = [tuple(r) for r in nodes.select("tree", "group", "level", "lo", "hi", "digest").collect()]
    assert len(told) == len(set(told))
    # 99 leaves, 33, 11, 4, 2 and 1; one lone leaf; two subroots and the root.
    assert sorted((t, g, k) for t, g, k, *_ in told) == sorted(
        [("group", 1, k) for k, n in enumerate([99, 33, 11, 4, 2, 1]) for _ in range(n)]
        + [("group", 0, 0), ("top", 0, 0), ("top", 0, 0), ("top", 0, 1)]
    )
    by_place = {t[:5]: t[5] for t in told}
    for (kind, g, k, lo, hi), digest in by_place.items():
        children = sorted((p, d) for p, d in by_place.items() if p[:3] == (kind, g, k - 1) and lo <= p[3] and p[4] <= hi)
        if children:
            assert digest == h(*[d for _, d in children])
    assert leaves.count() == 100
    assert leaves.filter(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_nothing(nothing):
    assert merkle.digest(nothing).count() == 0
