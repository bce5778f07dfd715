"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives a vector a long string of bits, the sides of random hyperplanes it lies
on, and keeps the strings sorted. The neighbours with the longest common prefixes stand
beside a query's place in the sorted array. All trees ascend together: from the deepest
prefix level on, levels are opened in all trees at once until they hold enough candidates,
so prefixes are as long as the surroundings of the query allow. Candidates are compared
by their exact cosine on the original vectors.

Equal vectors are one node with their least ids, so copies never fill a prefix. Vectors
that are close but not equal can share a whole string in more places than a search looks
at; such a group is told apart by the sides of further hyperplanes of that tree through
its own centre, again and again until no group is larger than the reach. The sorted array of a
tree is dealt by place, not by prefix, into blocks of one size, whatever the number of
vectors; a frequent prefix is no larger block. A query goes to every block within its
reach, so a vector is sent once for each tree, and the queries of a block are parted by
hash where a long reach brings many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise, number_rows

TREES = 40
# Bits of a string; below 53, so that a double holds it exactly.
BITS = 48
# Candidates, counted once for each tree that finds them, at which levels stop opening,
# and places of a sorted array looked at on either side of a query, for up to ``ROOM``
# nodes. Beyond, both grow with that power of the nodes, or recall would fall.
ENOUGH = 40_000
REACH = 2048
ROOM = 60_000
GROWTH = 0.9
# Places of a block, and blocks' worth of places whose queries one task compares with it.
BLOCK = 4096
SHARE = 16
# Members of a group, drawn by hash, whose mean is its centre.
CENTRE = 256
SEED = 11


def budget(nodes: int) -> tuple[int, int]:
    """The candidates and the reach for so many nodes."""
    grown = max(1.0, nodes / ROOM) ** GROWTH
    return math.ceil(ENOUGH * grown), math.ceil(REACH * grown)


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """Rows that take part: an id, and a vector of the usual length, finite and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(
        F.col(id).isNotNull() & F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    ).select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (usual["n"] if usual else 0))


def strings(trees: int, bits: int, seed: int):
    """One row for each tree with the bits of the vector's sides."""
    schema = pa.schema([("tree", pa.int32()), ("bits", pa.int64()), ("node", pa.int64()), ("asks", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("vector"))
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], trees * bits))
            for s in range(0, len(vectors), 1024):
                part = vectors[s : s + 1024]
                sides = (part @ planes > 0).reshape(len(part), trees, bits) @ weights
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(trees, dtype=np.int32), n)),
                        pa.array(sides.ravel()),
                        pa.array(np.repeat(batch.column("node").to_numpy()[s : s + n], trees)),
                        pa.array(np.repeat(batch.column("asks").to_numpy(zero_copy_only=False)[s : s + n], trees)),
                    ],
                    schema=schema,
                )

    return run


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def centre(table: pa.Table) -> pa.Table:
    """The mean direction of one group's drawn members, in an order that is always the same."""
    vectors = unit(matrix(table.sort_by("node").column("vector")))
    return table.slice(0, 1).select(["tree", "bits", "deep"]).append_column(
        "centre", pa.array([vectors.mean(axis=0).tolist()], pa.list_(pa.float64()))
    )


def deeper(bits: int, seed: int, turn: int):
    """Add to ``deep`` the sides of a tree's further hyperplanes through the group's centre."""
    schema = pa.schema(
        [("tree", pa.int32()), ("bits", pa.int64()), ("deep", pa.list_(pa.int64())), ("node", pa.int64()), ("asks", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            away = unit(matrix(batch.column("vector"))) - matrix(batch.column("centre"))
            tree = batch.column("tree").to_numpy()
            sides = np.zeros(len(tree), dtype=np.int64)
            for t in np.unique(tree).tolist():
                if t not in planes:
                    planes[t] = np.random.default_rng([seed, turn, t]).standard_normal((away.shape[1], bits))
                at = tree == t
                sides[at] = (away[at] @ planes[t] > 0) @ weights
            deep = [d + [x] for d, x in zip(batch.column("deep").to_pylist(), sides.tolist())]
            columns = {"deep": pa.array(deep, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([columns.get(f.name, batch.column(f.name)) for f in schema], schema=schema)

    return run


def tell_apart(named: DataFrame, nodes: DataFrame, most: int, bits: int, seed: int) -> DataFrame:
    """Add ``deep``, further strings for rows whose string more than ``most`` rows share.

    Every hyperplane through a group's centre has members on both sides, so groups shrink
    from turn to turn; turns end when no group is too large or none was divided, which
    leaves only vectors of one direction. Centres are at most the rows over ``most``.
    """
    group = ["tree", "bits", "deep"]
    named = materialise(named.withColumn("deep", F.array().cast("array<long>")))
    turn, before = 0, None
    while True:
        large = materialise(named.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > most))
        now = tuple(large.agg(F.count("*"), F.sum("_n")).first())
        if not now[0] or now == before:
            return named
        turn, before = turn + 1, now
        crowd = named.join(large.drop("_n"), group, "left_semi")
        drawn = Window.partitionBy(*group).orderBy(F.xxhash64("node"), "node")
        drawn = crowd.withColumn("_r", F.row_number().over(drawn)).filter(F.col("_r") <= CENTRE).drop("_r")
        drawn = drawn.join(nodes.select("node", "vector"), "node").select(*group, "node", "vector")
        centres = drawn.groupBy(*group).applyInArrow(centre, "tree int, bits long, deep array<long>, centre array<double>")
        crowd = crowd.join(materialise(centres), group).join(nodes.select("node", "vector"), "node")
        told = crowd.mapInArrow(deeper(bits, seed, turn), "tree int, bits long, deep array<long>, node long, asks boolean")
        rest = named.join(large.drop("_n"), group, "left_anti")
        named = materialise(told.unionByName(rest))


def common_bits(strings: np.ndarray, query: int, bits: int) -> np.ndarray:
    return bits - np.frexp((strings ^ query).astype(np.float64))[1]


def window(members: pa.Table, reach: int):
    """A function from a query's place to the rows of a block within its reach."""
    place = members.column("place").to_numpy()
    return lambda at: slice(*np.searchsorted(place, (at - reach, at + reach + 1)).tolist())


def open_levels(bits: int, reach: int):
    """Per query and block: how many strings share at least so many bits, for each level."""

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        members = members.sort_by("place")
        text, near = members.column("bits").to_numpy(), window(members, reach)
        rows = []
        for at, own in zip(queries.column("place").to_pylist(), queries.column("bits").to_pylist()):
            shared = common_bits(text[near(at)], own, bits)
            at_least = np.bincount(shared, minlength=bits + 1)[::-1].cumsum()[::-1]
            rows.append(at_least.astype(np.int64).tolist())
        return pa.table({"node": queries.column("node"), "held": pa.array(rows, pa.list_(pa.int64()))})

    return run


def nearest(bits: int, reach: int, top: int):
    """Per query and block: the nodes of greatest cosine among those at the opened levels."""

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        query, found, scores = [], [], []
        if len(queries) and len(members):
            members = members.sort_by("place")
            text, node, near = members.column("bits").to_numpy(), members.column("node").to_numpy(), window(members, reach)
            vectors, asked = matrix(members.column("vector")), matrix(queries.column("vector"))
            norms, lengths = (np.sqrt((x * x).sum(axis=1)) for x in (vectors, asked))
            told = (queries.column(c).to_pylist() for c in ("node", "place", "bits", "level"))
            for i, (number, at, own, level) in enumerate(zip(*told)):
                part = near(at)
                here = np.flatnonzero(common_bits(text[part], own, bits) >= level) + part.start
                score = (vectors[here] * asked[i]).sum(axis=1) / (norms[here] * lengths[i])
                best = np.lexsort((node[here], -score))[:top]
                query += [number] * len(best)
                found += node[here[best]].tolist()
                scores += score[best].tolist()
        return pa.table(
            {"query": pa.array(query, pa.int64()), "node": pa.array(found, pa.int64()), "score": pa.array(scores, pa.float64())}
        )

    return run


def search(
    vectors: DataFrame, asks, id: str, vector: str, k: int = 5, trees: int = TREES, bits: int = BITS,
    enough: int | None = None, block: int | None = None, reach: int | None = None, seed: int = SEED,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of the ``k`` nearest found.

    ``asks`` tells of the id column ``id`` which rows are queries. A row without an id or
    with a vector that is null, zero, not finite, or not of the most frequent length takes
    no part. Ties go to the smaller id; a query's own id is left out. The hyperplanes
    depend on the seed alone, and the centres of large groups on their members. With
    ``enough`` or fewer rows in all trees, every row is a candidate. ``enough`` and
    ``reach`` follow from the number of nodes (``budget``) where they are not given; a task
    holds ``block`` vectors and their queries, however many there are. An empty table gives
    an empty table.
    """
    rows = usable(vectors, id, vector).withColumn("asks", asks)
    nodes = materialise(
        rows.groupBy("vector").agg(F.min("id").alias("node"), F.max("asks").alias("asks"))
    )
    size = nodes.count()
    usual_enough, usual_reach = budget(size)
    enough, reach, block = enough or usual_enough, reach or usual_reach, block or BLOCK
    copies = rows.join(nodes.select("vector", "node"), "vector").select("id", "asks", "node")
    copies = materialise(copies)
    # A node's least ids are all that k places can show, and one more for the query itself.
    order = Window.partitionBy("node").orderBy("id")
    least = copies.select("node", "id").distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
    named = nodes.mapInArrow(strings(trees, bits, seed), "tree int, bits long, node long, asks boolean")
    named = tell_apart(named, nodes, reach, bits, seed)
    placed = number_rows(named, ["tree", "bits", "deep", "node"], "place").drop("deep")
    inside = (F.col("place") % F.lit(max(1, size))).cast("long")
    spread = materialise(placed.withColumn("place", inside).select("tree", "place", "bits", "node", "asks"))
    # A block's queries lie within reach of it; parts of them meet a copy of the block each.
    parts = max(1, -(-2 * reach // (SHARE * block)))
    last = max(0, size - 1) // block
    at = lambda place: F.floor(place / block).cast("long")
    first_home = F.greatest(at(F.col("place") - reach), F.lit(0))
    homes = F.explode(F.sequence(first_home, F.least(at(F.col("place") + reach), F.lit(last))))
    part = F.pmod(F.xxhash64("node"), F.lit(parts))
    queries = spread.filter("asks").drop("asks").withColumns({"home": homes, "part": part})
    members = spread.drop("asks").withColumns(
        {"home": at(F.col("place")), "part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))}
    )
    group = ["tree", "home", "part"]
    # Both sides come from one table; new names of their own keep their columns apart.
    apart = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    both = lambda a, b: apart(a).groupBy(*group).cogroup(b.groupBy(*group))
    opened = both(queries, members).applyInArrow(open_levels(bits, reach), "node long, held array<long>")
    sums = opened.groupBy("node").agg(*[F.sum(F.get("held", F.lit(i))).alias(f"_{i}") for i in range(bits + 1)])
    filled = F.size(F.filter(F.array(*[f"_{i}" for i in range(bits + 1)]), lambda n: n >= enough))
    levels = materialise(sums.select("node", F.greatest(filled - 1, F.lit(0)).alias("level")))
    vector_of = nodes.select("node", "vector")
    queries = queries.join(levels, "node").join(vector_of, "node")
    found = both(queries, members.join(vector_of, "node")).applyInArrow(
        nearest(bits, reach, k + 1), "query long, node long, score double"
    )
    best = found.groupBy("query", "node").agg(F.max("score").alias("score"))
    first = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    best = best.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1).drop("_n")
    best = materialise(best)
    queries = copies.filter("asks").select(F.col("id").alias("query_id"), F.col("node").alias("query")).distinct()
    shown = queries.join(best, "query").join(least.select("node", F.col("id").alias("vec_id")), "node")
    shown = shown.filter("vec_id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    shown = shown.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return shown.select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (query_id, vec_id) that were found."""
    hit = exact.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hit / max(1, exact.count())
