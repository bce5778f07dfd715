"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits link at up to three differing bits. Cut into two segments, one of
the segments differs by one bit at most. A segment is indexed under each of its variants
with one bit made a wildcard; two segments that differ by at most one bit share a variant.
So an equality join on (segment, wildcard place, remaining bits) finds every linked pair,
and the whole fingerprints verify it.

Equal fingerprints are one node. Buckets of two are verified as they are. Larger buckets,
as made by large groups of near copies, are dealt in blocks: each pair of blocks of one
bucket is compared by one task, which keeps a spanning forest of the links it sees, fewer
than the fingerprints it holds. So a group costs neither all its pairs in rows nor a task
that holds it whole, and what is connected stays connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructType
from xxhash import xxh64_intdigest


from .common import fresh, materialise

SHINGLE = 3
DISTANCE = 3
HALF = 32
# Fingerprints of one block of a large bucket.
BLOCK = 2048
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority of the bits of all shingles; 0 for a text without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < shingle:
        grams = [b" ".join(tokens)]
    else:
        grams = map(b" ".join, zip(*(tokens[i:] for i in range(shingle))))
    hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def add_fingerprint(df: DataFrame, text: str, into: str, shingle: int = SHINGLE) -> DataFrame:
    """Replace ``text`` by ``into``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(at)]
            signed = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), signed], [*(batch.schema.names[i] for i in kept), into]
            )

    fields = [f for f in df.schema.fields if f.name != text]
    return df.mapInArrow(run, StructType(fields).add(into, LongType()))


def variants(node: Column) -> Column:
    """The keys of a fingerprint: segment, wildcard place, and the segment without that bit."""
    low = node.bitwiseAND(F.lit((1 << HALF) - 1))
    high = F.shiftrightunsigned(node, HALF)
    keys = []
    for side, segment in enumerate((low, high)):
        for bit in range(HALF):
            masked = segment.bitwiseAND(F.lit(((1 << HALF) - 1) ^ (1 << bit)))
            keys.append(masked.bitwiseOR(F.lit((side * HALF + bit) << HALF)))
    return F.array(*keys)


def forest(left: np.ndarray, right: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links between the two blocks (or within one) that join what was not joined yet."""
    nodes = np.concatenate([left, right]) if right is not left else left
    offset = len(left) if right is not left else 0
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a, b = [], []
    for i in range(len(left)):
        near = np.flatnonzero(np.bitwise_count(left[i] ^ right) <= distance) + offset
        for j in near.tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[x] = y
                a.append(i)
                b.append(j)
    return nodes[a].view(np.int64).tolist(), nodes[b].view(np.int64).tolist()


def block_links(distance: int):
    """Streams rows sorted by bucket and pair of blocks; holds two blocks at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def close(rows: dict[int, list[np.ndarray]], pair: tuple) -> tuple[list[int], list[int]]:
        _, x, y = pair
        left = np.concatenate(rows[x]).view(np.uint64) if x in rows else np.zeros(0, np.uint64)
        right = left if x == y else (np.concatenate(rows[y]).view(np.uint64) if y in rows else np.zeros(0, np.uint64))
        return forest(left, right, distance) if len(left) and len(right) else ([], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_pair, rows = None, {}
        a: list[int] = []
        b: list[int] = []
        for batch in batches:
            key, x, y, own, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(key):
                continue
            new = np.flatnonzero((np.diff(key) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            starts = [0, *new.tolist(), len(key)]
            for s, e in zip(starts, starts[1:]):
                pair = (int(key[s]), int(x[s]), int(y[s]))
                if pair != open_pair:
                    if open_pair:
                        found = close(rows, open_pair)
                        a += found[0]
                        b += found[1]
                    open_pair, rows = pair, {}
                for block in {pair[1], pair[2]}:
                    part = node[s:e][own[s:e] == block]
                    if len(part):
                        rows.setdefault(block, []).append(part)
            if len(a) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)
                a, b = [], []
        if open_pair:
            found = close(rows, open_pair)
            a += found[0]
            b += found[1]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def links(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints ``node`` that connect all linked ones."""
    if distance > 3:
        raise ValueError("two segments with one wildcard find up to three differing bits")
    # Counted, verified and joined from one exchange. A node has 64 keys, so no key has more
    # than a 64th of these rows. The filter is stated so that none is inferred by branch.
    keyed = nodes.select(F.explode(variants(F.col("node"))).alias("key"), "node").filter("key is not null")
    keyed = keyed.repartition("key")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = sizes.filter("n = 2").filter(apart <= distance).select("a", "b")
    large = sizes.filter("n > 2").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = keyed.join(large, "key")
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    rows = rows.withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("key", "own", "node", other.alias("other"))
    x, y = F.least("own", "other"), F.greatest("own", "other")
    dealt = rows.select("key", x.alias("x"), y.alias("y"), "own", "node").repartition("key", "x", "y")
    found = dealt.sortWithinPartitions("key", "x", "y").mapInArrow(block_links(distance), "a long, b long")
    return pairs.unionByName(found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node connected with it, for all nodes of ``edges``.

    Alternating large-star and small-star steps; every step points nodes to the least
    neighbour known and is a grouped minimum and a join, so a node with many links is
    combined before the shuffle. Every round is written to the shared folder.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = materialise(small.filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    return found.unionByName(roots)


def cluster(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``text_hash``, ``node`` (the fingerprint as a signed long), ``component_id``
    and ``root`` (the least node connected) for every row.

    Reads doc_id and text. A null text counts as empty; texts without words share the
    fingerprint zero. ``component_id`` is the least non-null id of the component, null if
    there is none. Repeated rows are kept. An empty table gives an empty table.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    marked = materialise(add_fingerprint(rows, "text", "node", shingle))
    nodes = materialise(marked.groupBy("node").agg(F.min("doc_id").alias("first")))
    found = components(links(nodes, distance))
    rooted = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(rooted.join(least, "root").select("node", "component_id", "root"))
    return marked.join(named, "node")


def digest(docs: DataFrame) -> DataFrame:
    found = cluster(docs)
    hexed = F.lower(F.lpad(F.hex("node"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each component, that of the least id; columns unchanged.

    A row without an id stays only if no row of its component has one. Among different
    texts under the least id the one of least hash stays, of equal rows one.
    """
    found = cluster(docs, shingle, distance)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("_first")
    best = found.groupBy("root").agg(first).select(
        F.col("_first.doc_id").alias("_id"), F.col("_first.text_hash").alias("_hash")
    )
    best = best.select(F.col("_hash"), F.xxhash64("_id").alias("_named"))
    # Two keys that are never null. Equal rows are combined before the one exchange of the
    # texts, and the join finds them dealt by its own keys.
    taken = [*docs.columns, "_hash", "_named"]
    mark, name = fresh(taken, "_mark"), fresh(taken, "_name")
    rows = docs.withColumns({mark: F.xxhash64("text"), name: F.xxhash64("doc_id")}).dropDuplicates([mark, name])
    same = (F.col(mark) == F.col("_hash")) & (F.col(name) == F.col("_named"))
    return rows.join(best, same, "left_semi").drop(mark, name)
