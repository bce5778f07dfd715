"""Sharding by a hierarchical weighted hash tree.

A key descends three levels: region, rack and shard. At each level every child draws an
exponential variate from a hash of the key and the child's name, divided by the child's
weight, and the smallest draw wins, so a child gets keys in proportion to its weight and
needs no table of placements. Another weight for one shard changes only the draws of its
own rack and region: keys move into or out of these subtrees and nowhere else.

A shard added later is a branch of its own through the levels (``Tree.grown``): the weight
its region gains is drawn apart from the weight the region had, and keys won by the gain
follow the branch down to the new shard. So growth moves keys into the new shard only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import text_of

# Copies of one row that a task writes out.
COPIES = 1 << 16


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1


@dataclass(frozen=True)
class Tree:
    """``branches`` are the children of the root; all leaves are at the third level."""

    branches: tuple[Node, ...]
    size: int

    @staticmethod
    def even(regions: int, racks: int, shards: int, weights: dict[int, float] | None = None) -> Tree:
        """``regions * racks * shards`` shards numbered in order, of weight 1 or as given."""
        weights = weights or {}
        made: list[Node] = []
        for region in range(regions):
            held = []
            for rack in range(racks):
                first = (region * racks + rack) * shards
                leaves = tuple(
                    Node(f"shard {s}", weights.get(s, 1.0), (), s)
                    for s in range(first, first + shards)
                )
                held.append(Node(f"rack {region}.{rack}", sum(n.weight for n in leaves), leaves))
            made.append(Node(f"region {region}", sum(n.weight for n in held), tuple(held)))
        return Tree(tuple(made), regions * racks * shards)

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, on a branch of its own."""
        new = self.size
        leaf = Node(f"shard {new}", weight, (), new)
        rack = Node(f"rack of shard {new}", weight, (leaf,))
        region = Node(f"region of shard {new}", weight, (rack,))
        return Tree((*self.branches, region), new + 1)


def draw(key: Column, node: Node) -> Column:
    """Exponential with the node's weight as its rate; weight 0 never wins."""
    if node.weight <= 0:
        return F.lit(float("inf"))
    mask = (1 << 53) - 1
    bits = F.xxhash64(F.concat_ws("/", F.lit(node.name), key)).bitwiseAND(F.lit(mask))
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(node.weight))


def winner(key: Column, nodes: tuple[Node, ...], number: dict[str, int]) -> Column:
    if len(nodes) == 1:
        return F.lit(number[nodes[0].name])
    drawn = [
        F.struct(draw(key, n).alias("draw"), F.lit(number[n.name]).alias("node")) for n in nodes
    ]
    return F.least(*drawn)["node"]


def place(df: DataFrame, key: Column, tree: Tree, into: str) -> DataFrame:
    """Add ``into`` (int), the shard of each row; an existing column of the name is replaced.

    ``key`` is a string; null counts as the empty string, and equal keys share a shard.
    """
    level = tree.branches
    number = {n.name: i for i, n in enumerate(level)}
    df = df.withColumn("_node", winner(F.coalesce(key, F.lit("")), level, number))
    while level[0].children:
        below = tuple(c for n in level for c in n.children)
        leaf = below[0].shard >= 0
        inner = {n.name: n.shard if leaf else i for i, n in enumerate(below)}
        step = None
        for i, n in enumerate(level):
            chosen = winner(F.coalesce(key, F.lit("")), n.children, inner)
            step = F.when(F.col("_node") == i, chosen) if step is None else step.when(F.col("_node") == i, chosen)
        df = df.withColumn("_node", step)
        level = below
    return df.withColumn(into, F.col("_node").cast("int")).drop("_node")


def number_slots(df: DataFrame, shard: str, key: Column, order: list[str], into: str, cells: int = 1024) -> DataFrame:
    """Add ``into`` (long), gapless from 0 in every shard.

    Equal rows are counted first, on the map side too, and get consecutive numbers. The
    different rows of a shard are dealt to ``cells`` cells by a hash of the key; each cell
    starts after the rows of the cells before it, so a task sorts one cell of one shard,
    never a shard. ``order`` settles the order within a cell and must tell different rows
    apart. Many copies are written out again by several tasks, ``COPIES`` rows at a time.
    """
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64(F.lit("slot"), key), F.lit(cells)).cast("int"))
    sizes = rows.groupBy(shard, "_cell").agg(F.sum("_copies").alias("_n"))
    start = F.sum("_n").over(Window.partitionBy(shard).orderBy("_cell")) - F.col("_n")
    starts = sizes.select(F.col(shard).alias("_s"), F.col("_cell").alias("_c"), start.alias("_start"))
    along = Window.partitionBy(shard, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_inner", F.sum("_copies").over(along) - F.col("_copies")).join(
        starts, (F.col(shard) == F.col("_s")) & (F.col("_cell") == F.col("_c"))
    )
    zero = F.lit(0).cast("long")
    parts = F.sequence(zero, F.floor((F.col("_copies") - 1) / COPIES))
    dealt = placed.withColumn("_part", F.explode(parts)).repartition("_cell", shard, "_part")
    last = F.least(F.lit(COPIES).cast("long"), F.col("_copies") - F.col("_part") * COPIES) - 1
    found = dealt.withColumn("_copy", F.explode(F.sequence(zero, last)))
    number = F.col("_start") + F.col("_inner") + F.col("_part") * COPIES + F.col("_copy")
    return found.withColumn(into, number).select(*df.columns, into)


def assign(docs: DataFrame, tree: Tree) -> DataFrame:
    """Shard, slot and the shard after growth by one, for each document.

    Reads ``doc_id`` and ``text`` only, other columns are left out. The id written as
    text is the key; null ids share the key of an empty text, a null text has no bytes.
    Repeated rows get one slot each. An empty table gives an empty table.
    """
    key = F.col("doc_id").cast("string")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text_of()) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text_of()).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = place(rows, key, tree, "shard")
    rows = place(rows, key, tree.grown(), "grown_shard")
    slot_key = F.struct("doc_id", "text_crc32", "size")
    rows = number_slots(rows, "shard", slot_key, ["doc_id", "text_crc32", "size"], "slot")
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
