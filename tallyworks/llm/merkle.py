"""A Merkle tree over a data set, as a table of nodes with nested intervals.

Every row is a leaf with a rank in its group; a node carries the interval of leaf ranks it
covers, so one node is an ancestor of another if its interval contains the other's. Levels
are built bottom-up, ``ARITY`` neighbours to a parent. The trees' roots are the leaves of
one more tree, whose root stands for the data set.

``STRIDE`` levels form a bucket: the nodes that lie below one node of every ``STRIDE``-th
level share a row, so a row has a bounded size and a table ``ARITY ** STRIDE`` times fewer
rows than the one below. Ancestors are attached from the top down, by joining each item to
the bucket whose interval contains its own (equal group and bucket number, then
containment). Inside, the parent is found by its interval, and the siblings are what is
left of the parent's interval without the node's own. A bucket takes the path above it
along, so a leaf is joined once, however high the tree is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import id_crc, let, materialise, number_rows

ARITY = 3
STRIDE = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def whole(x: Column, width: Column | int) -> Column:
    """``x`` over ``width``, rounded down, for whole numbers from 0."""
    return ((x - x % width) / width).cast("long")


def digest_of(*parts: Column) -> Column:
    """Lowercase hex sha256 of the joined parts."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def leaf_of(fields: list[Column]) -> Column:
    """The digest of a row: each value after its number of bytes and a colon, ``-`` if null."""
    parts = []
    for c in fields:
        text = c.cast("string")
        sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(sized, F.lit("-")))
    return digest_of(*parts)


def joined(nodes: Column) -> Column:
    """Digest of the digests of some nodes."""
    return F.sha2(F.array_join(F.transform(nodes, lambda x: x["digest"]), ""), 256)


def parents(nodes: Column, arity: int) -> Column:
    """The next level over an array of neighbouring nodes."""

    def parent(i: Column) -> Column:
        run = lambda c: F.struct(
            F.element_at(c, 1)["lo"].alias("lo"), F.element_at(c, -1)["hi"].alias("hi"), joined(c).alias("digest")
        )
        return let(F.slice(nodes, i * arity + 1, arity), run)

    last = F.floor((F.size(nodes) - 1) / arity).cast("int")
    return F.transform(F.sequence(F.lit(0), last), parent)


def stride_of(nodes: DataFrame, below: int, arity: int, stride: int) -> DataFrame:
    """Buckets of ``stride`` levels over ``nodes`` (group, height, lo, hi, digest).

    ``nodes`` are those ``below`` levels over the leaves, without finished trees. A bucket
    has ``levels``, an array of nodes for each level from those given up to its own top.
    """
    width = arity ** (below + stride)
    here = F.struct("lo", "hi", "digest")
    rows = nodes.groupBy("group", "height", whole(F.col("lo"), width).alias("bucket")).agg(
        F.array_sort(F.collect_list(here)).alias("_0")
    )
    for k in range(stride):
        # A tree ends at its own height; the levels above stay as its root.
        rows = rows.withColumn(
            f"_{k + 1}", F.when(F.col("height") > below + k, parents(F.col(f"_{k}"), arity)).otherwise(F.col(f"_{k}"))
        )
    rows = materialise(rows)
    top = F.element_at(f"_{stride}", 1)
    return rows.select(
        "group", "height", "bucket", top["lo"].alias("lo"), top["hi"].alias("hi"), top["digest"].alias("digest"),
        F.array(*[F.col(f"_{k}") for k in range(stride + 1)]).alias("levels"),
    )


def height_of(n: Column, arity: int) -> Column:
    """Levels over ``n`` leaves: the least h with ``arity ** h`` at or above ``n``."""
    powers = [arity**h for h in range(1, 64) if arity**h < 1 << 63]
    return sum(((n > p).cast("int") for p in powers), (n > 1).cast("int"))


def build(leaves: DataFrame, arity: int = ARITY, stride: int = STRIDE) -> list[DataFrame]:
    """The tables of buckets over ``leaves`` (group, n, rank, digest), the lowest first.

    ``n`` is the number of leaves of the group. Groups with one leaf have one bucket.
    """
    nodes = leaves.select(
        "group", height_of(F.col("n"), arity).alias("height"),
        F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest",
    )
    highest = nodes.agg(F.max("height")).first()[0]
    if highest is None:
        return [stride_of(nodes, 0, arity, stride)]
    tables = []
    for below in range(0, max(highest, 1), stride):
        tables.append(stride_of(nodes, below, arity, stride))
        nodes = tables[-1].filter(F.col("height") > below + stride).select("group", "height", "lo", "hi", "digest")
    return tables


def roots(tables: list[DataFrame], stride: int = STRIDE) -> DataFrame:
    """``group`` and ``root`` of every tree."""
    found = None
    for i, table in enumerate(tables):
        done = table.filter(F.col("height") <= (i + 1) * stride)
        # A tree that ended lower has no bucket here.
        rows = done.select("group", F.col("digest").alias("root"))
        found = rows if found is None else found.unionByName(rows)
    return found


def steps(lo: Column, base: Column, levels: Column, height: Column, below: int, arity: int, stride: int) -> Column:
    """The siblings met on the way from the node at ``lo`` to the top of its bucket.

    For each level ``before`` and ``after``: the joined digests of the siblings whose
    intervals lie on either side of the node's, inside the parent's interval.
    """

    widths = F.array(*[F.lit(arity ** (below + k)).cast("long") for k in range(stride)])

    def step(k: Column) -> Column:
        width = F.get(widths, k)
        first = whole(lo - base, width * arity).cast("int") * arity
        own = base + whole(lo - base, width) * width
        run = F.slice(F.get(levels, k), first + 1, arity)
        side = lambda keep: F.array_join(F.transform(F.filter(run, keep), lambda x: x["digest"]), "")
        return F.struct(
            side(lambda x: x["hi"] <= own).alias("before"), side(lambda x: x["lo"] >= own + width).alias("after")
        )

    climbed = F.least(F.lit(stride), F.greatest(height - below, F.lit(0)))
    every = F.when(climbed > 0, F.transform(F.sequence(F.lit(0), climbed - 1), step))
    return F.coalesce(every, F.array().cast("array<struct<before:string,after:string>>"))


def climb(items: DataFrame, buckets: DataFrame, below: int, arity: int, stride: int) -> DataFrame:
    """Join ``items`` (group, lo, hi and more) to the bucket that contains them and add
    ``path``, the steps to the root, and ``tip``. ``buckets`` have those of their tops."""
    width = arity ** (below + stride)
    over = buckets.select(
        F.col("group").alias("_group"), F.col("bucket").alias("_bucket"), F.col("height").alias("_height"),
        F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("levels").alias("_levels"), F.col("path").alias("_above"),
        F.col("tip").alias("_tip"),
    )
    contains = (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
    same = (F.col("group") == F.col("_group")) & (whole(F.col("lo"), width) == F.col("_bucket"))
    inside = steps(F.col("lo"), F.col("_lo"), F.col("_levels"), F.col("_height"), below, arity, stride)
    found = items.join(over, same & contains)
    return found.withColumns({"path": F.concat(inside, "_above"), "tip": F.col("_tip")}).drop(*over.columns)


def attach(leaves: DataFrame, tables: list[DataFrame], above: DataFrame, arity: int = ARITY, stride: int = STRIDE) -> DataFrame:
    """Add ``path`` and ``tip`` to ``leaves`` (group, rank and more).

    ``above`` has ``group``, ``tip``, the root of its tree, and ``path``, the steps from there.
    """
    paths = None
    for i in reversed(range(len(tables))):
        table = tables[i]
        done = table.filter(F.col("height") <= (i + 1) * stride).join(above, "group")
        rest = table.filter(F.col("height") > (i + 1) * stride)
        rest = climb(rest, paths, (i + 1) * stride, arity, stride) if paths is not None else None
        paths = done if rest is None else done.unionByName(rest.select(done.columns))
    items = leaves.withColumns({"lo": F.col("rank"), "hi": F.col("rank") + 1})
    return climb(items, paths, 0, arity, stride).drop("lo", "hi")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda at, x: F.sha2(F.concat(x["before"], at, x["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Number the groups of ``rows`` and the rows in them.

    ``rows`` have group_key, order_key and leaf. The first table has every row with
    ``group``, ``n`` and ``rank``; the second has group, group_key and n.
    """
    # Equal rows are told apart, so that many of them are dealt to several tasks.
    ordered = rows.withColumn("_line", F.monotonically_increasing_id())
    placed = number_rows(ordered, ["group_key", "order_key", "leaf", "_line"], "_place")
    sizes = placed.groupBy("group_key").agg(F.count("*").alias("n"), F.min("_place").alias("_first"))
    groups = materialise(number_rows(sizes, ["group_key"], "group"))
    known = F.struct("group_key").alias("_key")
    joined_rows = placed.withColumn("_key", F.struct("group_key")).join(
        groups.select(known, "group", "n", "_first"), "_key"
    )
    rank = (F.col("_place") - F.col("_first")).alias("rank")
    kept = [c for c in rows.columns if c not in ("group_key", "order_key")]
    return joined_rows.select("group", "n", rank, *kept), groups.select("group", "group_key", "n")


def manifest(rows: DataFrame, arity: int = ARITY, stride: int = STRIDE) -> tuple[DataFrame, DataFrame]:
    """Leaves with their proofs, and all nodes.

    ``rows`` have ``group_key``, ``order_key`` (sortable; null comes first), ``leaf`` (a
    digest as hex text) and any other columns under names without a leading underscore.
    Leaves with equal keys are ordered by their digests; equal leaves are leaves of their
    own. The null group is a group and comes first.

    The first table has the rows with ``subroot``, ``root`` and ``path`` (from the leaf to
    the root, each step the siblings before and after). The second has a row for each node:
    ``tree`` (``group`` or ``top``), ``group``, ``level``, ``lo``, ``hi`` and ``digest``.
    An empty table gives two empty tables.
    """
    leaves, groups = ranked(rows)
    trees = build(leaves.withColumnRenamed("leaf", "digest"), arity, stride)
    total = groups.agg(F.count("*")).scalar()
    zero = F.lit(0).cast("long")
    subroots = roots(trees, stride)
    tops = materialise(
        subroots.select(zero.alias("group"), total.alias("n"), F.col("group").alias("rank"), F.col("root").alias("digest"))
    )
    top_trees = build(tops, arity, stride)
    root = roots(top_trees, stride)
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    start = root.select("group", F.col("root").alias("tip"), nothing.alias("path"))
    over = attach(tops, top_trees, start, arity, stride)
    above = materialise(over.select(F.col("rank").alias("group"), F.col("digest").alias("tip"), "path"))
    found = attach(leaves, trees, above, arity, stride).withColumnRenamed("tip", "subroot")
    found = found.withColumn("root", root.select("root").scalar()).drop("group", "n", "rank")
    return found, nodes_of(trees, stride, "group").unionByName(nodes_of(top_trees, stride, "top"))


def nodes_of(tables: list[DataFrame], stride: int, tree: str) -> DataFrame:
    """One row for each node of some trees."""
    found = None
    for i, table in enumerate(tables):
        listed = table.select("group", "height", F.posexplode("levels").alias("k", "_nodes"))
        level = F.col("k") + i * stride
        # The top of a bucket is the lowest level of the next; a finished tree repeats its root.
        listed = listed.filter((level <= F.col("height")) & ((F.col("k") < stride) | (level == F.col("height"))))
        rows = listed.select(
            F.lit(tree).alias("tree"), "group", level.cast("int").alias("level"), F.inline("_nodes")
        )
        found = rows if found is None else found.unionByName(rows)
    return found


def text_without_breaks(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def verify(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id",
    tampered: Callable[[dict[str, Column]], list[Column]] | None = None,
    arity: int = ARITY, stride: int = STRIDE,
) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and what a check of the row finds.

    Reads the ``fields``; other columns are ignored. Values are hashed as text (integers
    in decimals) and a null value differs from an empty one. ``tampered`` gives the fields
    as they are found at the time of the check; the proof is that of the given row.
    Result: ``order``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``
    and ``verified``. Repeated rows are leaves of their own; their proofs differ, and which
    of them has which is left open. An empty table gives an empty table.
    """
    own = {c: F.col(c) for c in fields}
    now = tampered(own) if tampered else list(own.values())
    rows = docs.select(
        F.col(group).alias("group_key"), F.col(order).alias("order_key"), F.col(order).alias("id"),
        leaf_of(list(own.values())).alias("leaf"), leaf_of(now).alias("found"),
    )
    found, _ = manifest(rows, arity, stride)
    folded = found.withColumn("folded_root", fold(F.col("found"), F.col("path")))
    return folded.select(
        F.col("id").alias(order), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The check of a data set in which some texts have lost their line breaks."""
    hit = id_crc() % 2 == 0

    def tampered(own: dict[str, Column]) -> list[Column]:
        text = F.when(hit, text_without_breaks(own["text"])).otherwise(own["text"])
        return list((own | {"text": text}).values())

    return verify(docs, tampered=tampered)
