"""Mixing sources to target weights by capped water-filling.

Each source has a weight and may be repeated up to a maximum number of epochs. Sources
whose share would exceed that are clamped to it, the rest of the budget is shared anew by
weight among the others, and so on until none is above. A source's target over its size
gives whole repetitions of all its documents and a fraction more, for which documents are
taken in a seeded hash order until the fraction is reached to within one document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.distribution import join_on

from .common import WORD, aside, materialise, number_rows, text_of

SEED = 20

def draw(seed: int) -> Column:
    """The seeded place of a document; equal rows share it."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))

def word_size() -> Column:
    return F.regexp_count(text_of(), F.lit(WORD)).cast("long")

def targets(sized: DataFrame, weights: Sequence[float], budget: float, epochs: float) -> DataFrame:
    """Per source: ``source_size`` and ``target``.

    Sources are ordered by code point, null last, and take the weights in turn. The list
    of sources stays a table. The level (words per unit of weight) only rises from one
    round to the next; a source is clamped when its cap is below level times weight. Each
    round is one aggregate over the list, and there are at most as many as sources.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = sizes.withColumn("_last", F.col("source").isNull())
    listed = number_rows(sizes, ["_last", "source"], "_place").drop("_last")
    turn = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int")
    )
    listed = materialise(
        listed.select("source", "source_size", turn.alias("_weight"), (F.col("source_size") * F.lit(float(epochs))).alias("_cap"))
    )
    total, level, clamped = None, 0.0, -1
    while True:
        above = F.col("_cap") < F.lit(level) * F.col("_weight")
        words, held, free, n = listed.agg(
            F.sum("source_size"),
            F.sum(F.when(above, F.col("_cap")).otherwise(0.0)),
            F.sum(F.when(above, 0.0).otherwise(F.col("_weight"))),
            F.sum(above.cast("long")),
        ).first()
        if n is None or n == clamped or not free:
            break
        total, clamped = budget * words, n
        level = max(level, (total - held) / free)
    target = F.least(F.col("_cap"), F.lit(level) * F.col("_weight"))
    return listed.select("source", "source_size", target.alias("target"))

def plan(
    sized: DataFrame, weights: Sequence[float], budget: float, epochs: float, cells: int = 4096
) -> DataFrame:
    """Per source: size, target, ``_whole`` repetitions, and where the fraction ends.

    ``sized`` has source, size and ``_draw``. The fraction's end is found in two steps:
    sums over ``cells`` ranges of draws tell the range that holds it, and only the rows of
    that range are added up one by one.
    """
    goals = targets(sized, weights, budget, epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("_whole", F.floor(ratio).cast("long"))
    goals = goals.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    goals = materialise(goals)
    shift = 64 - (cells - 1).bit_length()
    ranged = sized.withColumn("_range", F.shiftrightunsigned("_draw", shift))
    sums = ranged.groupBy("source", "_range").agg(F.sum("size").alias("_here"))
    running = F.sum("_here").over(Window.partitionBy("source").orderBy("_range"))
    sums = join_on(sums.withColumn("_before", running - F.col("_here")), goals.select("source", "_rest"), ["source"])
    holds = (F.col("_before") < F.col("_rest")) & (F.col("_rest") <= F.col("_before") + F.col("_here"))
    # Sums of doubles may end a hair beyond the last range; then all ranges are taken.
    edge = sums.filter(holds).select("source", "_range", (F.col("_rest") - F.col("_before")).alias("_left"))
    edge = materialise(edge)
    inside = join_on(ranged, edge, ["source", "_range"])
    inside = inside.groupBy("source", "_range", "_draw").agg(F.sum("size").alias("size"), F.first("_left").alias("_left"))
    so_far = F.sum("size").over(Window.partitionBy("source").orderBy("_draw"))
    taken = inside.withColumn("_mid", so_far - F.col("size") / 2).filter("_mid <= _left")
    ends = taken.groupBy("source").agg(F.max("_draw").alias("_end"))
    found = join_on(goals, edge.select("source", F.col("_range").alias("_edge")), ["source"], "left")
    return materialise(join_on(found, ends, ["source"], "left"))

def copies(cells: int = 4096) -> Column:
    """How often a row joined with its source's plan is taken."""
    shift = 64 - (cells - 1).bit_length()
    here = F.shiftrightunsigned("_draw", shift)
    extra = (
        F.when(F.col("_rest") <= 0, False)
        .when(F.col("_edge").isNull(), True)
        .when(here != F.col("_edge"), here < F.col("_edge"))
        .otherwise(F.coalesce(F.col("_draw") <= F.col("_end"), F.lit(False)))
    )
    return F.col("_whole") + extra.cast("long")

def size_up(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The narrow table that the plan is made from, written once."""
    return materialise(docs.select("doc_id", "source", word_size().alias("size"), draw(seed).alias("_draw")))

def shares(docs: DataFrame, weights: Sequence[float], budget: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """How much of each document the mix takes.

    Reads doc_id, text and source; a null text has no words, null is a source like any
    other, equal rows are taken alike. Documents without words are taken as often as their
    draw says, which adds nothing. An empty table gives an empty table.
    """
    sized = size_up(docs)
    mixed = join_on(sized, plan(sized, weights, budget, epochs), ["source"])
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target",
        copies().alias("copies"), (copies() * F.col("size")).alias("taken"),
    )

def mix(docs: DataFrame, weights: Sequence[float], budget: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """The documents of the mix, each as many times as it is taken, columns unchanged."""
    named, back = aside(docs, "doc_id", "text", "source")
    planned = plan(size_up(docs), weights, budget, epochs)
    rows = join_on(named.withColumn("_draw", draw(SEED)), planned.drop("source_size", "target"), ["source"])
    times = F.explode(F.array_repeat(F.lit(0), copies().cast("int")))
    return back(rows.withColumn("_time", times))
