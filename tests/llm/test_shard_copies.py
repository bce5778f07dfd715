"""Slots of a shard when one row has very many copies, and the shard choice recomputed."""

import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyworks.llm import queries, sharding

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_many_copies_are_numbered_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 500)
    docs = spark.range(20_000).select(
        F.when(F.col("id") < 12_000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") < 12_000, F.lit("same text")).otherwise(F.concat(F.lit("text "), "id")).alias("text"),
    )
    found = sharding.assign(docs, sharding.Tree.even(2, 3, 4))
    # So few rows would else be read by one task.
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        rows = found.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(setting)
    assert len(rows) == 20_000
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    copies = [r for r in rows if r["doc_id"] == 7 and r["size"] == 17]
    assert len(copies) >= 12_000 and len({r["shard"] for r in copies}) == 1
    # Consecutive slots, and no task has most of them.
    numbers = sorted(r["slot"] for r in copies[:])
    assert numbers == list(range(numbers[0], numbers[0] + len(numbers)))
    assert max(Counter(r["task"] for r in copies).values()) < 0.5 * len(copies)


def test_copies_of_rows_without_id_or_text(spark):
    docs = spark.createDataFrame([(None, None)] * 5 + [(None, "")] * 3 + [(1, None)] * 2, "doc_id long, text string")
    rows = sharding.assign(docs, sharding.Tree.even(1, 1, 2)).collect()
    assert len(rows) == 10
    for shard in {r["shard"] for r in rows}:
        held = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert held == list(range(len(held)))


def draw(key, node):
    bits = xxh64_intdigest(f"{node.name}/{key}".encode(), 42) & ((1 << 53) - 1)
    return -math.log((bits + 0.5) / float(1 << 53)) / node.weight if node.weight > 0 else math.inf


def by_hand(key, tree):
    """The least draw of each level, from the root down."""
    level = tree.branches
    while True:
        best = min(level, key=lambda n: draw(key, n))
        if not best.children:
            return best.shard
        level = best.children


@pytest.mark.parametrize("weights", [None, {0: 3.0, 5: 0.5}])
def test_shard_choice_follows_the_draws(spark, weights):
    keys = [str(i) for i in range(-50, 400)] + ["", "é日"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for tree in (sharding.Tree.even(2, 2, 3, weights), sharding.Tree.even(2, 2, 3, weights).grown(2.0)):
        found = {r["k"]: r["s"] for r in sharding.place(df, F.col("k"), tree, "s").collect()}
        assert found == {k: by_hand(k, tree) for k in keys}


def test_query_follows_the_draws(spark):
    rows = queries.QUERIES["op2_hash_tree_shards"](spark, FOLDER).collect()
    tree = sharding.Tree.even(2, 3, 4)
    for r in rows:
        assert (r["shard"], r["grown_shard"]) == (by_hand(str(r["doc_id"]), tree), by_hand(str(r["doc_id"]), tree.grown()))
