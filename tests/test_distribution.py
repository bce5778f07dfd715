"""Order statistics and group joins against brute force, with ties, nulls and skew."""

import math
import random

import numpy as np
import pytest

from tallyworks.operators import distribution as dist

PROBS = {"_10": 0.1, "_25": 0.25, "": 0.5, "_90": 0.9, "_max": 1.0, "_min": 0.0}


def skewed(seed, n=3000):
    """A third of the rows in one group and a third of those with one value."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        group = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", None])
        value = rng.choice([None, 5.0, 5.0, round(rng.gauss(0, 30), 1), -0.0])
        data.append((group, value, rng.randrange(5)))
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_equal_numpy(spark, seed):
    data = skewed(seed)
    df = spark.createDataFrame(data, "g string, x double, k int").repartition(7)
    result = dist.quantiles(df, ["g"], {"x": "x", "k": "k"}, PROBS)
    found = {r["g"]: r for r in result.collect()}
    assert set(found) == {"hot", "a", "b", None}
    for g in found:
        for name, i in (("x", 1), ("k", 2)):
            values = [r[i] for r in data if r[0] == g and r[i] is not None]
            for suffix, p in PROBS.items():
                assert found[g][name + suffix] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_quantiles_of_whole_table_and_many_distinct_values(spark):
    # Far more distinct values than the sample behind the bucket edges holds.
    df = spark.range(20_000).selectExpr("cast(id * 7919 % 20011 as double) AS x")
    found = dist.quantiles(df, [], {"x": "x"}, {"": 0.5, "_p99": 0.99}).collect()[0]
    values = [i * 7919 % 20011 for i in range(20_000)]
    assert found["x"] == np.quantile(values, 0.5)
    assert found["x_p99"] == pytest.approx(np.quantile(values, 0.99))


def test_quantiles_beside_infinite_values(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),)], "x double")
    found = dist.quantiles(df, [], {"x": "x"}, {"": 0.5, "_max": 1.0}).collect()[0]
    assert (found["x"], found["x_max"]) == (1.0, float("inf"))


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "g string, x double")
    assert [tuple(r) for r in dist.quantiles(df, ["g"], {"x": "x"}).collect()] == [("b", 1.0)]


def test_sketch_quantiles_are_near(spark):
    df = spark.range(10_000).selectExpr("cast(id as double) AS x")
    found = dist.quantiles(df, [], {"x": "x"}, exact=False).collect()[0]["x"]
    assert abs(found - 4999.5) < 10


def test_buckets_are_balanced_and_ordered(spark):
    df = spark.range(30_000).selectExpr("cast(id as double) AS v", "1 AS n")
    rows = dist.with_bucket(df, "v", 64).collect()
    rows.sort(key=lambda r: r["v"])
    buckets = [r["_bucket"] for r in rows]
    assert buckets == sorted(buckets)
    sizes = np.bincount(buckets)
    assert len(sizes) == 65
    assert sizes.max() < 3 * 30_000 / 64


def test_modes_take_the_smallest_of_tied_values(spark, rows):
    data = [("a", "x", "q"), ("a", "y", "q"), ("a", "y", None), ("a", "x", None), ("b", None, "z")]
    df = spark.createDataFrame(data, "g string, c string, e string")
    assert rows(dist.modes(df, ["g"], ["c", "e"])) == [
        {"g": "a", "c": "x", "e": "q"},
        {"g": "b", "c": None, "e": "z"},
    ]


@pytest.mark.parametrize("seed", [2, 10_000])
def test_rank_rows_equals_competition_rank(spark, seed):
    rng = random.Random(seed)
    data = [(i, rng.choice([None, 1, 1, 1, rng.randrange(300)])) for i in range(2000)]
    df = spark.createDataFrame(data, "id int, m int")
    found = {r["id"]: r["place"] for r in dist.rank_rows(df, "m", "place").collect()}
    key = lambda m: -math.inf if m is None else m
    for i, m in data:
        assert found[i] == 1 + sum(key(other) > key(m) for _, other in data)


def test_rank_rows_within_groups(spark, rows):
    data = [("a", 5), ("a", 7), ("a", 7), (None, 1), (None, 2)]
    df = spark.createDataFrame(data, "g string, m int")
    assert rows(dist.rank_rows(df, "m", "place", ["g"]), "g", "m", "place") == [
        {"g": "a", "m": 5, "place": 3},
        {"g": "a", "m": 7, "place": 1},
        {"g": "a", "m": 7, "place": 1},
        {"g": None, "m": 1, "place": 2},
        {"g": None, "m": 2, "place": 1},
    ]


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_attach_is_the_same_with_any_broadcast_limit(spark, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    data = skewed(3, 400)
    df = spark.createDataFrame(data, "g string, x double, k int")
    groups = df.groupBy("g").count().selectExpr("g", "count AS stat", "count AS n")
    found = dist.attach(df, groups, ["g"], "n").collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sizes = {g: sum(r[0] == g for r in data) for g in {r[0] for r in data}}
    assert len(found) == len(data)
    assert all(r["stat"] == sizes[r["g"]] for r in found)
    assert found[0].asDict().keys() == {"g", "x", "k", "stat"}


def test_combine_keeps_null_groups_and_missing_parts(spark, rows):
    a = spark.createDataFrame([("x", 1), (None, 2)], "g string, n int")
    b = spark.createDataFrame([("x", 0.5)], "g string, m double")
    assert rows(dist.combine(["g"], a, b)) == [
        {"g": "x", "n": 1, "m": 0.5},
        {"g": None, "n": 2, "m": None},
    ]


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([("p", "a", 3), ("p", "b", 1), (None, "a", 5)], "p string, c string, n int")
    assert sum(r["share"] for r in dist.share_of_total(df, "n").collect()) == pytest.approx(1)
    within = {(r["p"], r["c"]): r["share"] for r in dist.share_within(df, "n", ["p"]).collect()}
    assert within == {("p", "a"): 0.75, ("p", "b"): 0.25, (None, "a"): 1.0}
