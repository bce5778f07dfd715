"""Writing through a quality gate, replaced periods, checked joins, rank relations, tails
and intervals."""

import math
import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyworks import sources
from tallyworks.functions import hash32, student_tail
from tallyworks.operators import bootstrap, catering, distribution, experiment, quality, scope
from tests_support import final_plan

# Rules and the gate


@pytest.fixture
def prepared(spark):
    data = [(i, None if i % 10 == 0 else float(i), "x" if i % 4 else "") for i in range(100)]
    return spark.createDataFrame(data, "id int, amount double, name string")


@pytest.fixture
def rules(spark):
    return {"no_amount": F.col("amount").isNull(), "no_name": F.col("name") == "", "negative": F.col("amount") < 0}


def test_gate_splits_rows_and_counts_breaches(spark, prepared, rules, tmp_path):
    good, bad = f"{tmp_path}/good", f"{tmp_path}/bad"
    told = sources.save_checked(prepared, good, rules, bad, 0.5)
    expected = {r["rule"]: r["violations"] for r in quality.violations(prepared, rules).collect()}
    assert {k: told[k] for k in rules} == expected
    broken = {i for i in range(100) if i % 10 == 0 or i % 4 == 0}
    assert (told["rows"], told["quarantined"]) == (100, len(broken))
    kept = spark.read.parquet(good)
    assert kept.columns == prepared.columns
    assert {r["id"] for r in kept.collect()} == set(range(100)) - broken
    held = {r["id"]: set(r["broken_rules"].split("+")) for r in spark.read.parquet(bad).collect()}
    assert held == {
        i: {n for n, hit in (("no_amount", i % 10 == 0), ("no_name", i % 4 == 0)) if hit} for i in broken
    }
    assert sorted(os.listdir(tmp_path)) == ["bad", "good"]


def test_gate_refuses_too_many_breaches(spark, prepared, rules, tmp_path):
    good, bad = f"{tmp_path}/good", f"{tmp_path}/bad"
    with pytest.raises(sources.QualityError) as error:
        sources.save_checked(prepared, good, rules, bad, {"no_amount": 0.09, "no_name": 0.5})
    assert error.value.shares["no_amount"] == 0.1 and "no_amount" in str(error.value) and "no_name" not in str(error.value)
    assert os.listdir(tmp_path) == ["bad"]
    # A share at the limit passes, and rules without a limit never refuse.
    told = sources.save_checked(prepared, good, rules, f"{tmp_path}/bad2", {"no_amount": 0.1})
    assert told["no_name"] == 25


@pytest.mark.parametrize("which", ["all good", "all bad", "empty", "no rules"])
def test_gate_with_one_side_empty(spark, prepared, rules, tmp_path, which):
    df = {"all good": prepared.filter("id % 10 > 0 AND id % 4 > 0"), "all bad": prepared.filter("id % 4 = 0"),
          "empty": prepared.filter("false"), "no rules": prepared}[which]
    told = sources.save_checked(df, f"{tmp_path}/good", {} if which == "no rules" else rules, f"{tmp_path}/bad", 1.0)
    kept = spark.read.parquet(f"{tmp_path}/good").count()
    assert kept == told["rows"] - told["quarantined"]
    assert os.path.exists(f"{tmp_path}/bad") == (told["quarantined"] > 0)


def test_gate_reads_once_and_keeps_what_is_there(spark, prepared, rules, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    df = prepared.mapInArrow(seen, prepared.schema)
    sources.save_checked(df, f"{tmp_path}/good", rules, f"{tmp_path}/bad", 1.0)
    assert calls.value == 100
    with pytest.raises(FileExistsError):
        sources.save_checked(df, f"{tmp_path}/good", rules, f"{tmp_path}/other", 1.0)
    with pytest.raises(FileExistsError):
        sources.save_checked(df, f"{tmp_path}/third", rules, f"{tmp_path}/bad", 1.0)
    with pytest.raises(ValueError):
        sources.save_checked(df.withColumn("Broken_Rules", F.lit(1)), f"{tmp_path}/third", rules, f"{tmp_path}/more")
    with pytest.raises(ValueError):
        sources.save_checked(df, f"{tmp_path}/third", {"rows": F.lit(True)}, f"{tmp_path}/more")
    assert sorted(os.listdir(tmp_path)) == ["bad", "good"]


# One period of a saved result


SCHEMA = "ts timestamp_ntz, v int"


def months(spark, spec, start=0):
    rows = [(datetime(2024, m, 1 + i % 28, 5), start + 1000 * m + i) for m, n in spec.items() for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def files_of(path):
    return {
        os.path.join(folder, f): os.path.getmtime(os.path.join(folder, f))
        for folder, _, names in os.walk(path) for f in names if f.endswith(".parquet")
    }


def test_replacing_a_period_touches_its_folders_only(spark, tmp_path):
    path = f"{tmp_path}/saved"
    sources.save_by_period(months(spark, {1: 5, 2: 6, 3: 7, 4: 8}), path, "ts")
    before = files_of(path)
    new = months(spark, {2: 3}, start=50_000)
    assert sources.replace_period(new, path, "ts", "2024-02-01", "2024-03-31") == ["2024-03-01"]
    after = files_of(path)
    untouched = lambda fs: {f: t for f, t in fs.items() if "2024-01" in f or "2024-04" in f}
    assert untouched(after) == untouched(before) and len(untouched(before)) >= 2
    whole = sources.load_period(spark, path, SCHEMA, "ts", "2024-01-01", "2024-04-30")
    counts = {r["m"]: (r["count"], r["least"]) for r in whole.groupBy(F.month("ts").alias("m")).agg(F.count("*").alias("count"), F.min("v").alias("least")).collect()}
    assert counts == {1: (5, 1000), 2: (3, 52000), 4: (8, 4000)}


def test_a_result_can_replace_what_it_was_made_from(spark, tmp_path):
    path = f"{tmp_path}/saved"
    sources.save_by_period(months(spark, {1: 5, 2: 6}), path, "ts")
    old = sources.load_period(spark, path, SCHEMA, "ts", "2024-02-01", "2024-02-29")
    sources.replace_period(sources.materialise(old.withColumn("v", -F.col("v"))), path, "ts", "2024-02-01", "2024-02-29")
    found = sources.load_period(spark, path, SCHEMA, "ts", "2024-01-01", "2024-02-29")
    assert sorted(r["v"] for r in found.collect()) == sorted([-2000 - i for i in range(6)] + [1000 + i for i in range(5)])


def test_rows_outside_the_period_change_nothing(spark, tmp_path):
    path = f"{tmp_path}/saved"
    sources.save_by_period(months(spark, {1: 5, 2: 6}), path, "ts")
    before = files_of(path)
    for rows in (months(spark, {1: 1, 2: 1}), spark.createDataFrame([(None, 1)], SCHEMA)):
        with pytest.raises(Exception, match="outside"):
            sources.replace_period(rows, path, "ts", "2024-02-01", "2024-02-29")
    assert files_of(path) == before
    with pytest.raises(ValueError):
        sources.replace_period(months(spark, {2: 1}), path, "ts", "2024-02-01", "2024-02-28")


@pytest.mark.parametrize("unit,first,last", [("day", "2024-02-03", "2024-02-05"), ("week", "2024-02-05", "2024-02-18"), ("year", "2024-01-01", "2024-12-31")])
def test_units_of_a_period(spark, tmp_path, unit, first, last):
    path = f"{tmp_path}/saved"
    df = spark.range(366).selectExpr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,id) AS ts", "cast(id AS int) AS v")
    sources.save_by_period(df, path, "ts", unit)
    inside = F.to_date("ts").between(first, last)
    sources.replace_period(df.filter(inside).withColumn("v", F.lit(-1)), path, "ts", first, last, unit)
    found = sources.load_period(spark, path, SCHEMA, "ts", "2024-01-01", "2024-12-31", unit)
    assert found.count() == 366
    assert found.filter(F.col("v") == -1).count() == df.filter(inside).count() == found.filter(inside).filter("v = -1").count()


def test_periods_are_pruned(spark, tmp_path):
    path = f"{tmp_path}/saved"
    sources.save_by_period(months(spark, {m: 5 for m in range(1, 13)}), path, "ts")
    found = sources.load_period(spark, path, SCHEMA, "ts", "2024-03-10", "2024-04-20")
    plan = final_plan(found)
    assert "PartitionFilters: [isnotnull(period" in plan and "(period" in plan.split("PartitionFilters")[1].split("]")[0]
    assert all("2024-03" in f or "2024-04" in f for f in found.inputFiles()) or "2024-03-01" in plan
    # A filtered calendar prunes the folders when the query runs.
    spark.range(12).selectExpr("make_date(2024, cast(id + 1 AS int), 1) AS period", "id % 4 AS season").write.parquet(f"{tmp_path}/calendar")
    facts = spark.read.schema(SCHEMA + ", period date").parquet(path)
    calendar = spark.read.parquet(f"{tmp_path}/calendar")
    pruned = facts.join(calendar.filter("season = 1"), "period")
    assert "dynamicpruning" in final_plan(pruned)


# Joins that check their dimension


def test_a_repeated_key_is_an_error(spark):
    fact = spark.createDataFrame([(1,), (2,), (None,), (3,)], "k int")
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (None, "m")], "k int, name string")
    found = scope.enrich(fact, dim, ["k"])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, "a"), (2, "b"), (3, None), (None, None)], key=repr)
    twice = dim.union(spark.createDataFrame([(2, "c")], "k int, name string"))
    with pytest.raises(Exception, match="repeated in the dimension"):
        scope.enrich(fact, twice, ["k"]).collect()
    assert scope.enrich(fact, twice, ["k"], check=False).count() == 5
    assert scope.enrich(fact, dim.filter("false"), ["k"]).count() == 4


def test_the_check_leaves_join_and_facts_alone(spark, tmp_path):
    spark.range(5000).selectExpr("id % 50 AS k", "id AS v").write.parquet(f"{tmp_path}/fact")
    spark.range(50).selectExpr("id AS k", "id * 2 AS w").write.parquet(f"{tmp_path}/dim")
    fact, dim = spark.read.parquet(f"{tmp_path}/fact"), spark.read.parquet(f"{tmp_path}/dim")
    plain, checked = (final_plan(scope.enrich(fact, dim, ["k"], check=c)) for c in (False, True))
    assert "BroadcastHashJoin" in plain and "BroadcastHashJoin" in checked
    assert checked.count("/fact]") == plain.count("/fact]") == 1
    assert checked.count("Exchange hashpartitioning(v") == 0


# Relation by ranks


def ranks(values):
    order = sorted(values)
    return [(order.index(v) + len(order) - order[::-1].index(v) + 1) / 2 for v in values]


def spearman(x, y):
    r, s = ranks(x), ranks(y)
    m = (len(x) + 1) / 2
    top = sum((a - m) * (b - m) for a, b in zip(r, s))
    low = math.sqrt(sum((a - m) ** 2 for a in r)) * math.sqrt(sum((b - m) ** 2 for b in s))
    return top / low if low else None


@pytest.mark.parametrize("seed", range(3))
def test_rank_correlation_with_ties(spark, seed):
    draw = random.Random(seed)
    nan = float("nan")
    rows = []
    for g in ("a", "b", None):
        for _ in range(300):
            x = draw.choice([1.0, 1.0, draw.random(), draw.randrange(5), None, nan])
            rows.append((g, x, None if draw.random() < 0.05 else (x or 0) * draw.choice([1, -1, 2]) + draw.random()))
    rows += [("one", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)]
    df = spark.createDataFrame([(g, None if x is None else float(x), y) for g, x, y in rows], "g string, x double, y double")
    found = {r["g"]: r for r in distribution.rank_correlation(df, "x", "y", ["g"]).collect()}
    for g in ("a", "b", None, "one", "flat"):
        pairs = [(x, y) for h, x, y in rows if h == g and x is not None and y is not None and x == x and y == y]
        assert found[g]["n"] == len(pairs)
        expected = spearman(*zip(*pairs))
        assert found[g]["rho"] == (None if expected is None else pytest.approx(expected, abs=1e-12))


def test_rank_relation_of_perfect_and_tiny_groups(spark):
    rows = [("up", i, i * i) for i in range(8)] + [("down", i, -i) for i in range(8)] + [("two", 1, 1), ("two", 2, 2)]
    rows += [("mixed", i, (i * 7) % 10) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, x int, y int")
    found = {r["g"]: r for r in catering.rank_relation(df, "x", "y", ["g"]).collect()}
    assert (found["up"]["rho"], found["up"]["p_value"], found["up"]["significant"]) == (1.0, 0.0, True)
    assert (found["down"]["rho"], found["down"]["p_value"]) == (-1.0, 0.0)
    assert (found["two"]["p_value"], found["two"]["significant"]) == (None, None)
    rho = spearman(*zip(*[(x, y) for g, x, y in rows if g == "mixed"]))
    assert found["mixed"]["t"] == pytest.approx(rho * math.sqrt(8 / (1 - rho * rho)))
    assert 0 < found["mixed"]["p_value"] < 1


def test_rank_relation_with_one_hot_value_stays_balanced(spark):
    # A third of the rows share one check; no task may get them all.
    df = spark.range(60_000).selectExpr(
        "cast(if(id % 3 = 0, 7, id) AS double) AS x", "cast(id * 7919 % 60013 AS double) AS y"
    )
    plan = final_plan(distribution.rank_correlation(df, "x", "y", buckets=64))
    assert "Window" not in plan.split("Exchange SinglePartition")[0] or "SinglePartition" not in plan
    values = [(7.0 if i % 3 == 0 else float(i), float(i * 7919 % 60013)) for i in range(0, 60_000, 30)]
    part = spark.createDataFrame(values, "x double, y double")
    assert distribution.rank_correlation(part, "x", "y").first()["rho"] == pytest.approx(spearman(*zip(*values)), abs=1e-12)


# Student's tail


def tail_by_series(t, v):
    """The finite series for whole degrees of freedom."""
    angle = math.atan(t / math.sqrt(v))
    square = math.cos(angle) ** 2
    if v == 1:
        return 1 - 2 * angle / math.pi
    term, total = 1.0, 1.0
    even = v % 2 == 0
    for j in range(1, v // 2 if even else (v - 1) // 2):
        term *= square * ((2 * j - 1) / (2 * j) if even else 2 * j / (2 * j + 1))
        total += term
    if even:
        return 1 - math.sin(angle) * total
    return 1 - 2 / math.pi * (angle + math.sin(angle) * math.cos(angle) * total)


def test_student_tail(spark):
    pairs = [(t, v) for v in (1, 2, 3, 4, 7, 30, 101, 5000, 1_000_000) for t in (1e-4, 0.3, 1.0, 1.72, 1.74, 2.5, 6.0)]
    df = spark.createDataFrame([(float(t), float(v)) for t, v in pairs], "t double, v double")
    found = df.select("t", "v", student_tail(-F.col("t"), F.col("v")).alias("p")).collect()
    for r in found:
        assert r["p"] == pytest.approx(tail_by_series(r["t"], int(r["v"])), abs=1e-9)


def test_student_tail_of_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0.0, 3.0), (inf, 3.0), (nan, 3.0), (None, 3.0), (1.0, None), (1.0, 0.0), (1.0, nan), (2.0, 2.5)]
    df = spark.createDataFrame(rows, "t double, v double").coalesce(1)
    found = [r["p"] for r in df.select(student_tail(F.col("t"), F.col("v")).alias("p")).collect()]
    assert found[:7] == [1.0, 0.0, None, None, None, None, None]
    assert found[7] == pytest.approx(0.157391495, abs=1e-8)


def test_small_groups_use_students_tail(spark):
    data = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 7.0)]
    found = experiment.welch(spark.createDataFrame(data, "g string, x double"), "g", "x", "a", "b").first()
    # The normal tail would give 0.0017; with so few units it is not that rare.
    assert math.erfc(abs(found["t"]) / math.sqrt(2)) < 0.005 < 0.03 < found["p_value"] < 0.05
    few = [("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", 5.0)]
    found = experiment.welch(spark.createDataFrame(few, "g string, x double"), "g", "x", "a", "b", alpha=0.01).first()
    assert (found["t"], found["df"], found["significant"]) == (pytest.approx(18**0.5), 2.0, False)
    assert found["p_value"] == pytest.approx(tail_by_series(18**0.5, 2), abs=1e-12)


# Bootstrap


def hash_by_hand(*parts, seed=0):
    h = seed
    for part in parts:
        x = h ^ ((part ^ (part >> 32)) & 0xFFFFFFFF)
        for factor, shift in ((0x2C1B3C6D, 15), (0x297A2D39, 13)):
            x = x * factor & 0xFFFFFFFF
            x ^= x >> shift
        h = x
    return h


def test_hash32(spark):
    pairs = [(0, 0), (1, 2), (10**12 + 7, 3), (2**31, 2**32 - 1)]
    df = spark.createDataFrame(pairs, "a long, b long")
    found = [r["h"] for r in df.select(hash32(F.col("a"), F.col("b"), seed=9).alias("h")).collect()]
    assert found == [hash_by_hand(a, b, seed=9) for a, b in pairs]


def test_poisson_weights(spark):
    h = spark.range(100_000).select(hash32(F.col("id"), F.lit(5)).alias("h"))
    counts = {r["w"]: r["count"] / 100_000 for r in h.groupBy(bootstrap.poisson_weight(F.col("h")).alias("w")).count().collect()}
    for k in range(5):
        assert counts[k] == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.006)


def test_bootstrap_by_hand(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["a", "b", "c"]), draw.choice([None, *range(30)]), draw.randrange(3), 1) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, u int, s int, n int")
    found = bootstrap.bootstrap_ratio(df, "g", "u", "s", "n", "a", "b", replicates=50, seed=3).first()
    limits = bootstrap.poisson_thresholds()
    weight = lambda u, r: 1 if r == 0 else sum(hash_by_hand(u, r, seed=3) >= t for t in limits)

    def difference(r):
        total = {g: [sum(weight(u, r) * v for h, u, *vs in rows if h == g and u is not None for v in vs[k : k + 1]) for k in (0, 1)] for g in "ab"}
        return total["b"][0] / total["b"][1] - total["a"][0] / total["a"][1]

    drawn = sorted(difference(r) for r in range(1, 51))
    at = lambda p: drawn[int(49 * p)] + (49 * p - int(49 * p)) * (drawn[int(49 * p) + 1] - drawn[int(49 * p)])
    assert found["difference"] == pytest.approx(difference(0))
    assert (found["low"], found["high"], found["replicates"]) == (pytest.approx(at(0.025)), pytest.approx(at(0.975)), 50)
    assert found["significant"] == (found["low"] > 0 or found["high"] < 0)


def test_bootstrap_covers_where_sessions_depend(spark):
    # Users differ in their rate, so sessions of one user are alike; the true difference is zero.
    draw = random.Random(12)
    rows = []
    for sim in range(120):
        for u in range(80):
            rate = draw.betavariate(0.8, 0.8)
            sessions = draw.randrange(1, 12)
            rows.append((sim, "ab"[u % 2], u, sum(draw.random() < rate for _ in range(sessions)), sessions))
    df = spark.createDataFrame(rows, "sim int, g string, u long, s int, n int")
    found = bootstrap.bootstrap_ratio(df, "g", "u", "s", "n", "a", "b", by=["sim"], replicates=200, seed=5).collect()
    covered = sum(r["low"] <= 0 <= r["high"] for r in found) / len(found)
    assert len(found) == 120 and 0.87 <= covered <= 0.99
    # An interval that takes sessions as independent misses zero far more often.
    missed = 0
    for sim in range(120):
        total = {g: [sum(r[k] for r in rows if r[0] == sim and r[1] == g) for k in (3, 4)] for g in "ab"}
        p = {g: s / n for g, (s, n) in total.items()}
        error = math.sqrt(sum(p[g] * (1 - p[g]) / total[g][1] for g in "ab"))
        missed += abs(p["b"] - p["a"]) > 1.96 * error
    assert missed / 120 > 2 * (1 - covered)


def test_bootstrap_sees_a_difference(spark):
    rows = [("ab"[u % 2], f"user{u}", 3 * (u % 2) + u % 3, 4) for u in range(200)]
    df = spark.createDataFrame(rows, "g string, u string, s int, n int")
    args = (df, "g", "u", "s", "n", "a", "b")
    found = bootstrap.bootstrap_ratio(*args, replicates=100).first()
    assert found["significant"] and found["low"] > 0.6 and found["high"] < 0.9
    assert bootstrap.bootstrap_ratio(*args, replicates=100).first() == found
    assert bootstrap.bootstrap_ratio(*args, replicates=100, seed=2).first()["low"] != found["low"]
