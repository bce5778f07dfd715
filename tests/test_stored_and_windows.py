"""Stored states: activity bitmaps, dashboards, quantiles and audiences, against plain counts."""

import random
import re
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import activity, charts, delivery, stored
from tests_support import final_plan

FIRST, LAST = "2024-01-15", "2024-04-30"
BEGIN, END = date.fromisoformat(FIRST), date.fromisoformat(LAST)


def actions(seed, users=60, n=700):
    draw = random.Random(seed)
    rows = [(draw.choice([None, *range(users)]), BEGIN + timedelta(days=draw.randrange(-5, 115))) for _ in range(n)]
    # One user owns a third of the actions.
    return rows + [(7, BEGIN + timedelta(days=draw.randrange(0, 100))) for _ in range(n // 2)]


@pytest.fixture(scope="module")
def told():
    return actions(1)


@pytest.fixture(scope="module")
def seen(spark, told):
    df = spark.createDataFrame(told, "u int, d date").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    return df


def days_of(told):
    found = defaultdict(set)
    for user, d in told:
        if user is not None and BEGIN <= d <= END:
            found[user].add(d)
    return found


def test_bitmaps_hold_the_active_days(seen, told):
    state = activity.activity(seen, "u", "ts", FIRST, LAST)
    n = (END - BEGIN).days + 1
    rows = state.select("u", activity.active_indexes(F.col("active"), n).alias("at"), F.size("active").alias("w")).collect()
    assert {r["u"]: {BEGIN + timedelta(days=i) for i in r["at"]} for r in rows} == days_of(told)
    assert {r["w"] for r in rows} == {2}


@pytest.mark.parametrize("ages", [1, 30, 200])
def test_retention_of_all_ages(seen, told, ages):
    state = activity.activity(seen, "u", "ts", FIRST, LAST)
    found = activity.retention_all(state, FIRST, LAST, ages)
    cohorts = defaultdict(list)
    for days in days_of(told).values():
        cohorts[min(days)].append(days)
    expected = {
        (c, age): (sum(c + timedelta(days=age) in days for days in users), len(users))
        for c, users in cohorts.items()
        for age in range(min(ages, (END - c).days) + 1)
    }
    assert {(r["cohort"], r["age"]): (r["users"], r["cohort_size"]) for r in found.collect()} == expected
    assert all(r["retention"] == r["users"] / r["cohort_size"] for r in found.collect())


def test_retention_agrees_with_the_window_form(seen):
    within = seen.filter(F.col("d").between(FIRST, LAST))
    state = activity.activity(seen, "u", "ts", FIRST, LAST, "month")
    found = activity.retention_all(state, FIRST, LAST, 12, "month").filter("users > 0")
    other = delivery.retention(within, "u", "ts")
    columns = ["cohort", "age", "users", "cohort_size", "retention"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, other.select(columns).collect()))


def test_rolling_users(seen, told):
    state = activity.activity(seen, "u", "ts", FIRST, LAST)
    windows = [1, 2, 7, 28, 300]
    found = {r["period"]: r for r in activity.rolling_users(state, FIRST, LAST, windows).collect()}
    held = days_of(told)
    assert len(found) == (END - BEGIN).days + 1
    for d, row in found.items():
        for w in windows:
            active = sum(any(timedelta(0) <= d - x < timedelta(days=w) for x in days) for days in held.values())
            assert row[f"users_{w}"] == active, (d, w)


def test_activity_is_shuffled_once_by_user(spark, tmp_path, seen):
    path = str(tmp_path / "seen")
    seen.write.parquet(path)
    state = activity.activity(spark.read.parquet(path), "u", "ts", FIRST, LAST)
    assert final_plan(state).count("Exchange hashpartitioning") == 1
    plan = final_plan(activity.retention_all(state, FIRST, LAST, 30))
    # By user, by cohort and age, by cohort.
    assert plan.count("Exchange hashpartitioning(u") == 1
    assert plan.count("FileScan") == 1
    assert "partial_bit_or" in plan or "bit_or" in plan


def test_activity_tables_merge(seen, told):
    parts = [seen.filter(c) for c in ("day(d) < 10", "day(d) >= 10")]
    states = [activity.activity(p, "u", "ts", FIRST, LAST) for p in parts]
    merged = activity.merge(states[0].unionByName(states[1]), "u")
    whole = activity.activity(seen, "u", "ts", FIRST, LAST)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


def test_periods_that_cannot_be(seen):
    with pytest.raises(ValueError):
        activity.activity(seen, "u", "ts", LAST, FIRST)
    with pytest.raises(ValueError):
        activity.activity(seen, "u", "ts", FIRST, LAST, "hour")
    assert activity.activity(seen.filter("false"), "u", "ts", FIRST, LAST).count() == 0


@pytest.fixture(scope="module")
def sales(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sales") / "t")
    spark.range(40_000).selectExpr(
        "if(id % 3 = 0, 0, id % 5) AS city", "id % 4 AS kind", "if(id % 11 = 0, null, id * 7919 % 9001) AS u",
        "cast(id % 100 AS decimal(10,2)) AS v", "date'2024-01-01' + cast(id % 20 AS int) AS day",
    ).write.parquet(path)
    return spark.read.parquet(path)




def board(df, exact, subtotals="cube"):
    return charts.dashboard(
        df, ["city", "kind"], {"value": F.col("v")}, subtotals, {"users": F.col("u")}, {"per_user": ("value", "users")}, exact
    )


@pytest.mark.parametrize("subtotals", ["cube", "rollup"])
def test_sketched_dashboard_is_near_and_its_sums_are_exact(sales, subtotals):
    key = lambda r: (r["city"], r["kind"], r["level"])
    exact = {key(r): r for r in board(sales, True, subtotals).collect()}
    near = {key(r): r for r in board(sales, False, subtotals).collect()}
    assert exact.keys() == near.keys()
    for k, r in exact.items():
        assert (r["n"], r["value"]) == (near[k]["n"], near[k]["value"])
        assert abs(r["users"] - near[k]["users"]) <= 0.06 * r["users"] + 1
        assert near[k]["per_user"] == pytest.approx(float(r["value"]) / near[k]["users"])


def test_sketched_dashboard_expands_groups_only(sales):
    sketched, exact = final_plan(board(sales, False)), final_plan(board(sales, True))
    assert sketched.count("FileScan") == exact.count("FileScan") == 1
    # One Expand, for the subtotals, over what was added up by the dimensions.
    assert len(re.findall(r"\bExpand\b", sketched)) == 1
    assert len(re.findall(r"\bExpand\b", exact)) >= 1
    below = sketched[sketched.index("Expand") :]
    assert "Exchange hashpartitioning(city" in below and "hll_sketch_agg" in below
    assert "hashpartitioning(city" in below and "_distinct" not in sketched


def test_dashboard_states_of_several_days_merge(sales):
    args = (["city", "kind"], {"value": F.col("v")}, {"users": F.col("u")})
    whole = charts.dashboard_of(charts.dashboard_state(sales, *args), args[0], ["value"], ["users"])
    parts = [charts.dashboard_state(sales.filter(c), *args) for c in ("day < '2024-01-08'", "day >= '2024-01-08'")]
    merged = charts.dashboard_of(parts[0].unionByName(parts[1]), args[0], ["value"], ["users"])
    key = lambda r: (r["city"], r["kind"], r["level"])
    a, b = ({key(r): r for r in df.collect()} for df in (whole, merged))
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k]["n"], a[k]["value"]) == (b[k]["n"], b[k]["value"])
        assert abs(a[k]["users"] - b[k]["users"]) <= 0.02 * a[k]["users"] + 1


def test_a_group_without_values_counts_none(spark):
    df = spark.createDataFrame([("a", None), ("b", 3)], "g string, u int")
    found = charts.dashboard(df, ["g"], {}, distinct={"users": F.col("u")}, exact=False)
    assert {r["g"]: r["users"] for r in found.collect()} == {"a": 0, "b": 1, None: 1}


def share_of_rank(values, x):
    return sum(v < x for v in values) / len(values), sum(v <= x for v in values) / len(values)


def test_weekly_quantiles_from_daily_states(spark):
    draw = random.Random(4)
    rows = [
        (g, date(2024, 1, 1) + timedelta(days=draw.randrange(28)), draw.choice([draw.gauss(0, 1), 0.5, None, float("nan")]))
        for g in ("a", "b") for _ in range(8000)
    ]
    df = spark.createDataFrame(rows, "g string, d date, x double")
    state = stored.value_state(df, ["g"], "d", "x")
    assert state.count() == 56
    probs = {"low": 0.1, "mid": 0.5, "high": 0.9}
    for unit, period in (("week", lambda d: d - timedelta(days=d.weekday())), (None, None)):
        held = defaultdict(list)
        for g, d, x in rows:
            if x is not None and x == x:
                held[(g, period(d) if period else None)].append(x)
        found = stored.quantiles_of(state, ["g"], probs, unit).collect()
        assert len(found) == len(held)
        for r in found:
            values = held[(r["g"], r["period"] if unit else None)]
            assert (r["n"], r["least"], r["greatest"]) == (len(values), min(values), max(values))
            for name, p in probs.items():
                below, upto = share_of_rank(values, r[name])
                assert below - 0.02 <= p <= upto + 0.02


def test_boxes_from_daily_states(spark):
    rows = [("a", date(2024, 1, 1 + i % 9), float(i % 100)) for i in range(2000)] + [("a", date(2024, 1, 3), 900.0)]
    state = stored.value_state(spark.createDataFrame(rows, "g string, d date, x double"), ["g"], "d", "x")
    (box,) = stored.box_of(state, ["g"]).collect()
    assert abs(box["q1"] - 25) <= 3 and abs(box["q2"] - 50) <= 3 and abs(box["q3"] - 75) <= 3
    assert (box["low_beyond"], box["high_beyond"], box["greatest"]) == (False, True, 900.0)


@pytest.mark.parametrize("users", [3000, 60_000])
def test_overlap_of_audiences(spark, users):
    # Small audiences are exact; large ones keep to four standard errors.
    df = spark.range(users).selectExpr(
        "id AS u", "date'2024-01-01' + cast(id % 5 AS int) AS d",
        "explode(filter(array(if(id % 2 = 0, 'x', null), if(id % 3 = 0, 'y', null), if(id % 5 = 0, 'z', null)), s -> s is not null)) AS s",
    ).unionByName(spark.createDataFrame([(None, date(2024, 1, 1), "x")], "u long, d date, s string"))
    state = stored.audience_state(df, ["s"], "d", "u")
    found = {(r["a"], r["b"]): r for r in stored.audience_overlap(state, "s", [("x", "y"), ("x", "z")]).collect()}
    for (a, p), (b, q) in [(("x", 2), ("y", 3)), (("x", 2), ("z", 5))]:
        x, y = {i for i in range(users) if i % p == 0}, {i for i in range(users) if i % q == 0}
        row, either = found[a, b], len(x | y)
        room = 0 if either <= 4096 else 4 * either / 64
        exact = {"users_a": x, "users_b": y, "both": x & y, "only_a": x - y, "only_b": y - x, "either": x | y}
        for name, members in exact.items():
            assert abs(row[name] - len(members)) <= room, (name, row[name], len(members))
        assert row["jaccard"] == pytest.approx(row["both"] / row["either"])
