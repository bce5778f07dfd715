"""One rule each for missing users, outcomes and NaN, and bounds given as times."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import tier
from tallyworks.operators import (
    activity, bootstrap, catering, charts, delivery, distribution, estate, experiment, quality, rating, scope, stored,
    summary, tickets,
)


@pytest.fixture(scope="module")
def actions(spark):
    data = [(1, "2024-01-01", 1, "a"), (1, "2024-01-01", 2, "a"), (1, "2024-01-02", 3, "a"), (2, "2024-01-01", 4, "b")]
    data += [(None, "2024-01-01", 5, "a"), (None, "2024-01-03", 6, "b")]
    df = spark.createDataFrame(data, "u int, day string, o int, g string")
    return df.withColumn("ts", F.to_timestamp_ntz("day", F.lit("yyyy-MM-dd")))


def test_no_metric_counts_a_missing_user(actions):
    assert delivery.repeat_purchase_rate(actions, "u", "o").first()[:2] == (2, 1)
    assert {r["cohort_size"] for r in delivery.retention(actions, "u", "ts", "day").collect()} == {2}
    assert delivery.dau(actions, "u", "ts").count() == 2
    assert delivery.conversion(actions, "u", "ts", F.lit(True)).count() == 2
    assert experiment.overlap(actions, "g", "u").first()["users"] == 2
    tested = experiment.srm(actions, "g", "u", "a", "b").first()
    assert (tested["users_a"], tested["users_b"]) == (1, 1)
    assert {r["u"] for r in experiment.sessions(actions, "u", "ts", 3600, {}).collect()} == {1, 2}


def test_users_of_several_groups_are_excluded(spark):
    data = [(1, "a", 1), (1, "b", 2), (2, "a", 3), (2, "a", 4), (3, "b", 5), (None, "a", 6), (4, None, 7)]
    df = spark.createDataFrame(data, "u int, g string, v int")
    assert sorted(r["v"] for r in experiment.exclusive(df, "g", "u").collect()) == [3, 4, 5]


def test_missing_outcomes_are_left_out(spark):
    data = [("a", True, 1), ("a", None, 2), ("a", False, 3), ("b", True, 4), ("b", True, 5)]
    df = spark.createDataFrame(data, "g string, s boolean, u int")
    for cluster in (None, "u"):
        assert experiment.two_proportion_z(df, "g", "s", "a", "b", cluster=cluster).first()["n_a"] == 2
    assert experiment.sample_size(df.filter("g = 'a'"), "s", 0.1).first()["baseline"] == 0.5


def test_targets_that_cannot_be_tested(spark):
    df = spark.createDataFrame([(True,), (False,)], "s boolean")
    assert experiment.sample_size(df, "s", 0.9).first()["n_per_group"] is None
    assert experiment.sample_size(df, "s", -0.5).first()["n_per_group"] is None
    assert experiment.sample_size(df, "s", 0.1).first()["n_per_group"] > 0
    with pytest.raises(ValueError):
        experiment.sample_size(df, "s", 0)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_bounds_with_a_time(spark, kind):
    data = [("2021-06-30 11:00:00",), ("2021-06-30 12:00:00",), ("2021-06-30 13:00:00",), ("2021-07-01 11:00:00",)]
    df = spark.createDataFrame(data, "t string").select(F.col("t").cast(kind))
    assert scope.in_period(df, "t", "2021-06-30", datetime(2021, 6, 30, 12)).count() == 2
    assert scope.in_period(df, "t", "2021-06-30 12:00:00", "2021-06-30").count() == 2
    assert scope.in_period(df, "t", "2021-06-30", "2021-06-30").count() == 3
    days = df.select(F.to_date("t").alias("t"))
    assert scope.in_period(days, "t", "2021-06-30 10:00:00", datetime(2021, 6, 30, 12)).count() == 3


def test_nan_is_missing(spark):
    values = [(float("nan"),), (1.0,), (15.0,), (float("inf"),), (float("-inf"),), (None,)]
    df = spark.createDataFrame(values, "x double")
    assert [r["n"] for r in charts.histogram(df, "x", 0, 20, 2).collect()] == [2, 2]
    labels = df.select(tier(F.col("x"), [10], ["low", "high"]).alias("t"))
    assert [r["t"] for r in labels.collect()] == [None, "low", "high", "high", "low", None]
    data = [("g", float(i)) for i in range(9)] + [("g", float("nan"))]
    box = charts.boxplot(spark.createDataFrame(data, "g string, x double"), "x", ["g"]).first()
    assert (box["q2"], box["outliers"], box["n"]) == (4.0, 0, 9)


NAN = float("nan")
# Group, value, second value, user: the rows with NaN or without a user must change nothing.
KNOWN = [("a", float(i % 7), float(i % 5), i % 6) for i in range(40)] + [("b", float(i % 9), float(i), 10 + i % 4) for i in range(30)]
MISSING = [("a", NAN, 1.0, 3), ("b", NAN, 2.0, 11), ("a", NAN, 3.0, 4)]
ORPHANS = [("a", 3.0, 1.0, None), ("b", 1.0, 2.0, None)]
ROWS = "g string, x double, y double, u int"

VALUE_OPERATORS = {
    "welch": lambda d: experiment.welch(d, "g", "x", "a", "b"),
    "mann_whitney": lambda d: experiment.mann_whitney(d, "g", "x", "a", "b"),
    "quantiles": lambda d: distribution.quantiles(d, ["g"], {"q": "x"}, {"1": 0.1, "9": 0.9}),
    "quantiles_sketched": lambda d: distribution.quantiles(d, ["g"], {"q": "x"}, exact=False),
    "rank_correlation": lambda d: distribution.rank_correlation(d, "x", "y", ["g"]),
    "relation": lambda d: catering.relation(d, "x", "y", ["g"]),
    "relation_turned": lambda d: catering.relation(d, "y", "x", ["g"]),
    "rating_by_check": lambda d: catering.rating_by_check(d, "x", "y", 0, 10, 5),
    "rating_of_nan": lambda d: catering.rating_by_check(d.withColumn("c", F.lit(1)), "c", "x", 0, 10, 5),
    "scatter_bins": lambda d: charts.scatter_bins(d, "x", "y", 4, 4),
    "series_sum": lambda d: charts.series(d, "g", "x", "sum"),
    "series_count": lambda d: charts.series(d, "g", "x", "count"),
    "series_max": lambda d: charts.series(d, "g", "x", "max"),
    "leaders": lambda d: rating.leaders(d, "g", "x", 3),
    "top_k": lambda d: summary.top_k(d, "x", 4, ["u", "y"]),
    "top_k_column": lambda d: summary.top_k(d, F.col("x"), 4, ["u", "y"]),
    "avg_length": lambda d: summary.avg_length(d, ["g"], "x"),
    "totals": lambda d: summary.totals_with_share(d, ["g"], "x"),
    "price_profile": lambda d: tickets.price_profile(d, ["g"], "x"),
    "histogram": lambda d: charts.histogram(d, "x", 0, 10, 5, ["g"]),
    "boxplot": lambda d: charts.boxplot(d, "x", ["g"]),
    "value_state": lambda d: stored.quantiles_of(stored.value_state(d.withColumn("d", F.lit("2024-01-01").cast("date")), ["g"], "d", "x"), ["g"], {"q": 0.5}),
    "bootstrap": lambda d: bootstrap.bootstrap_ratio(d, "g", "u", "x", "y", "a", "b", replicates=20),
}


def listed(df):
    """Rows in a fixed order, doubles to nine digits: their sums depend on the order of rows."""
    short = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted((tuple(map(short, r)) for r in df.select(sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(VALUE_OPERATORS))
def test_a_value_that_is_nan_changes_nothing(spark, name):
    plain = spark.createDataFrame(KNOWN, ROWS)
    more = spark.createDataFrame(KNOWN + MISSING, ROWS)
    null = spark.createDataFrame(KNOWN + [(g, None, y, u) for g, _, y, u in MISSING], ROWS)
    operator = VALUE_OPERATORS[name]
    expected = listed(operator(plain))
    assert "nan" not in repr(expected).lower()
    assert listed(operator(more)) == expected
    assert listed(operator(null)) == expected


MEASURE_OPERATORS = {
    # These count the rows too, of which there are more; only the measure is left out.
    "heterogeneity": (lambda d: quality.heterogeneity(d, "g", "x"), ["g", "mean", "cv", "p10", "p50", "p90"]),
    "category_detail": (lambda d: quality.category_detail(d, "g", "x"), ["g", "total", "median"]),
    "check_and_rating": (lambda d: catering.check_and_rating(d, ["g"], "x", "x"), ["g", "mean_rating", "median_check"]),
    "typical": (lambda d: estate.typical(d, ["g"], ["x"], []), ["g", "median_x"]),
    "market_value": (lambda d: estate.market_value(d, ["g"], "x", "y"), ["g", "median_price", "median_price_per_area"]),
    "by_distance": (lambda d: estate.by_distance(d, "y", [0, 100], ["g"], "x", "y", ["x"], []), ["g", "median_x", "median_price"]),
}


@pytest.mark.parametrize("name", sorted(MEASURE_OPERATORS))
def test_a_measure_that_is_nan_has_no_part(spark, name):
    operator, columns = MEASURE_OPERATORS[name]
    plain, more = (spark.createDataFrame(r, ROWS) for r in (KNOWN, KNOWN + MISSING))
    expected = listed(operator(plain).select(columns))
    assert listed(operator(more).select(columns)) == expected
    assert "nan" not in repr(expected).lower()


def test_counts_of_known_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", NAN), ("a", None), ("b", NAN)], "g string, x double")
    detail = {r["g"]: r for r in quality.category_detail(df, "g", "x").collect()}
    assert detail["a"]["filled_share"] == pytest.approx(1 / 3) and detail["b"]["filled_share"] == 0.0
    assert detail["b"]["total"] is None and detail["b"]["median"] is None
    for exact in (False, True):
        found = {r["column"]: r for r in quality.profile(df, exact).collect()}["x"]
        assert (found["nulls"], found["distinct_values"], found["min_value"], found["max_value"]) == (3, 1, "1.0", "1.0")


def test_nan_shares_the_last_place(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", NAN), ("c", None), ("d", 5.0)], "g string, x double")
    found = {r["g"]: (r["place"], r["x"]) for r in distribution.rank_rows(df, "x", "place").collect()}
    assert {g: p for g, (p, _) in found.items()} == {"d": 1, "a": 2, "b": 3, "c": 3}
    # The row itself keeps what it has.
    assert math.isnan(found["b"][1]) and found["c"][1] is None


def test_growth_from_nan_is_unknown(spark):
    df = spark.createDataFrame([(1, 2020, 5.0), (1, 2021, NAN), (1, 2022, 6.0), (1, 2023, 9.0)], "k int, y int, x double")
    found = {r["y"]: (r["x_growth"], r["x_from_loss"]) for r in rating.growth(df, "k", "y", "x").collect()}
    assert found == {2020: (None, False), 2021: (None, False), 2022: (None, False), 2023: (0.5, False)}


USER_OPERATORS = {
    "sessions_per_user": lambda d: experiment.sessions_per_user(d, "g", "u", "a", "b"),
    "clustered": lambda d: experiment.two_proportion_z(d.withColumn("s", F.col("x") > 3), "g", "s", "a", "b", cluster="u"),
    "duration": lambda d: experiment.duration(
        d.sparkSession.createDataFrame([(10,)], "n_per_group long"), d.withColumn("t", F.expr("date'2024-01-01' + u")), "u", "t"
    ),
    "bootstrap": lambda d: bootstrap.bootstrap_ratio(d, "g", "u", "x", "y", "a", "b", replicates=20),
    "overlap": lambda d: experiment.overlap(d, "g", "u"),
    "srm": lambda d: experiment.srm(d, "g", "u", "a", "b"),
    "activity": lambda d: activity.activity(d.withColumn("t", F.lit("2024-01-01").cast("date")), "u", "t", "2024-01-01", "2024-01-31"),
    "audience": lambda d: stored.audience_overlap(
        stored.audience_state(d.withColumn("t", F.lit("2024-01-01").cast("date")), ["g"], "t", "u"), "g", [("a", "b")]
    ),
}


@pytest.mark.parametrize("name", sorted(USER_OPERATORS))
def test_rows_without_a_user_change_nothing(spark, name):
    operator = USER_OPERATORS[name]
    plain, more = (spark.createDataFrame(r, ROWS) for r in (KNOWN, KNOWN + ORPHANS))
    assert listed(operator(more)) == listed(operator(plain))


def test_days_of_missing_users_do_not_count(spark):
    needed = spark.createDataFrame([(10,)], "n_per_group long")
    rows = [(1, "2024-01-01"), (2, "2024-01-02"), (None, "2024-03-01")]
    seen = spark.createDataFrame(rows, "u int, d string").withColumn("d", F.to_date("d"))
    assert experiment.duration(needed, seen, "u", "d").first()["observed_days"] == 2


def test_without_a_statistic_there_is_no_verdict(spark):
    # Groups without spread, without rows, and a statistic that is no number.
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, x double")
    one = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, x double")
    for df in (flat, one, flat.filter("g = 'a'"), flat.filter("false")):
        found = experiment.welch(df, "g", "x", "a", "b").first()
        assert (found["significant"], found["p_value"]) == (None, None)
    for value in (NAN, None):
        row = spark.createDataFrame([(value, 3.0)], "z double, df double")
        for freedom in (None, "df"):
            found = experiment.verdict(row, "z", 0.05, freedom).first()
            assert (found["significant"], found["p_value"]) == (None, None)
