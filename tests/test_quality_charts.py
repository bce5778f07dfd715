import pytest
from pyspark.sql import functions as F

from tallyworks.functions import text_key
from tallyworks.operators import charts, quality


def test_profile(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (2, "a")], "n int, s string")
    for exact in (True, False):
        found = [tuple(r) for r in quality.profile(df, exact).collect()]
        assert found == [("n", 3, 0, 2, "1", "2"), ("s", 3, 1, 2, "a", "b")]


def test_violations_and_copies(spark, rows):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("x", None), ("y", -1)], "t string, n int")
    found = quality.violations(df, {"negative": F.col("n") < 0, "never": F.lit(False)})
    assert rows(found) == [
        {"rule": "negative", "violations": 1, "share": 0.25},
        {"rule": "never", "violations": 0, "share": 0.0},
    ]
    assert rows(quality.copies(df, text_key("t"), "copy")) == [{"rule": "copy", "violations": 2, "share": 0.5}]


def test_heterogeneity_and_detail(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), (None, 5.0)], "c string, x double")
    uneven = {r["c"]: r for r in quality.heterogeneity(df, "c", "x").collect()}
    assert uneven["a"]["share"] == 0.75 and uneven["a"]["cv"] == pytest.approx(2 ** 0.5 / 2)
    assert uneven["a"]["p50"] == 2.0 and uneven[None]["cv"] is None
    assert rows(quality.category_detail(df, "c", "x")) == [
        {"c": "a", "n": 3, "filled_share": 2 / 3, "total": 4.0, "median": 2.0},
        {"c": None, "n": 1, "filled_share": 1.0, "total": 5.0, "median": 5.0},
    ]


def test_expect(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "d string")
    assert rows(quality.expect(df, 3, "d", 9)) == [
        {"rows": 3, "domain_size": 2, "rows_ok": True, "domain_ok": False},
    ]


def test_histogram_has_empty_bins_and_all_rows(spark):
    df = spark.createDataFrame([("a", -5.0), ("a", 0.0), ("a", 39.9), ("b", 99.0), ("b", None)], "g string, x double")
    whole = {r["bin"]: (r["bin_from"], r["n"]) for r in charts.histogram(df, "x", 0.0, 40.0, 4).collect()}
    assert whole == {0: (0.0, 2), 1: (10.0, 0), 2: (20.0, 0), 3: (30.0, 2)}
    grouped = charts.histogram(df, "x", 0.0, 40.0, 4, ["g"]).collect()
    assert len(grouped) == 8 and sum(r["n"] for r in grouped) == 4
    empty = charts.histogram(df.filter("x > 1000"), "x", 0.0, 40.0, 4).collect()
    assert [r["n"] for r in empty] == [0, 0, 0, 0]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_boxplot(spark, by):
    values = [1.0, 2.0, 2.0, 3.0, 4.0, 5.0, 6.0, 50.0, 50.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None)], "g string, x double")
    row = charts.boxplot(df, "x", by).collect()[0]
    assert (row["q1"], row["q2"], row["q3"]) == (2.0, 4.0, 6.0)
    assert (row["whisker_low"], row["whisker_high"], row["outliers"], row["n"]) == (1.0, 6.0, 2, 9)


def test_scatter(spark):
    df = spark.range(100).selectExpr("id", "cast(id as double) AS x", "cast(id % 10 as double) AS y")
    own = charts.scatter_bins(df, "x", "y", 5, 2).collect()
    assert sum(r["n"] for r in own) == 100 and {r["x_bin"] for r in own} == set(range(5))
    fixed = charts.scatter_bins(df, "x", "y", 2, 2, (0.0, 50.0), (0.0, 10.0)).collect()
    assert sum(r["n"] for r in fixed if r["x_bin"] == 1) == 75
    sample = {r["id"] for r in charts.scatter_sample(df, ["id"], 10).collect()}
    assert len(sample) == 10
    assert sample == {r["id"] for r in charts.scatter_sample(df.repartition(5), ["id"], 10).collect()}


def test_series(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0)], "c string, x double")
    assert rows(charts.series(df, "c", "x", "sum"))[0] == {"c": "a", "value": 3.0, "share": 0.75}
    assert rows(charts.series(df, "c", "x", "max"))[0] == {"c": "a", "value": 2.0}


@pytest.mark.parametrize("subtotals,levels", [("cube", {0, 1, 2, 3}), ("rollup", {0, 1, 3})])
def test_dashboard_subtotals(spark, subtotals, levels):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), (None, "x", 4)], "p string, q string, v int")
    found = charts.dashboard(df, ["p", "q"], {"v": F.col("v")}, subtotals).collect()
    assert {r["level"] for r in found} == levels
    total = [r for r in found if r["level"] == 3]
    assert [(r["n"], r["v"]) for r in total] == [(3, 7)]
    for level in levels:
        assert sum(r["n"] for r in found if r["level"] == level) == 3


def test_dashboard_distinct_and_ratios(spark):
    data = [("a", "x", 1, True), ("a", "x", 1, False), ("a", "y", 2, False), (None, "x", 1, True), (None, "x", None, True)]
    df = spark.createDataFrame(data, "p string, q string, u int, done boolean")
    found = charts.dashboard(
        df, ["p", "q"], {"done": F.col("done").cast("int")},
        distinct={"users": F.col("u"), "doers": F.when(F.col("done"), F.col("u"))},
        ratios={"cr": ("doers", "users")},
    ).collect()
    by = {(r["level"], r["p"], r["q"]): r for r in found}
    assert len(by) == len(found) == 8
    total = by[3, None, None]
    assert (total["n"], total["done"], total["users"], total["doers"], total["cr"]) == (5, 3, 2, 1, 0.5)
    assert (by[1, "a", None]["users"], by[1, None, None]["users"]) == (2, 1)
    assert by[0, "a", "y"]["cr"] == 0.0
