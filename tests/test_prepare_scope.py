from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import prepare, scope
from tallyworks.sources import INPUTS, load, materialise, save, shared_folder


def test_dedupe_keeps_the_newest_and_is_idempotent(spark, rows):
    df = spark.createDataFrame([(1, 1, "old"), (1, 3, "new"), (1, 2, "mid"), (2, 1, "one")], "k int, t int, v string")
    once = prepare.dedupe(df, ["k"], [F.desc("t"), F.asc("v")])
    expected = [{"k": 1, "t": 3, "v": "new"}, {"k": 2, "t": 1, "v": "one"}]
    assert rows(once) == expected
    assert rows(prepare.dedupe(once, ["k"], [F.desc("t"), F.asc("v")])) == expected


def test_dedupe_whole_rows_and_missing_order(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None)], "k int, v string")
    assert prepare.dedupe(df).count() == 2
    with pytest.raises(ValueError):
        prepare.dedupe(df, ["k"])


def test_fill_missing(spark, rows):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 4.0), ("a", None), ("b", None), (None, 8.0), (None, None)], "g string, x double"
    )
    assert rows(prepare.fill_missing(df, "x", "median", ["g"])) == [
        {"g": "a", "x": 1.0},
        {"g": "a", "x": 2.5},
        {"g": "a", "x": 4.0},
        {"g": "b", "x": None},
        {"g": None, "x": 8.0},
        {"g": None, "x": 8.0},
    ]
    whole = prepare.fill_missing(df, "x", "median").filter("g = 'b'").collect()
    assert whole[0]["x"] == 4.0
    assert prepare.fill_missing(df, "x", "drop").count() == 3
    assert prepare.fill_missing(df, "x", "constant", value=0.0).filter("x = 0").count() == 3
    with pytest.raises(ValueError):
        prepare.fill_missing(df, "x", "guess")


def test_normalise_marks_failed_casts(spark, rows):
    df = spark.createDataFrame([("  A \t B ", "12"), ("c", "x"), (None, None)], "s string, n string")
    assert rows(prepare.normalise(df, ["s"], {"n": "int"})) == [
        {"s": "a b", "n": 12, "n_failed": False},
        {"s": "c", "n": None, "n_failed": True},
        {"s": None, "n": None, "n_failed": False},
    ]
    assert rows(prepare.failed_casts(df, {"n": "int"})) == [{"n": 1}]


def test_iqr_fence(spark):
    data = [("a", float(v)) for v in range(1, 9)] + [("a", 100.0), ("a", None), ("b", 1.0)]
    df = spark.createDataFrame(data, "g string, x double")
    found = prepare.iqr_fence(df, "x", ["g"]).collect()
    assert len(found) == len(data)
    assert [r["x"] for r in found if r["is_outlier"]] == [100.0]
    assert {(r["lower"], r["upper"]) for r in found if r["g"] == "a"} == {(-3.0, 13.0)}
    whole = prepare.iqr_fence(df.filter("g = 'a'"), "x", []).collect()
    assert [r["x"] for r in whole if r["is_outlier"]] == [100.0]


def test_fences_drop_or_flag_and_ignore_nan(spark):
    nan = float("nan")
    data = [("a", float(v)) for v in range(1, 9)] + [("a", 100.0), ("a", None), ("a", nan), ("b", None), (None, 5.0)]
    df = spark.createDataFrame(data, "g string, x double")
    flagged = prepare.iqr_fence(df, "x", ["g"]).collect()
    assert len(flagged) == len(data)
    assert [r["x"] for r in flagged if r["is_outlier"]] == [100.0]
    dropped = prepare.iqr_fence(df, "x", ["g"], drop=True)
    assert dropped.columns == df.columns and dropped.count() == len(data) - 1
    wide = prepare.quantile_fence(df, "x", ["g"], 0.25, 0.75).collect()
    assert sorted(r["x"] for r in wide if r["is_outlier"]) == [1.0, 2.0, 8.0, 100.0]
    assert {(r["lower"], r["upper"]) for r in wide if r["g"] == "a"} == {(3.0, 7.0)}
    whole = prepare.quantile_fence(df, "x", [], 0.0, 1.0)
    assert not whole.filter("is_outlier").count()
    assert prepare.quantile_fence(df.limit(0), "x", ["g"]).count() == 0
    with pytest.raises(ValueError):
        prepare.quantile_fence(df, "x", ["g"], 0.9, 0.1)


def test_explode_topics(spark, rows):
    df = spark.createDataFrame([(1, "art; life;art"), (2, ""), (3, None), (4, "life")], "id int, t string")
    assert rows(prepare.explode_topics(df, "t", ";")) == [
        {"id": 1, "topic": "art"},
        {"id": 1, "topic": "life"},
        {"id": 4, "topic": "life"},
    ]
    arrays = spark.createDataFrame([(1, ["a", "a", "b"]), (2, [])], "id int, t array<string>")
    assert prepare.explode_topics(arrays, "t").count() == 2


def test_derive(spark):
    df = spark.createDataFrame([(10.0, 4.0)], "price double, area double")
    assert prepare.derive(df, {"per": F.col("price") / F.col("area")}).collect()[0]["per"] == 2.5


def test_period_includes_first_and_last_day(spark):
    stamps = [
        datetime(2021, 4, 30, 23, 59, 59, 999999),
        datetime(2021, 5, 1),
        datetime(2021, 6, 30, 23, 59, 59, 999999),
        datetime(2021, 7, 1),
    ]
    df = spark.createDataFrame([(s,) for s in stamps], "t timestamp_ntz")
    kept = [r["t"] for r in scope.in_period(df, "t", "2021-05-01", date(2021, 6, 30)).collect()]
    assert sorted(kept) == stamps[1:3]
    days = df.select(F.to_date("t").alias("t"))
    assert scope.in_period(days, "t", "2021-05-01", "2021-06-30").count() == 2
    years = spark.createDataFrame([(1999,), (2000,), (2013,), (2014,)], "y int")
    assert scope.in_period(years, "y", 2000, 2013).count() == 2


def test_threshold_and_region(spark, rows):
    df = spark.createDataFrame(
        [(1, "s", "U", None, 2023, 5), (2, "s", "X", "U", 2023, 9), (3, "s", "X", None, 2023, 9),
         (4, "s", "U", "U", 2023, 4), (5, "s", "U", "X", 2022, 9)],
        "company_id int, sector string, reg_region string, cap_region string, year int, revenue int",
    )
    scoped = scope.in_region(scope.min_revenue(df, 2023, 5), "U")
    assert [r["company_id"] for r in rows(scoped)] == [1, 2]
    capacity = spark.createDataFrame([(2, "U"), (2, "U"), (3, "X")], "company_id int, region string")
    listed = scope.in_region_by_capacity(df.drop("cap_region"), "U", capacity, ["company_id"])
    assert sorted(r["company_id"] for r in listed.collect()) == [1, 2, 4, 5]
    assert scope.in_place(df, "reg_region", ["X", "Z"]).count() == 2


def test_enrich_keeps_facts_without_dimension(spark, rows):
    fact = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    dim = spark.createDataFrame([(1, "one")], "k int, name string")
    assert rows(scope.enrich(fact, dim, ["k"])) == [
        {"k": 1, "name": "one"}, {"k": 2, "name": None}, {"k": None, "name": None},
    ]


def test_save_and_load_with_partitions(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, p string")
    path = str(tmp_path / "table")
    save(df, path, ["p"])
    assert rows(load(spark, path, "id int, p string")) == rows(df)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        save(df, path)


def test_materialise_uses_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    df = materialise(spark.range(3))
    assert df.count() == 3
    assert all(folder in f for f in df.inputFiles())


def test_input_schemas_are_valid(spark):
    for schema in INPUTS.values():
        assert spark.createDataFrame([], schema).count() == 0
