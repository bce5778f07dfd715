"""Rating, property, tickets, games, talks and catering on hand-made rows."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import band, bin_index, tier
from tallyworks.operators import catering, estate, games, rating, summary, talks, tickets
from tallyworks.sources import INPUTS


def companies(spark):
    data = [
        # company, sector, registered, capacity, year, revenue, sales profit, net profit
        (1, "steel", "U", None, 2022, 4, 1, 1),
        (1, "steel", "U", None, 2023, 5, 2, 3),  # exactly on the threshold
        (2, "steel", "X", "U", 2021, 4, 1, 1),
        (2, "steel", "X", "U", 2023, 8, 2, 2),  # previous year missing
        (3, "food", "U", "U", 2022, 0, 0, -2),
        (3, "food", "U", "U", 2023, 8, -1, 2),  # base zero and negative, tied revenue
        (4, "food", "U", None, 2022, 9, 1, 1),
        (4, "food", "U", None, 2023, 4, 1, 1),  # below the threshold
        (5, "food", "X", None, 2023, 99, 1, 1),  # elsewhere
        (6, "it", "U", None, 2023, None, 1, 1),
    ]
    money = lambda v: None if v is None else Decimal(v)
    return spark.createDataFrame(
        [(*r[:5], *map(money, r[5:])) for r in data], INPUTS["company_year"]
    )


def test_return_on_sales_needs_positive_revenue(spark):
    df = spark.createDataFrame([(1, 4), (1, 0), (1, -2), (1, None), (None, 4)], "sales_profit int, revenue int")
    assert [r["ros"] for r in rating.return_on_sales(df).collect()] == [0.25, None, None, None, None]


def test_growth_needs_the_year_before_and_a_positive_base(spark):
    grown = rating.growth(companies(spark), "company_id", "year", "net_profit").filter("year = 2023")
    found = {r["company_id"]: (r["net_profit_growth"], r["net_profit_from_loss"]) for r in grown.collect()}
    assert found[1] == (2.0, False)
    assert found[2] == (None, False)
    assert found[3] == (None, True)
    revenue = rating.growth(companies(spark), "company_id", "year", "revenue").filter("company_id = 3 AND year = 2023")
    assert tuple(revenue.collect()[0][-2:]) == (None, True)


def test_leaders_share_places(spark, rows):
    year = companies(spark).filter("year = 2023")
    found = rows(rating.leaders(year, "sector", "revenue"), "sector", "company_id", "place")
    assert found == [
        {"sector": "food", "company_id": 5, "place": 1},
        {"sector": "it", "company_id": 6, "place": 1},
        {"sector": "steel", "company_id": 2, "place": 1},
    ]
    tied = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4)], "s string, id int, m int")
    assert sorted(r["id"] for r in rating.leaders(tied, "s", "m", 2).collect()) == [1, 2]


def test_rating_table(spark):
    found = {r["company_id"]: r for r in rating.rating(companies(spark), 2023, "U", 5).collect()}
    assert set(found) == {1, 2, 3}
    assert {c: r["place"] for c, r in found.items()} == {2: 1, 3: 1, 1: 3}
    assert found[1]["ros"] == 0.4 and found[1]["revenue_growth"] == 0.25
    assert found[3]["revenue_growth"] is None and found[3]["revenue_from_loss"]
    assert found[3]["ros"] == -0.125


def test_market_value_and_typical(spark, rows):
    data = [
        ("flat", 100.0, 10.0, "red"), ("flat", 300.0, 10.0, "blue"), ("flat", None, 0.0, None),
        ("plot", 50.0, 0.0, None), (None, 7.0, 7.0, "red"),
    ]
    df = spark.createDataFrame(data, "t string, price double, area double, colour string")
    assert rows(estate.market_value(df, ["t"], "price", "area")) == [
        {"t": "flat", "n": 3, "median_price": 200.0, "median_price_per_area": 20.0},
        {"t": "plot", "n": 1, "median_price": 50.0, "median_price_per_area": None},
        {"t": None, "n": 1, "median_price": 7.0, "median_price_per_area": 1.0},
    ]
    typical = rows(estate.typical(df, ["t"], ["area"], ["colour"]))
    assert typical[0] == {"t": "flat", "n": 3, "median_area": 10.0, "mode_colour": "blue"}
    assert typical[1]["mode_colour"] is None
    whole = estate.market_value(df, [], "price", "area").collect()[0]
    assert (whole["n"], whole["median_price"]) == (5, 75.0)


def test_by_distance_keeps_rows_outside_the_bands(spark):
    df = spark.createDataFrame(
        [(0.0, "flat", 1.0, 1.0, "x"), (5.0, "flat", 2.0, 1.0, "x"), (9.0, "flat", 3.0, 1.0, "y")],
        "km double, t string, price double, area double, c string",
    )
    found = estate.by_distance(df, "km", [0, 5, 9], ["t"], "price", "area", ["area"], ["c"]).collect()
    assert {r["distance_band"]: r["median_price"] for r in found} == {"[0,5)": 1.0, "[5,9)": 2.0, None: 3.0}


def test_tier_band_and_bin_bounds(spark):
    df = spark.createDataFrame([(None,), (0.0,), (10.0,), (20.0,), (25.0,)], "x double")
    x = F.col("x")
    found = df.select(
        tier(x, [10, 20], ["low", "middle", "high"]).alias("t"),
        band(x, [0, 10, 20]).alias("b"),
        bin_index(x, F.lit(0.0), F.lit(20.0), 4).alias("i"),
        bin_index(x, F.lit(5.0), F.lit(5.0), 4).alias("flat"),
    ).collect()
    assert [tuple(r) for r in found] == [
        (None, None, None, None),
        ("low", "[0,10)", 0, 0),
        ("middle", "[10,20)", 2, 0),
        ("high", None, 3, 0),
        ("high", None, 3, 0),
    ]
    with pytest.raises(ValueError):
        tier(x, [2, 1], ["a", "b", "c"])
    with pytest.raises(ValueError):
        band(x, [1])


def test_share_change_against_the_calendar(spark):
    weeks = [date(2024, 9, 2), date(2024, 9, 9), date(2024, 9, 23)]
    data = [(weeks[0], "a")] * 3 + [(weeks[0], "b")] + [(weeks[1], "a")] * 2 + [(weeks[2], "a")]
    df = spark.createDataFrame([(datetime(d.year, d.month, d.day, 13), c) for d, c in data], "t timestamp_ntz, c string")
    found = {
        (r["period"], r["c"]): (r["n"], r["share"], r["change"])
        for r in tickets.share_change(df, "t", "week", "c").collect()
    }
    assert found == {
        (weeks[0], "a"): (3, 0.75, None),
        (weeks[0], "b"): (1, 0.25, None),
        (weeks[1], "a"): (2, 1.0, 0.25),
        (weeks[1], "b"): (0, 0.0, -0.25),  # vanished
        (weeks[2], "a"): (1, 1.0, None),  # no week before it
    }


@pytest.mark.parametrize("unit,start", [
    ("day", date(2024, 2, 29)), ("week", date(2024, 2, 26)), ("month", date(2024, 2, 1)),
    ("quarter", date(2024, 1, 1)), ("year", date(2024, 1, 1)),
])
def test_seasonality_periods(spark, unit, start):
    df = spark.createDataFrame([(datetime(2024, 2, 29, 23, 59), 1), (datetime(2024, 2, 29), 1)], "t timestamp_ntz, u int")
    assert [tuple(r) for r in tickets.seasonality(df, "t", unit, "u").collect()] == [(start, 2, 1)]


def test_popularity_devices_and_prices(spark, rows):
    df = spark.createDataFrame(
        [("a", "m", 1, Decimal("1.00")), ("a", "d", 1, Decimal("3.00")), ("b", "m", 2, None)],
        "c string, device string, u int, price decimal(12,2)",
    )
    assert rows(tickets.popularity(df, ["c"]))[0] == {"c": "a", "n": 2, "share": 2 / 3}
    devices = rows(tickets.activity_by(df, "device", "u"))
    assert devices == [
        {"device": "d", "users": 1, "actions": 1, "actions_per_user": 1.0},
        {"device": "m", "users": 2, "actions": 2, "actions_per_user": 1.0},
    ]
    profile = rows(tickets.price_profile(df, ["c"], "price"))
    assert profile[0] == {
        "c": "a", "n": 2, "mean_price": 2.0, "stddev_price": pytest.approx(2 ** 0.5),
        "price_q1": 1.5, "price_median": 2.0, "price_q3": 2.5,
    }
    assert profile[1]["n"] == 0 and profile[1]["mean_price"] is None


def test_games(spark, rows):
    df = spark.createDataFrame(
        [("p", "rpg", 1, 2001, 1.0, None, 5.0), ("p", "rpg", 2, 2003, 2.0, None, 10.0),
         ("q", "race", 2, 2002, 3.0, None, None)],
        "platform string, genre string, title int, year int, east double, west double, score double",
    )
    assert rows(games.platform_overview(df, "platform", "title", "east", "year"))[0] == {
        "platform": "p", "titles": 2, "sales": 3.0, "first_year": 2001, "last_year": 2003,
    }
    assert rows(games.sales_by(df, ["genre"], "east"))[0] == {"genre": "race", "east": 3.0, "share": 0.5}
    regional = rows(games.regional_preference(df, ["east", "west"], "genre"), "region", "genre", "sales", "share", "place")
    assert regional[0] == {"region": "east", "genre": "race", "sales": 3.0, "share": 0.5, "place": 1}
    assert regional[2] == {"region": "west", "genre": "race", "sales": 0.0, "share": None, "place": 1}
    tiers = [r["score_tier"] for r in games.score_tier(df, "score", [5, 10]).collect()]
    assert tiers == ["middle", "high", None]


def test_talks(spark, rows):
    monday, sunday = datetime(2024, 1, 1, 10), datetime(2024, 1, 7, 10)
    df = spark.createDataFrame(
        [(["a", "b", "a"], "Good", 1, 1, 2.0, monday), (["a"], "Bad", 2, 1, 4.0, sunday),
         ([], "Good", 2, 2, None, monday), (None, "Good", 3, 2, 6.0, monday)],
        "topics array<string>, reaction string, speaker int, conf int, score double, t timestamp_ntz",
    )
    assert rows(talks.topic_counts(df, "topics")) == [
        {"topic": "a", "talks": 2, "share": 2 / 3}, {"topic": "b", "talks": 1, "share": 1 / 3},
    ]
    assert rows(talks.reaction_by_topic(df, "topics", "reaction", ["Good", "Bad"])) == [
        {"topic": "a", "talks": 2, "reaction_good": 1, "reaction_bad": 1},
        {"topic": "b", "talks": 1, "reaction_good": 1, "reaction_bad": 0},
    ]
    best = talks.top_speakers(df, "speaker", "score", 2, 1).collect()
    assert [r["speaker"] for r in best] == [3, 2]
    assert [r["speaker"] for r in talks.top_speakers(df, "speaker", "score", 9, 2).collect()] == [2]
    when = talks.popular_time(df, "t", "weekday", "conf").collect()
    assert {r["weekday"]: (r["conferences"], r["talks"], r["place"]) for r in when} == {1: (2, 3, 1), 7: (1, 1, 2)}
    assert rows(summary.avg_distinct_per(df, "conf", "speaker")) == [{"confs": 2, "mean_speakers": 2.0}]
    assert rows(summary.avg_length(df, [], "score")) == [{"n": 3, "mean_score": 4.0}]


def test_top_k_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(3, 5), (1, 5), (2, 9), (4, None)], "id int, m int")
    assert [r["id"] for r in summary.top_k(df, "m", 3, ["id"]).collect()] == [2, 1, 3]


def test_catering(spark, rows):
    df = spark.createDataFrame(
        [("bar", "n", 10.0, 5.0), ("bar", "n", 30.0, 5.0), ("cafe", "n", 90.0, 1.0), ("pub", "s", None, 5.0)],
        "niche string, district string, chk double, rating double",
    )
    assert sum(r["share"] for r in catering.structure(df, ["niche", "district"]).collect()) == pytest.approx(1)
    assert rows(catering.check_and_rating(df, ["niche"], "chk", "rating"))[0] == {
        "niche": "bar", "n": 2, "mean_rating": 5.0, "median_check": 20.0,
    }
    places = {r["niche"]: (r["eligible"], r["place"]) for r in catering.rank_niches(df, "niche", "chk", "rating").collect()}
    assert places == {"bar": (True, 1), "cafe": (False, None), "pub": (True, None)}
    line = catering.relation(df, "chk", "rating", []).collect()[0]
    assert line["n"] == 3 and line["corr"] == pytest.approx(-0.9707253)
    bands = {r["check_band"]: r["n"] for r in catering.rating_by_check(df, "chk", "rating", 0.0, 50.0, 5).collect()}
    assert bands == {1: 1, 3: 1, 4: 1}
