"""Video games on the sales of 1996-1999."""

from __future__ import annotations

from ..operators.games import platform_overview, regional_preference, sales_by, score_tier
from .inputs import games
from .tables import plain, table

# The names of the five regions.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def game_platforms(spark, d):
    return plain(platform_overview(games(spark, d), "platform", "title", "sales", "year"))


def game_genre_sales(spark, d):
    return plain(sales_by(games(spark, d), ["genre"], "sales"))


def game_regional(spark, d):
    wide = games(spark, d, buyers=True).groupBy("title", "genre")
    return plain(
        regional_preference(wide.pivot("buyer_region", REGIONS).sum("sales"), REGIONS, "genre")
    )


def game_tiers(spark, d):
    titles = table(spark, d, "part").select("p_partkey", "p_size")
    return plain(score_tier(titles, "p_size", [17, 34]))


QUERIES = {
    "game_platforms": game_platforms,
    "game_genre_sales": game_genre_sales,
    "game_regional": game_regional,
    "game_tiers": game_tiers,
}

_GAMES = """
game AS (
  SELECT p_brand AS platform, p_type AS genre, p_partkey AS title, year(o_orderdate) AS year,
         l_quantity::DECIMAL(12,2) AS sales, r_name AS region
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  WHERE year(o_orderdate) BETWEEN 1996 AND 1999
)
"""

SQL = {
    "game_platforms": f"""WITH {_GAMES}
SELECT platform, count(DISTINCT title) AS titles, sum(sales)::DOUBLE AS sales,
       min(year)::BIGINT AS first_year, max(year)::BIGINT AS last_year
FROM game GROUP BY platform""",
    "game_genre_sales": f"""WITH {_GAMES}, genres AS (
  SELECT genre, sum(sales)::DOUBLE AS sales FROM game GROUP BY genre)
SELECT genre, sales, sales / sum(sales) OVER () AS share FROM genres""",
    "game_regional": f"""WITH {_GAMES}, cells AS (
  SELECT r_name AS region, genre FROM region CROSS JOIN (SELECT DISTINCT genre FROM game)),
sold AS (
  SELECT c.region, c.genre, coalesce(sum(sales), 0)::DOUBLE AS sales
  FROM cells c LEFT JOIN game g ON g.region = c.region AND g.genre = c.genre
  GROUP BY c.region, c.genre)
SELECT genre, region, sales, sales / sum(sales) OVER (PARTITION BY region) AS share,
       rank() OVER (PARTITION BY region ORDER BY sales DESC) AS place
FROM sold""",
    "game_tiers": """
SELECT p_partkey, p_size::BIGINT AS p_size,
       CASE WHEN p_size < 17 THEN 'low' WHEN p_size < 34 THEN 'middle' ELSE 'high' END AS p_size_tier
FROM part""",
}
