"""Stand-ins: the inputs each kind of analysis expects, derived from the given tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import ratio
from ..operators.experiment import sessions as to_sessions
from ..operators.scope import enrich, in_period
from .tables import money, table

RATING_YEAR = 2000
REGION = "EUROPE"
THRESHOLD = 4_000_000
CAPACITY_SHARE = Decimal("0.25")
SESSION_GAP = 6 * 3600
MEASURES = ("revenue", "cost", "tax")


def places(spark: SparkSession, d: str) -> DataFrame:
    """Nations with the name of their region."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_name"
    )


def dated_orders(
    spark: SparkSession, d: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    """Orders, of a closed period if one is given."""
    orders = table(spark, d, "orders")
    return in_period(orders, "o_orderdate", first, last) if first else orders


def sales(
    spark: SparkSession,
    d: str,
    first: str | None = None,
    last: str | None = None,
    buyers: bool = False,
) -> DataFrame:
    """Order lines with their order and part, and on demand the buyer's region."""
    orders = dated_orders(spark, d, first, last)
    if buyers:
        customer = table(spark, d, "customer")
        homes = places(spark, d)
        orders = (
            orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(homes, F.col("c_nationkey") == homes.n_nationkey)
            .withColumnRenamed("r_name", "buyer_region")
        )
    lineitem, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).join(
        part, lineitem.l_partkey == part.p_partkey
    )


def company_lines(lines: DataFrame) -> DataFrame:
    """Revenue, cost and tax of each line; the seller is the company, the part type its sector."""
    revenue = money("l_extendedprice") * (1 - money("l_discount", "decimal(4,2)"))
    # Products of up to 18 digits, which Spark keeps in a long.
    cost = 2 * money("l_quantity", "decimal(6,2)") * money("p_retailprice", "decimal(9,2)")
    tax = money("l_tax", "decimal(4,2)")
    return lines.select(
        "*",
        F.col("l_suppkey").alias("company_id"),
        F.year("o_orderdate").alias("year"),
        revenue.alias("revenue"),
        cost.alias("cost"),
        (revenue * tax).alias("tax"),
    )


def with_profits(sums: DataFrame) -> DataFrame:
    """Profits from summed revenue, cost and tax: exact in decimals, and once per company."""
    profit = F.col("revenue") - F.col("cost")
    return sums.withColumns(
        {"sales_profit": profit, "net_profit": profit - F.col("tax")}
    ).drop("cost", "tax")


def company_year(
    spark: SparkSession, d: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    """Revenue and profits per company and year."""
    lines = company_lines(sales(spark, d, first, last))
    sums = lines.groupBy("company_id", "year").agg(*[F.sum(m).alias(m) for m in MEASURES])
    return with_profits(sums)


def largest(name: str, amount: str) -> Column:
    """Name with the largest amount in a group; of tied names the first."""
    return F.min_by(name, F.struct((-F.col(amount)).alias("amount"), F.col(name).alias("name")))


def company_profile(spark: SparkSession, d: str, first: str, last: str) -> DataFrame:
    """Company-years with sector and regions of main capacity.

    The lines are added up once, per company, year, sector and region; the windows then
    see one company-year each, a few dozen rows.
    """
    keys = ["company_id", "year"]
    cells = (
        company_lines(sales(spark, d, first, last, buyers=True))
        .groupBy(*keys, "p_type", "buyer_region")
        .agg(*[F.sum(m).alias(m) for m in MEASURES])
    )
    total = lambda *also: F.sum("revenue").over(Window.partitionBy(*keys, *also))
    parts = cells.withColumn("_all", total()).withColumns(
        {"_sector": total("p_type"), "_region": total("buyer_region")}
    )
    strong = F.when(F.col("_region") >= F.col("_all") * CAPACITY_SHARE, F.col("buyer_region"))
    years = parts.groupBy(*keys).agg(
        *[F.sum(m).alias(m) for m in MEASURES],
        largest("p_type", "_sector").alias("sector"),
        F.collect_set(strong).alias("cap_regions"),
    )
    return with_profits(years)

def registrations(spark: SparkSession, d: str) -> DataFrame:
    """Region in which each company is registered."""
    supplier, homes = table(spark, d, "supplier"), places(spark, d)
    return supplier.join(homes, supplier.s_nationkey == homes.n_nationkey).select(
        F.col("s_suppkey").alias("company_id"), F.col("r_name").alias("reg_region")
    )


def devices(spark: SparkSession, d: str) -> DataFrame:
    """Events with a device class: two thirds of the users have one, the others alternate."""
    k = F.get_json_object("props", "$.k").cast("int")
    device = (
        F.when(F.col("user_id") % 3 == 0, "mobile")
        .when(F.col("user_id") % 3 == 1, "desktop")
        .when(k % 2 == 0, "mobile")
        .otherwise("desktop")
    )
    return table(spark, d, "events").withColumn("device", device)


def games(spark: SparkSession, d: str, buyers: bool = False) -> DataFrame:
    """Game sales 1996-1999: platform = brand, genre = type, title = part."""
    return sales(spark, d, "1996-01-01", "1999-12-31", buyers).select(
        F.col("p_brand").alias("platform"),
        F.col("p_type").alias("genre"),
        F.col("p_partkey").alias("title"),
        F.year("o_orderdate").alias("year"),
        money("l_quantity").alias("sales"),
        *(["buyer_region"] if buyers else []),
    )


def talks(spark: SparkSession, d: str) -> DataFrame:
    """Talks with topics: a line is a talk, the words of its part's name are its topics."""
    lineitem, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return lineitem.join(part, lineitem.l_partkey == part.p_partkey).select(
        F.split("p_name", " ").alias("topics"), F.col("l_returnflag").alias("reaction")
    )


def conferences(spark: SparkSession, d: str) -> DataFrame:
    """Talks of dated conferences: a line is a talk, its order the conference."""
    lineitem, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("conference"),
        F.col("l_suppkey").alias("speaker"),
        money("l_quantity").alias("length"),
        F.col("o_orderdate").alias("starts"),
    )


def establishments(spark: SparkSession, d: str) -> DataFrame:
    """One row per establishment with niche, district and rating."""
    customer, homes = table(spark, d, "customer"), places(spark, d)
    return customer.join(homes, customer.c_nationkey == homes.n_nationkey).select(
        F.col("c_custkey").alias("place_id"),
        F.col("c_mktsegment").alias("niche"),
        F.col("n_name").alias("district"),
        money("c_acctbal").alias("rating"),
    )


def with_checks(spark: SparkSession, d: str) -> DataFrame:
    """Establishments with their average check, the mean order; null without orders."""
    checks = (
        table(spark, d, "orders")
        .select(F.col("o_custkey").alias("place_id"), money("o_totalprice").alias("price"))
        .groupBy("place_id")
        .agg(ratio(F.sum("price"), F.count("price")).alias("avg_check"))
    )
    return enrich(establishments(spark, d), checks, ["place_id"])


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Order lines of May and June 1997; the seller is the restaurant."""
    lineitem = table(spark, d, "lineitem")
    orders = dated_orders(spark, d, "1997-05-01", "1997-06-30")
    price, discount = money("l_extendedprice"), money("l_discount", "decimal(4,2)")
    return lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("l_suppkey").alias("restaurant_id"),
        (price * (1 - discount)).alias("value"),
        (price * discount).alias("margin"),
    )


def session_table(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the event stream; half of the users are in each test group."""
    events = table(spark, d, "events").withColumn("grp", F.col("user_id") % 2)
    counts = {
        "purchases": F.col("event_type") == "purchase",
        "registrations": F.col("event_type") == "signup",
        "page_views": F.col("event_type") == "view",
    }
    return to_sessions(events, "user_id", "ts", SESSION_GAP, counts, ["grp"]).withColumn(
        "success", F.col("purchases") > 0
    )
