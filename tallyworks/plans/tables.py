"""Schemas of the given tables and small helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ByteType,
    DateType,
    DecimalType,
    IntegerType,
    ShortType,
    TimestampNTZType,
    TimestampType,
)

from ..functions.columns import HASH_ROUNDS
from ..sources import load

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return load(spark, f"{folder}/{name}.parquet", SCHEMAS[name])


def money(col: str, kind: str = "decimal(12,2)") -> Column:
    """Amounts are given as doubles; sums of decimals do not depend on the order of rows."""
    return F.col(col).cast(kind)


def plain(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Types both engines hold alike, and rounding where sums of doubles may differ."""
    digits = digits or {}

    def convert(field) -> Column:
        c, kind = F.col(field.name), field.dataType
        if isinstance(kind, DecimalType):
            c = c.cast("double")
        elif isinstance(kind, (ByteType, ShortType, IntegerType)):
            c = c.cast("bigint")
        elif isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
            c = c.cast("date").cast("string")
        if field.name in digits:
            c = F.round(c, digits[field.name])
        return c.alias(field.name)

    return df.select(*[convert(f) for f in df.schema.fields])


def sql_p_value(z: str) -> str:
    """Two-sided normal tail in SQL without erf, by its series of positive terms."""
    x = f"(abs({z}) / sqrt(2e0))"
    return (
        f"(SELECT 1 - sum(exp(n * ln(2e0) * 2 + lgamma(n + 1) - lgamma(2 * n + 2)"
        f" + (2 * n + 1) * ln({x}) - {x} * {x})) * 2 / sqrt(pi())"
        f" FROM (SELECT i::DOUBLE AS n FROM range(0, 200) AS r(i)))"
    )


def sql_student_tail(t: str, freedom: str) -> str:
    """Two-sided tail of Student's t in SQL: one less the incomplete beta function at the
    other end, by its series of positive terms."""
    x, b = f"({t} * {t} / ({freedom} + {t} * {t}))", f"({freedom} / 2e0)"
    return (
        f"(SELECT 1 - sum(exp((n + 5e-1) * ln({x}) + {b} * ln(1 - {x})"
        f" + lgamma({b} + 5e-1 + n) - lgamma({b}) - lgamma(15e-1 + n)))"
        f" FROM (SELECT i::DOUBLE AS n FROM range(0, 600) AS r(i)))"
    )


def sql_hash32(*parts: str, seed: int = 0) -> str:
    """The integer hash of ``functions.hash32`` for numbers from 0 to 2^32 - 1."""
    h = f"{seed}::BIGINT"
    for part in parts:
        x = f"xor({h}, {part}::BIGINT)"
        for factor, shift in HASH_ROUNDS:
            x = f"(({x} * {factor}) & 4294967295)"
            x = f"xor({x}, {x} >> {shift})"
        h = x
    return h
