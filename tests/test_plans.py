"""Physical plans: what reaches the scan, what is shuffled, and how skew is met."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import distribution, experiment, prepare, rating, scope
from tallyworks.plans import all_queries, inputs
from tests_support import final_plan

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = all_queries()

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

def scans(plan):
    return len(re.findall(r"FileScan|Scan ExistingRDD|Range \(", plan))

@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_row_python(spark, name):
    plan = final_plan(QUERIES[name](spark, FOLDER))
    for operator in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "FlatMapGroups"):
        assert operator not in plan
    # The p-value is the only Python function and runs on a result of one row.
    if "ArrowEvalPython" in plan:
        assert re.search(r"device_(welch|mwu)|ab_(two|sess|srm)", name)

@needs_tables
@pytest.mark.parametrize("name", ["period_filter", "food_ltv", "game_platforms", "rating_table"])
def test_period_reaches_the_scan(spark, name):
    if name == "rating_table":
        df = inputs.company_profile(spark, FOLDER, "1999-01-01", "2000-12-31")
    else:
        df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan)

@needs_tables
def test_scan_reads_needed_columns_only(spark):
    plan = QUERIES["talk_top_speakers"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_suppkey:bigint,l_tax:double>" in plan

def test_quantiles_read_the_data_once(spark, tmp_path):
    path = str(tmp_path / "data")
    spark.range(5000).selectExpr("id % 3 AS g", "cast(id as double) AS x").write.parquet(path)
    df = distribution.quantiles(spark.read.parquet(path), ["g"], {"x": "x"})
    plan = final_plan(df)
    assert scans(plan) <= 1, plan
    assert "ReusedExchange" in plan

def test_mann_whitney_reads_the_data_once(spark, tmp_path):
    path = str(tmp_path / "data")
    spark.range(5000).selectExpr("id % 2 AS g", "cast(id as double) AS x").write.parquet(path)
    plan = final_plan(experiment.mann_whitney(spark.read.parquet(path), "g", "x", 0, 1))
    assert scans(plan) <= 1, plan

def test_dedupe_and_leaders_reduce_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 7 AS k", "id AS v")
    for result in (prepare.dedupe(df, ["k"], [F.desc("v")]), rating.leaders(df, "k", "v")):
        plan = final_plan(result)
        partial = plan.index("Partial")
        exchange = plan.index("Exchange hashpartitioning")
        assert "WindowGroupLimit" in plan and partial > exchange  # printed top down

def test_session_windows_hold_cells_not_actions(spark):
    # One user owns a third of the actions; they must be added up before the shuffle.
    df = spark.range(9000).selectExpr(
        "if(id % 3 = 0, 0, id) AS u", "timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0,id) AS t"
    )
    plan = final_plan(experiment.sessions(df, "u", "t", 3600, {}))
    window = plan.index("Window")
    assert plan.index("partial_count") > window
    assert plan.count("Exchange hashpartitioning") == 2

def test_skewed_join_is_split(spark, tmp_path):
    settings = {
        "spark.sql.shuffle.partitions": "32",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        fact = spark.range(0, 60_000, 1, 8).selectExpr(
            "if(id % 3 = 0, 1, id) AS k", "uuid() AS payload"
        )
        dim = spark.range(60_000).selectExpr("id AS k", "id * 2 AS name")
        joined = scope.enrich(fact, dim, ["k"])
        plan = final_plan(joined.select("k", "payload", "name"))
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

# Collects of results whose size a constant of the module bounds, whatever the input: the
# languages a classifier tells apart, the nodes of two tree levels, a bitmap.
BOUNDED = {"language_id.py": 1, "context_tree.py": 1, "suffix_dedup.py": 1}


def test_library_keeps_to_distributed_calls():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tallyworks")
    banned = r"\.collect\(|toPandas|crossJoin|localCheckpoint|\.rdd\b|F\.udf|applyInPandas|\.cache\(\)|\.persist\("
    for folder, _, files in os.walk(root):
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as source:
                    assert len(re.findall(banned, source.read())) == BOUNDED.get(name, 0), name
