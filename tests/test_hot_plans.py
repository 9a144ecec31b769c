"""Rows of hot groups aren't dealt by the key of their group."""

import re

import pytest
from pyspark.sql import functions as F

from redtide.operators import ranking
from redtide.plans import catalog
from redtide.session import written


@pytest.fixture
def large(spark):
    """Sizes as the planner sees them on large tables: nothing is broadcast unasked."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_groups_are_met_by_broadcast(spark, large):
    rows = written(spark.range(600).selectExpr("cast(id % 2 AS string) AS k", "cast(id * 7 % 501 AS double) AS v"))
    found = ranking.quantiles(rows, ["k"], "v", {"m": 0.5}, hot_rows=50)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    by_key = [line for line in plan.splitlines() if re.search(r"(SortMerge|ShuffledHash)Join \[(k|_name)#\d+\], ", line)]
    assert not by_key and "BroadcastHashJoin" in plan
    wide = ranking.quantiles_wide(rows.withColumn("w", F.col("v")), ["k"], ["v", "w"], 0.5, 50)
    plan = wide._jdf.queryExecution().sparkPlan().toString()
    assert "k#" in plan and not re.search(r"SortMergeJoin \[k#\d+\], \[k#\d+\], Left(Semi|Anti)", plan)


def test_days_are_made_distinct_before_they_meet(spark, sf):
    plan = catalog.QUERIES["u2_intersect_dates"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan
    assert plan.count("Aggregate [") >= 2
