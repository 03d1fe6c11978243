"""Plan shape of every registered query: no cartesian products, no nested-loop
joins, and no rows gathered into one partition (a global aggregate may merge
its per-task partial results there)."""

import pytest

import __spark_entry__ as E
from fathom.plans import registry

registry.load_all()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_plan_shape(spark, name):
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            below = lines[i + 1] if i + 1 < len(lines) else ""
            assert "HashAggregate(keys=[]" in below and "partial_" in below, (name, line, below)


def test_flagship_scan_is_pruned(spark):
    plan = E.entry(spark)._jdf.queryExecution().executedPlan().toString()
    # only the orders and part columns the query needs are read; lineitem is not read at all
    assert "lineitem" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderdate" in plan or \
        "o_totalprice" not in plan


def test_ordered_pair_count_emits_no_pairs(spark):
    # Q11 counts (error, purchase) pairs with p.ts > e.ts per user and day:
    # no join carries an order predicate, so no pairs are formed
    for rows in (None, 0):
        from fathom.operators import ordered
        from pyspark.sql import functions as F
        ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("_day", F.col("ts").cast("date"))
        df = ordered.count_earlier_pairs(ev, ["user_id", "_day"], "ts", "event_id",
                                         F.col("event_type") == "error", F.col("event_type") == "purchase",
                                         max_group_rows=rows)
        for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
            if "Join" in line:
                assert " > " not in line and " < " not in line, line
