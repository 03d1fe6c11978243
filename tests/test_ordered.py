"""Skew-safe ranking, neighbours, frame sums and pair counts equal the plain
window / self-join SQL (a hot user, a null user, null and NaN values, ties)."""

import datetime as dt
import math
import random

import pytest

from fathom.operators import ordered

SQL_RANKS = ("SELECT event_id, user_id, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS rnk, "
             "dense_rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS drnk, "
             "row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM ev")
SQL_LAG = ("SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value, "
           "lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_value FROM ev")
SQL_FRAME = ("SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id "
             "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM ev")
SQL_PAIRS = ("SELECT e.user_id, count(*) AS n FROM ev e JOIN ev p ON e.user_id = p.user_id "
             "AND CAST(e.ts AS DATE) = CAST(p.ts AS DATE) AND p.ts > e.ts "
             "WHERE e.event_type = 'error' AND p.event_type = 'purchase' GROUP BY e.user_id")


@pytest.fixture()
def ev(spark):
    random.seed(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(6000):
        user = 1 if i % 3 == 0 else None if i % 97 == 0 else random.randint(2, 40)   # user 1 holds a third
        r = random.random()
        value = None if r < 0.03 else float("nan") if r < 0.05 else float(random.randint(0, 60))   # many ties
        ts = t0 + dt.timedelta(minutes=random.randint(0, 4000))   # equal ts across rows, several days
        kind = random.choice(["error", "purchase", "view"])
        rows.append((i, user, ts, kind, value))
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double")
    df.createOrReplaceTempView("ev")
    return df


def _rows(df, cols):
    def norm(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


BOTH_PLANS = pytest.mark.parametrize("max_rows", [None, 0], ids=["plain", "bucketed"])


@BOTH_PLANS
def test_ranks(spark, ev, max_rows):
    got = ordered.ranks(ev, "user_id", "value", "event_id", max_group_rows=max_rows)
    cols = ["event_id", "user_id", "rnk", "drnk", "rn"]
    assert _rows(got, cols) == _rows(spark.sql(SQL_RANKS), cols)


@BOTH_PLANS
def test_neighbours(spark, ev, max_rows):
    got = ordered.neighbours(ev, "user_id", ["ts", "event_id"], "value", max_group_rows=max_rows)
    cols = ["event_id", "prev_value", "next_value"]
    assert _rows(got, cols) == _rows(spark.sql(SQL_LAG), cols)


@BOTH_PLANS
def test_rows_frame_sum(spark, ev, max_rows):
    got = ordered.rows_frame_sum(ev, "user_id", ["ts", "event_id"], "value", 2, out_col="s", max_group_rows=max_rows)
    assert _rows(got, ["event_id", "s"]) == _rows(spark.sql(SQL_FRAME), ["event_id", "s"])


@BOTH_PLANS
def test_count_earlier_pairs(spark, ev, max_rows):
    from pyspark.sql import functions as F
    got = ordered.count_earlier_pairs(ev.withColumn("_day", F.col("ts").cast("date")), ["user_id", "_day"], "ts",
                                      "event_id", is_left=F.col("event_type") == "error",
                                      is_right=F.col("event_type") == "purchase", max_group_rows=max_rows)
    assert _rows(got, ["user_id", "n"]) == _rows(spark.sql(SQL_PAIRS), ["user_id", "n"])


def test_no_window_over_a_whole_user(spark, ev):
    from pyspark.sql import functions as F
    # groups over the bound (forced here with a bound of 0 rows)
    plans = [ordered.ranks(ev, "user_id", "value", "event_id", max_group_rows=0),
             ordered.neighbours(ev, "user_id", ["ts", "event_id"], "value", max_group_rows=0),
             ordered.rows_frame_sum(ev, "user_id", ["ts", "event_id"], "value", 2, max_group_rows=0),
             ordered.exact_median(ev, "user_id", "value", "event_id", max_group_rows=0),
             ordered.count_earlier_pairs(ev.withColumn("_day", F.col("ts").cast("date")), ["user_id", "_day"], "ts",
                                         "event_id", F.col("event_type") == "error",
                                         F.col("event_type") == "purchase", max_group_rows=0)]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        # row windows are keyed by (user, bucket); no pair join on the user alone
        assert "SinglePartition" not in plan
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        for line in plan.splitlines():
            if "Window [" in line and "row_number()" in line:
                assert "_b#" in line.split("], [")[1]   # partitioned by (group, bucket)


@BOTH_PLANS
def test_exact_median(spark, ev, max_rows):
    from pyspark.sql import functions as F
    # odd and even group sizes, a null group, null values, a hot group
    got = ordered.exact_median(ev.withColumn("g", F.col("user_id") % 4), "g", "value", "event_id",
                               max_group_rows=max_rows)
    want = spark.sql("SELECT user_id % 4 AS g, median(value) AS median FROM ev GROUP BY 1")
    assert _rows(got, ["g", "median"]) == _rows(want, ["g", "median"])
    sizes = {r["g"]: r["n"] for r in spark.sql("SELECT user_id % 4 AS g, count(value) AS n FROM ev GROUP BY 1").collect()}
    assert {n % 2 for n in sizes.values()} == {0, 1}


def test_plan_choice_follows_the_largest_group(spark, ev):
    from fathom.operators import position
    assert position.group_sizes(ev, ["user_id"]) == (6000, 2000)
    assert position.groups_fit(ev, ["user_id"], 2000)[0] and not position.groups_fit(ev, ["user_id"], 1999)[0]
    plain = ordered.neighbours(ev, "user_id", ["ts", "event_id"], "value", max_group_rows=2000)
    assert "_b#" not in plain._jdf.queryExecution().executedPlan().toString()


def test_broadcast_only_after_size_check(spark, ev):
    from pyspark.sql import functions as F
    from fathom.operators.joins import broadcast_if_small
    types = ev.groupBy("event_type").agg(F.avg("value").alias("a"))
    small = ev.join(broadcast_if_small(types), "event_type")
    over = ev.join(broadcast_if_small(types, max_rows=1), "event_type")
    large = ev.join(broadcast_if_small(types, max_bytes=10), "event_type")
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (over, large):
            assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert _rows(small, small.columns) == _rows(over, over.columns)


def test_set_queries_equal_sql(spark, tmp_path):
    from fathom.plans import sql_suite
    random.seed(9)
    t0 = dt.datetime(2024, 1, 3)
    rows = [(i, None if i % 50 == 0 else 1 if i % 3 == 0 else random.randint(2, 60),
             t0 + dt.timedelta(hours=random.randint(0, 120)), random.choice(["purchase", "view", "error"]),
             None if i % 40 == 0 else float(random.randint(0, 320)))
            for i in range(3000)]
    rows += [(5000 + u, 100 + u, dt.datetime(2024, 1, 5, 12), "view", 1.0) for u in range(5)]   # only on day 5
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double")
    df.createOrReplaceTempView("ev2")
    d = tmp_path / "sf"
    df.write.parquet(str(d / "events.parquet"))
    for qid in ("q12_exists", "q13_not_exists", "q14_correlated_scalar", "q17_intersect", "q18_except"):
        sql = next(s for i, _, s, _ in sql_suite.SUITE if i == qid).replace(" df", " ev2")
        got = sql_suite.SKEW_SAFE[qid](spark, str(d))
        want = spark.sql(sql)
        assert got.count() > 0, qid
        assert _rows(got, want.columns) == _rows(want, want.columns), qid


@pytest.mark.parametrize("max_len", [None, 7], ids=["one-array", "chunked"])
def test_collect_bounded(spark, ev, max_len):
    from pyspark.sql import functions as F
    got = ordered.collect_bounded(ev, "user_id", "value", ["ts", "event_id"], out_col="vals", max_len=max_len)
    assert got.columns == ["user_id", "chunk", "vals"]
    if max_len:
        assert got.select(F.max(F.size("vals"))).first()[0] <= max_len
    flat = got.select("user_id", F.explode("vals").alias("value"))
    want = spark.sql("SELECT user_id, v AS value FROM (SELECT user_id, collect_list(value) AS vs FROM ev GROUP BY user_id) "
                     "LATERAL VIEW explode(vs) t AS v")
    assert _rows(flat, ["user_id", "value"]) == _rows(want, ["user_id", "value"])


def test_pairs_with_a_hot_timestamp(spark):
    # a third of the rows share one ts: the bucketed plan splits them by the tiebreak
    from pyspark.sql import functions as F
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(i, 1 if i % 2 else 2, t if i % 3 == 0 else t + dt.timedelta(seconds=i % 500),
             "error" if i % 5 < 2 else "purchase") for i in range(6000)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string")
    df.createOrReplaceTempView("ev3")
    got = ordered.count_earlier_pairs(df.withColumn("_day", F.col("ts").cast("date")), ["user_id", "_day"], "ts",
                                      "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase",
                                      max_group_rows=0)
    want = spark.sql(SQL_PAIRS.replace(" ev ", " ev3 "))
    assert _rows(got, ["user_id", "n"]) == _rows(want, ["user_id", "n"])
