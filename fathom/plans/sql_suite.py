"""SQL conformance set: user SQL over one registered frame ``df``.

Each entry: (id, table registered as df, Spark SQL, DuckDB text or None when
the same text runs on both). ``sql_<id>`` runs the text through
``preview.run_sql`` exactly as a user query would. ``ordered_<id>`` is the
library's own plan for the same result where a user's text would put a hot
user or type into one task: windows per user, an order-predicate self-join,
semi/anti joins and set operations of the table with itself, a per-type
correlated mean, a median. Both have the text as their oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import ordered, preview
from fathom.plans.registry import register
from fathom.session import read_table

# The queries.
SUITE: list[tuple[str, str, str, str | None]] = [
    ("q01_filter_project", "lineitem",
     "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM df WHERE l_returnflag = 'R' AND l_quantity > 45", None),
    ("q02_case_when", "lineitem",
     "SELECT CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount < 0.07 THEN 'mid' ELSE 'high' END AS bucket, "
     "CAST(count(*) AS BIGINT) AS n FROM df GROUP BY 1", None),
    ("q03_agg_having", "lineitem",
     "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, "
     "CAST(count(*) AS BIGINT) AS n FROM df GROUP BY l_returnflag, l_linestatus HAVING count(*) > 100", None),
    ("q04_count_distinct", "events",
     "SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM df GROUP BY event_type", None),
    ("q05_rollup", "lineitem",
     "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty "
     "FROM df GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    ("q06_cube", "lineitem",
     "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM df GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    ("q07_grouping_sets", "lineitem",
     "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM df "
     "GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", None),
    ("q08_ranking", "events",
     "SELECT event_id, user_id, CAST(rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS BIGINT) AS rnk, "
     "CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS BIGINT) AS drnk, "
     "CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS BIGINT) AS rn FROM df", None),
    ("q09_lag_lead", "events",
     "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value, "
     "lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_value FROM df", None),
    ("q10_moving_sum", "events",
     "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id "
     "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving_sum FROM df", None),
    ("q11_self_join", "events",
     "SELECT e.user_id, CAST(count(*) AS BIGINT) AS n FROM df e JOIN df p ON e.user_id = p.user_id "
     "AND CAST(e.ts AS DATE) = CAST(p.ts AS DATE) AND p.ts > e.ts "
     "WHERE e.event_type = 'error' AND p.event_type = 'purchase' GROUP BY e.user_id", None),
    ("q12_exists", "events",
     "SELECT DISTINCT user_id FROM df a WHERE EXISTS (SELECT 1 FROM df b WHERE b.user_id = a.user_id "
     "AND b.event_type = 'purchase')", None),
    ("q13_not_exists", "events",
     "SELECT DISTINCT user_id FROM df a WHERE NOT EXISTS (SELECT 1 FROM df b WHERE b.user_id = a.user_id "
     "AND b.value > 300)", None),
    ("q14_correlated_scalar", "events",
     "SELECT event_id, event_type, value FROM df a WHERE value > (SELECT avg(value) FROM df b "
     "WHERE b.event_type = a.event_type)", None),
    ("q15_cte", "events",
     "WITH daily AS (SELECT CAST(ts AS DATE) AS d, event_type, count(*) AS n FROM df GROUP BY CAST(ts AS DATE), event_type) "
     "SELECT event_type, CAST(max(n) AS BIGINT) AS max_daily, round(avg(n), 4) AS avg_daily FROM daily GROUP BY event_type",
     None),
    ("q16_union", "events",
     "SELECT event_type, 'distinct' AS kind FROM (SELECT event_type FROM df WHERE CAST(ts AS DATE) = DATE '2024-01-01' "
     "UNION SELECT event_type FROM df WHERE CAST(ts AS DATE) = DATE '2024-01-02') u "
     "UNION ALL SELECT event_type, 'all' FROM df WHERE CAST(ts AS DATE) = DATE '2024-01-03'", None),
    ("q17_intersect", "events",
     "SELECT user_id FROM df WHERE CAST(ts AS DATE) = DATE '2024-01-05' "
     "INTERSECT SELECT user_id FROM df WHERE CAST(ts AS DATE) = DATE '2024-01-06'", None),
    ("q18_except", "events",
     "SELECT user_id FROM df WHERE CAST(ts AS DATE) = DATE '2024-01-05' "
     "EXCEPT SELECT user_id FROM df WHERE CAST(ts AS DATE) = DATE '2024-01-06'", None),
    ("q19_top_offset", "lineitem",
     "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM df ORDER BY l_extendedprice DESC, l_orderkey, "
     "l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 10 OFFSET 5", None),
    ("q20_strings", "events",
     "SELECT event_id, upper(event_type) AS up, substring(event_type, 1, 3) AS pre, replace(event_type, 'e', 'E') AS rep, "
     "concat(event_type, '-', CAST(user_id AS STRING)) AS tag, CAST(length(event_type) AS BIGINT) AS len FROM df", None),
    ("q21_dates", "events",
     "SELECT event_id, CAST(date_trunc('month', ts) AS DATE) AS month_start, CAST(extract(DOY FROM ts) - 1 AS BIGINT) AS day_n, "
     "CAST(extract(HOUR FROM ts) AS BIGINT) AS hr FROM df", None),
    ("q22_math", "events",
     "SELECT event_id, round(value, 1) AS r1, CAST(floor(value) AS BIGINT) AS fl, round(power(value, 2), 4) AS sq, "
     "CAST(floor(value) AS BIGINT) % 7 AS m7, round(sqrt(abs(value)), 6) AS rt FROM df", None),
    ("q23_array_unnest", "lineitem",
     "WITH a AS (SELECT l_orderkey, array_agg(l_partkey) AS parts FROM df GROUP BY l_orderkey) "
     "SELECT l_orderkey, partkey FROM a LATERAL VIEW explode(parts) t AS partkey",
     "WITH a AS (SELECT l_orderkey, array_agg(l_partkey) AS parts FROM df GROUP BY l_orderkey) "
     "SELECT l_orderkey, unnest(parts) AS partkey FROM a"),
    ("q24_json", "events",
     "SELECT event_type, round(avg(CAST(get_json_object(props, '$.k') AS DOUBLE)), 4) AS mean_k FROM df GROUP BY event_type",
     "SELECT event_type, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 4) AS mean_k FROM df GROUP BY event_type"),
    ("q25_statistics", "events",
     "SELECT event_type, round(median(value), 6) AS med, round(stddev_samp(value), 6) AS sd FROM df GROUP BY event_type",
     None),
    ("q26_filtered_agg", "events",
     "SELECT event_type, CAST(count(*) FILTER (WHERE value > 100) AS BIGINT) AS n_big, "
     "CAST(count(*) AS BIGINT) AS n FROM df GROUP BY event_type", None),
]


def _oracle(table: str, duck_sql: str) -> str:
    return f"WITH df AS (SELECT * FROM {table})\nSELECT * FROM (\n{duck_sql}\n) q"


def _make(table: str, sql: str):
    def run(spark, sf_dir):
        return preview.query_dataset(spark, f"{sf_dir.rstrip('/')}/{table}.parquet", sql)
    return run


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events")


# Skew-safe plans: one user may hold a third of the rows.
def _q08(spark, sf_dir):
    out = ordered.ranks(_events(spark, sf_dir).select("event_id", "user_id", "value"), "user_id", "value", "event_id")
    return out.select("event_id", "user_id", "rnk", "drnk", "rn")


def _q09(spark, sf_dir):
    ev = _events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    return ordered.neighbours(ev, "user_id", ["ts", "event_id"], "value").select("event_id", "prev_value", "next_value")


def _q10(spark, sf_dir):
    ev = _events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    out = ordered.rows_frame_sum(ev, "user_id", ["ts", "event_id"], "value", 2, out_col="_s")
    return out.select("event_id", F.round("_s", 4).alias("moving_sum"))


def _q11(spark, sf_dir):
    ev = _events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type",
                                       F.col("ts").cast("date").alias("_day"))
    return ordered.count_earlier_pairs(ev, ["user_id", "_day"], "ts", "event_id",
                                       is_left=F.col("event_type") == "error",
                                       is_right=F.col("event_type") == "purchase")


# EXISTS / NOT EXISTS / INTERSECT / EXCEPT of one table with itself: one
# aggregation per user (partial before the shuffle, so a hot user is one row
# per task), no join of raw rows.
def _q12(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return ev.where(F.col("user_id").isNotNull() & (F.col("event_type") == "purchase")).select("user_id").distinct()


def _q13(spark, sf_dir):
    hit = F.max(F.when(F.col("value") > 300, 1).otherwise(0)).alias("_hit")
    per_user = _events(spark, sf_dir).groupBy("user_id").agg(hit)
    # a null user matches no row, so NOT EXISTS holds for it
    return per_user.where((F.col("_hit") == 0) | F.col("user_id").isNull()).select("user_id")


def _days_per_user(spark, sf_dir):
    day = F.col("ts").cast("date")
    d5, d6 = F.lit("2024-01-05").cast("date"), F.lit("2024-01-06").cast("date")
    return (_events(spark, sf_dir).where(day.isin(d5, d6)).groupBy("user_id")
            .agg(F.max((day == d5).cast("int")).alias("_a"), F.max((day == d6).cast("int")).alias("_b")))


def _q17(spark, sf_dir):
    return _days_per_user(spark, sf_dir).where((F.col("_a") == 1) & (F.col("_b") == 1)).select("user_id")


def _q18(spark, sf_dir):
    return _days_per_user(spark, sf_dir).where((F.col("_a") == 1) & (F.col("_b") == 0)).select("user_id")


def _q14(spark, sf_dir):
    from fathom.operators.joins import broadcast_if_small
    ev = _events(spark, sf_dir).select("event_id", "event_type", "value")
    # one row per type: broadcast after a size check, never a shuffle join
    # keyed on a handful of type values
    means = broadcast_if_small(ev.where(F.col("event_type").isNotNull())
                               .groupBy("event_type").agg(F.avg("value").alias("_avg")))
    return ev.join(means, "event_type").where(F.col("value") > F.col("_avg")).select("event_id", "event_type", "value")


def _q25(spark, sf_dir):
    from fathom.operators.position import join_null_safe
    ev = _events(spark, sf_dir).select("event_id", "event_type", "value")
    med = ordered.exact_median(ev, "event_type", "value", "event_id", out_col="_med")
    sd = ev.groupBy("event_type").agg(F.stddev_samp("value").alias("_sd"))
    out = join_null_safe(sd, med, ["event_type"])
    return out.select("event_type", F.round("_med", 6).alias("med"), F.round("_sd", 6).alias("sd"))


def _q23(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = ordered.collect_bounded(li, "l_orderkey", "l_partkey", ["l_linenumber", "l_partkey", "l_suppkey"],
                                    out_col="parts")
    return parts.select("l_orderkey", F.explode("parts").alias("partkey"))


SKEW_SAFE = {"q08_ranking": _q08, "q09_lag_lead": _q09, "q10_moving_sum": _q10, "q11_self_join": _q11,
             "q12_exists": _q12, "q13_not_exists": _q13, "q14_correlated_scalar": _q14,
             "q17_intersect": _q17, "q18_except": _q18, "q23_array_unnest": _q23, "q25_statistics": _q25}

for _id, _table, _spark_sql, _duck_sql in SUITE:
    register(f"sql_{_id}", _oracle(_table, _duck_sql or _spark_sql))(_make(_table, _spark_sql))
    if _id in SKEW_SAFE:
        register(f"ordered_{_id}", _oracle(_table, _duck_sql or _spark_sql))(SKEW_SAFE[_id])


# ---------------------------------------------------------------- P1-P5
PREVIEW_SQL = ("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM df WHERE l_shipdate >= DATE '1997-01-01' "
               "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity;")


@register("preview_user_sql", f"""
WITH df AS (SELECT * FROM lineitem),
q AS ({PREVIEW_SQL.rstrip(';')}),
t AS (SELECT count(*) AS total FROM q)
SELECT q.*, CAST(t.total AS BIGINT) AS total_rows,
  CASE WHEN t.total > least(t.total, 500) THEN format('{{:,}}', least(t.total, 500)) || ' of ' || format('{{:,}}', t.total) || ' rows'
       ELSE format('{{:,}}', t.total) || ' rows' END || ' × 4 columns' AS shape
FROM (SELECT * FROM q LIMIT 500) q CROSS JOIN t
""")
def preview_user_sql(spark, sf_dir):
    from pyspark.sql import functions as F
    result = preview.query_dataset(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet", PREVIEW_SQL)
    total, head = preview.count_and_head(result, preview.DEFAULT_LIMIT)
    n = total.first()["total_rows"]  # one number: the separate COUNT(*) job of a preview
    shown = F.lit(min(n, preview.DEFAULT_LIMIT))
    return (head.withColumn("total_rows", F.lit(n).cast("long"))
            .withColumn("shape", preview.shape_label(preview.row_label(shown, F.col("total_rows")), len(result.columns))))


@register("preview_file_head", """
SELECT * FROM (SELECT * FROM lineitem LIMIT 500) q
""")
def preview_file_head(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem")
    return preview.file_order_head(df, preview.DEFAULT_LIMIT)


@register("preview_blank", """
SELECT * EXCLUDE (file_row_number) FROM read_parquet_df ORDER BY file_row_number LIMIT 500
""".replace("read_parquet_df", "(SELECT *, row_number() OVER () AS file_row_number FROM lineitem)"))
def preview_blank(spark, sf_dir):
    return preview.query_dataset(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet", " ")


@register("replay_full_count", """
SELECT 'total' AS what, CAST(count(*) AS BIGINT) AS n FROM lineitem
UNION ALL SELECT 'shown', CAST(least(count(*), 500) AS BIGINT) FROM lineitem
""")
def replay_full_count(spark, sf_dir):
    from fathom.operators import runfiles
    total, head = runfiles.replay(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet", "")
    return (total.select(F.lit("total").alias("what"), F.col("total_rows").alias("n"))
            .unionByName(head.agg(F.count(F.lit(1)).alias("n")).select(F.lit("shown").alias("what"), "n")))
