"""Run-result series jobs (X9-X18) over the events-derived run files."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions.text import gap_to_null
from fathom.operators import series
from fathom.plans.registry import register
from fathom.session import cut_lineage, read_table
from fathom.sources import bindings
from fathom.sources.bindings import SERIES_FILES_WITH_X, SERIES_LABEL_SQL, SERIES_X_SQL, SERIES_Y_SQL

X_FILE = "click"
Y_FILES = ("view", "purchase", "signup")
ZIP_FILE = "purchase"
_WITH_X = ", ".join(f"'{f}'" for f in SERIES_FILES_WITH_X)


def _stored_rows(spark, sf_dir):
    """The numbered rows, stored once: a chart takes several files from them."""
    return cut_lineage(bindings.series_rows(spark, sf_dir))


def _with_series(body: str) -> str:
    body = body.lstrip("\n")
    if body.startswith(","):
        body = ",\n" + body[1:].lstrip()
    return (f"WITH s0 AS (SELECT event_type AS file_id, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts, event_id) "
            f"AS row_pos, {SERIES_LABEL_SQL} AS label, {SERIES_Y_SQL} AS y_text FROM events),\n"
            f"s AS (SELECT *, CASE WHEN file_id IN ({_WITH_X}) THEN {SERIES_X_SQL} END AS x_auto_converted FROM s0)\n{body}")


_GAP = "CASE WHEN {0} IN ('', 'nan', 'None') THEN NULL ELSE {0} END"
# the texts that occur here are plain decimals, gaps and words
_NUM_RE = "^ *[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)? *$"


# ---------------------------------------------------------------- X9 (dense positions)
@register("series_positions", _with_series("""
SELECT file_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(min(row_pos) AS BIGINT) AS first_pos,
  CAST(max(row_pos) AS BIGINT) AS last_pos, CAST(sum(CAST(row_pos AS HUGEINT) * row_pos) AS VARCHAR) AS pos_sq_sum,
  CAST(sum(CASE WHEN row_pos = 1 THEN length(label) ELSE 0 END) AS BIGINT) AS first_label_len,
  min(label) FILTER (WHERE row_pos = 7) AS label_at_7, min(y_text) FILTER (WHERE row_pos = 100) AS y_at_100
FROM s GROUP BY file_id
"""))
def series_positions(spark, sf_dir):
    rows = bindings.series_rows(spark, sf_dir)
    return rows.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("row_pos").alias("first_pos"), F.max("row_pos").alias("last_pos"),
        F.sum(F.col("row_pos").cast("decimal(19,0)") * F.col("row_pos").cast("decimal(18,0)")).cast("string").alias("pos_sq_sum"),
        F.sum(F.when(F.col("row_pos") == 1, F.length("label")).otherwise(0)).cast("long").alias("first_label_len"),
        F.min(F.when(F.col("row_pos") == 7, F.col("label"))).alias("label_at_7"),
        F.min(F.when(F.col("row_pos") == 100, F.col("y_text"))).alias("y_at_100"))


# ---------------------------------------------------------------- X10 X11
@register("series_profile", _with_series(f"""
, cols AS (
  SELECT file_id, 'x_auto_converted' AS "column", 0 AS ordinal, CAST(x_auto_converted AS VARCHAR) AS value FROM s
    WHERE file_id IN ({_WITH_X})
  UNION ALL SELECT file_id, 'label', 1, label FROM s
  UNION ALL SELECT file_id, 'y_text', 2, y_text FROM s)
SELECT file_id, "column", ordinal, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(*) FILTER (WHERE value IS NULL OR value IN ('', 'nan', 'None')) AS BIGINT) AS n_gaps,
  bool_and(value IS NULL OR value = '' OR regexp_matches(value, '{_NUM_RE}')) AS is_numeric,
  file_id || ': ' || "column" AS key
FROM cols GROUP BY file_id, "column", ordinal
"""))
def series_profile(spark, sf_dir):
    rows = bindings.series_rows(spark, sf_dir)
    prof = series.column_profile(rows, ["x_auto_converted", "label", "y_text"])
    has_x = F.col("file_id").isin(*SERIES_FILES_WITH_X)
    return (prof.where((F.col("column") != "x_auto_converted") | has_x)
            .withColumn("ordinal", F.col("ordinal").cast("int")))


# ---------------------------------------------------------------- X12-X14
@register("series_numeric_pairs", _with_series(f"""
SELECT file_id, row_pos, CAST(x_auto_converted AS DOUBLE) AS x, {_GAP.format('y_text')} AS y FROM s WHERE file_id = 'view'
UNION ALL
SELECT p.file_id, p.row_pos, CAST(c.x_auto_converted AS DOUBLE) AS x, {_GAP.format('p.y_text')} AS y
FROM s p JOIN s c ON c.row_pos = p.row_pos AND c.file_id = '{X_FILE}' WHERE p.file_id = '{ZIP_FILE}'
"""))
def series_numeric_pairs(spark, sf_dir):
    rows = _stored_rows(spark, sf_dir)
    own = series.numeric_pairs(rows.where(F.col("file_id") == "view"), None, "y_text", "x_auto_converted")
    other = series.numeric_pairs(rows.where(F.col("file_id") == ZIP_FILE), rows.where(F.col("file_id") == X_FILE),
                                 "y_text", "x_auto_converted")
    return own.unionByName(other)


# ---------------------------------------------------------------- X15-X17
def _series_name(f: str) -> str:
    return f"{f}: y_text"


_SR = "\n  UNION ALL ".join(
    (f"SELECT '{_series_name(f)}' AS series, row_pos, x_auto_converted AS x, y_text FROM s WHERE file_id = '{f}'"
     if f in SERIES_FILES_WITH_X else
     f"SELECT '{_series_name(f)}', p.row_pos, c.x_auto_converted, p.y_text FROM s p JOIN s c ON c.row_pos = p.row_pos "
     f"AND c.file_id = '{X_FILE}' WHERE p.file_id = '{f}'")
    for f in Y_FILES)
_NAMES = "\n  UNION ALL ".join(f"SELECT '{_series_name(f)}' AS series" for f in Y_FILES)


@register("series_sparse", _with_series(f"""
, labels AS (SELECT CAST(trunc(x_auto_converted) AS BIGINT) AS pos, arg_max(label, row_pos) AS label
             FROM s WHERE file_id = '{X_FILE}' GROUP BY 1),
sr AS ({_SR}),
pts AS (SELECT series, CAST(trunc(x) AS BIGINT) AS pos, arg_max_null({_GAP.format('y_text')}, row_pos) AS y FROM sr GROUP BY 1, 2),
ax AS (SELECT p.pos, coalesce(l.label, CAST(p.pos AS VARCHAR)) AS category
       FROM (SELECT pos FROM labels UNION SELECT pos FROM pts) p LEFT JOIN labels l USING (pos)),
names AS ({_NAMES})
SELECT ax.pos, ax.category, names.series, pts.y FROM ax CROSS JOIN names LEFT JOIN pts ON pts.pos = ax.pos AND pts.series = names.series
"""))
def series_sparse(spark, sf_dir):
    rows = _stored_rows(spark, sf_dir)
    x_rows = rows.where(F.col("file_id") == X_FILE)
    labels = series.position_labels(x_rows, "x_auto_converted", "label")
    # every y series in one pass: a file with its own x column keeps it, the
    # others take the x file's value at the same row (rows past its end drop)
    xs = x_rows.select("row_pos", F.col("x_auto_converted").alias("_x"), F.lit(True).alias("_has_x"))
    own = F.col("file_id").isin(*SERIES_FILES_WITH_X)
    sr = (rows.where(F.col("file_id").isin(*Y_FILES)).join(xs, "row_pos", "left")
          .where(own | F.col("_has_x").isNotNull())
          .select(F.concat(F.col("file_id"), F.lit(": y_text")).alias("series"), "row_pos",
                  F.when(own, F.col("x_auto_converted")).otherwise(F.col("_x")).alias("x_auto_converted"),
                  "y_text"))
    pts = series.series_points(sr, "x_auto_converted", "y_text")
    return series.sparse_align(labels, pts, [_series_name(f) for f in Y_FILES])


# ---------------------------------------------------------------- X18
@register("series_category_zip", _with_series(f"""
SELECT p.file_id, p.row_pos, c.label AS x, {_GAP.format('p.y_text')} AS y
FROM s p JOIN s c ON c.row_pos = p.row_pos AND c.file_id = '{X_FILE}' WHERE p.file_id = '{ZIP_FILE}'
"""))
def series_category_zip(spark, sf_dir):
    rows = _stored_rows(spark, sf_dir)
    return series.category_zip(rows.where(F.col("file_id") == X_FILE), rows.where(F.col("file_id") == ZIP_FILE),
                               "label", "y_text")


# ---------------------------------------------------------------- X13 spellings
_SPELLED = ("CASE event_id % 7 WHEN 0 THEN 'nan' WHEN 1 THEN 'NaN' WHEN 2 THEN 'None' WHEN 3 THEN '' WHEN 4 THEN 'NAN' "
            "WHEN 5 THEN 'none' ELSE event_type END")


@register("series_gaps", f"""
SELECT y, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN {_SPELLED} NOT IN ('', 'nan', 'None') THEN {_SPELLED} END AS y FROM events)
GROUP BY y
""")
def series_gaps(spark, sf_dir):
    y = read_table(spark, sf_dir, "events").select(gap_to_null(F.expr(_SPELLED)).alias("y"))
    return y.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- X18 axis
@register("series_axis", _with_series(f"""
SELECT c.row_pos, c.label AS x, p.row_pos IS NOT NULL AS in_range
FROM s c LEFT JOIN s p ON p.row_pos = c.row_pos AND p.file_id = '{ZIP_FILE}' WHERE c.file_id = '{X_FILE}'
"""))
def series_axis(spark, sf_dir):
    rows = _stored_rows(spark, sf_dir)
    return series.category_axis(rows.where(F.col("file_id") == X_FILE), rows.where(F.col("file_id") == ZIP_FILE), "label")


# ---------------------------------------------------------------- X15 labels of another file
@register("series_labels_other_file", _with_series(f"""
SELECT CAST(trunc(c.x_auto_converted) AS BIGINT) AS pos, arg_max(p.label, c.row_pos) AS label
FROM s c JOIN s p ON p.row_pos = c.row_pos AND p.file_id = '{ZIP_FILE}' WHERE c.file_id = '{X_FILE}' GROUP BY 1
"""))
def series_labels_other_file(spark, sf_dir):
    rows = _stored_rows(spark, sf_dir)
    return series.position_labels(rows.where(F.col("file_id") == X_FILE), "x_auto_converted", "label",
                                  rows.where(F.col("file_id") == ZIP_FILE))


# ---------------------------------------------------------------- X16, X17 over all runs
# every user is a run, every event type but the clicks a series over days; the clicks give the labels
_DAY = "CAST({day} AS BIGINT)"
_SPARK_DAY, _DUCK_DAY = "datediff(CAST(ts AS DATE), DATE'1970-01-01')", "date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))"

_RUN_SERIES = f"""
WITH e AS (SELECT user_id AS run_key, event_type AS series, event_id, {_DAY.format(day=_DUCK_DAY)} AS pos, {SERIES_Y_SQL} AS y_text FROM events),
labels AS (SELECT run_key, pos, arg_max('click ' || CAST(event_id AS VARCHAR), event_id) AS label FROM e WHERE series = 'click' GROUP BY ALL),
pts AS (SELECT run_key, series, pos, arg_max_null({_GAP.format('y_text')}, event_id) AS y FROM e WHERE series <> 'click' GROUP BY run_key, series, pos),
ax AS (SELECT run_key, pos, row_number() OVER (PARTITION BY run_key ORDER BY pos) AS place, count(*) OVER (PARTITION BY run_key) AS n
       FROM (SELECT run_key, pos FROM labels UNION SELECT run_key, pos FROM pts)),
vals AS (SELECT p.run_key, series, y, place, n, coalesce(lag(place) OVER w, 0) AS prev, lead(place) OVER w AS following
         FROM pts p JOIN ax USING (run_key, pos) WHERE y IS NOT NULL WINDOW w AS (PARTITION BY p.run_key, series ORDER BY place)),
ranges AS (
  SELECT run_key, series, place AS a, place AS b, y FROM vals
  UNION ALL SELECT run_key, series, prev + 1, place - 1, NULL FROM vals WHERE place > prev + 1
  UNION ALL SELECT run_key, series, place + 1, n, NULL FROM vals WHERE following IS NULL AND place < n
  UNION ALL SELECT p.run_key, series, 1, any_value(n), NULL FROM pts p JOIN ax USING (run_key, pos) GROUP BY p.run_key, series HAVING count(y) = 0)
"""


@register("series_sparse_all", _RUN_SERIES + """
SELECT r.run_key, r.series, f.pos AS from_pos, t.pos AS to_pos, CAST(b - a + 1 AS BIGINT) AS n_positions, r.y
FROM ranges r JOIN ax f ON f.run_key = r.run_key AND f.place = a JOIN ax t ON t.run_key = r.run_key AND t.place = b
""")
def series_sparse_all(spark, sf_dir):
    """Every series of every run on its run's axis, gaps as ranges."""
    ev = read_table(spark, sf_dir, "events", spread=True)
    rows = ev.select(F.col("user_id").alias("run_key"), F.col("event_type").alias("series"), F.col("event_id").alias("row_pos"),
                     F.expr(_DAY.format(day=_SPARK_DAY)).alias("pos"), F.expr(SERIES_Y_SQL).alias("y_text"))
    labels = (rows.where("series = 'click'").groupBy("run_key", "pos")
              .agg(F.max_by(F.concat(F.lit("click "), F.col("row_pos").cast("string")), "row_pos").alias("label")))
    last = F.max(F.struct("row_pos", gap_to_null(F.col("y_text")).alias("y")))
    points = rows.where("series <> 'click'").groupBy("run_key", "series", "pos").agg(last.alias("l")).select("run_key", "series", "pos", F.col("l.y").alias("y"))
    return series.sparse_ranges(labels, points)
