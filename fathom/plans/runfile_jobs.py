"""Run-file discovery, load-plan and loading jobs."""

from __future__ import annotations

from fathom.operators import fileload, runfiles
from fathom.operators.catalog import DEFAULT_DOIP_BASE
from fathom.plans.registry import register
from fathom.sources import bindings
from fathom.sources.bindings import RESOURCE_ORDER, RUN_COMPONENT_SQL, RUN_STATUS

DOIP = DEFAULT_DOIP_BASE
_ORDER = ", ".join(RESOURCE_ORDER)

_ORACLE = f"""
WITH li AS (
  SELECT l_orderkey AS run_key, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS pos,
    {RUN_COMPONENT_SQL['cid']} AS cid, {RUN_COMPONENT_SQL['at_id']} AS at_pre,
    {RUN_COMPONENT_SQL['prov_url']} AS prov_url, {RUN_COMPONENT_SQL['prov_is_object']} AS prov_obj,
    {RUN_COMPONENT_SQL['prov_query']} AS prov_query
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = '{RUN_STATUS}'),
comps AS (
  SELECT run_key, 'Q' || CAST(run_key AS VARCHAR) AS qid, pos, cid, coalesce(at_pre || cid, '') AS at_id,
    CASE WHEN ends_with(lower(cid), '.parquet') THEN '.parquet' WHEN ends_with(lower(cid), '.tsv') THEN '.tsv'
         WHEN ends_with(lower(cid), '.csv') THEN '.csv' END AS ext,
    '{DOIP}/doip/retrieve/Q' || CAST(run_key AS VARCHAR) || '/'
      || regexp_replace(coalesce(at_pre || cid, 'output/' || cid), '^components/', '') AS url
  FROM li),
disc AS (SELECT * FROM comps WHERE ext IS NOT NULL),
inputs AS (SELECT run_key, qid, 0 AS stage, pos, cid AS label, url, ext, '' AS query FROM disc
           WHERE cid <> 'input_annotated.parquet' AND starts_with(at_id, 'components/input/') AND ext = '.parquet'),
outputs AS (SELECT run_key, qid, 2 AS stage, pos, cid AS label, url, ext, '' AS query FROM disc
            WHERE cid <> 'input_annotated.parquet' AND NOT starts_with(at_id, 'components/input/')),
prov AS (SELECT run_key, pos, prov_url AS url,
           split_part(regexp_replace(split_part(prov_url, '?', 1), '/+$', ''), '/', -1) AS filename,
           CASE WHEN prov_obj THEN prov_query ELSE '' END AS query FROM li),
prov_new AS (SELECT p.* FROM prov p WHERE ends_with(lower(filename), '.parquet')
             AND NOT EXISTS (SELECT 1 FROM inputs i WHERE i.run_key = p.run_key AND i.label = p.filename)),
prov_first AS (SELECT run_key, filename, min(pos) AS pos, arg_min(url, pos) AS url, arg_min(query, pos) AS query
               FROM prov_new GROUP BY run_key, filename),
prov_rows AS (SELECT run_key, 'Q' || CAST(run_key AS VARCHAR) AS qid, 1 AS stage, pos,
                CASE WHEN query <> '' THEN filename || ' (filtered)' ELSE filename END AS label, url,
                '.parquet' AS ext, query FROM prov_first),
plan AS (SELECT * FROM inputs UNION ALL SELECT * FROM prov_rows UNION ALL SELECT * FROM outputs),
g1 AS (SELECT run_key FROM disc GROUP BY run_key HAVING bool_or(contains(lower(cid), 'predictions'))),
g2 AS (SELECT run_key FROM plan GROUP BY run_key HAVING bool_or(contains(lower(label), 'predictions')))
SELECT run_key, qid, CAST(stage AS INTEGER) AS stage, CAST(pos AS INTEGER) AS pos, label, url, ext, query FROM plan
WHERE run_key IN (SELECT run_key FROM g1) AND run_key IN (SELECT run_key FROM g2)
"""


@register("runfiles_load_plan", _ORACLE)
def runfiles_load_plan(spark, sf_dir):
    from pyspark.sql import functions as F
    runs = runfiles.parse_run_meta(bindings.run_meta_docs(spark, sf_dir))
    plan = runfiles.load_plan(runs, DOIP)
    return plan.select("run_key", "qid", F.col("stage").cast("int"), F.col("pos").cast("int"),
                       "label", "url", "ext", "query")


# ---------------------------------------------------------------- X2, X4-X10, X22 over files
# One run per nation. Its files are written by Spark into the shared folder:
# an input of its suppliers, predictions of its customers, and two provenance
# sources of the input, the second in several parts and with a column more.
# Some inputs and first sources are missing, some first sources have a
# recorded query, some predictions are CSV and some are no table at all.
_QUERY = "SELECT s_suppkey, s_acctbal FROM df WHERE s_suppkey % 2 = 0 ORDER BY s_suppkey DESC"


def _run_files(spark, sf_dir):
    """(run documents, root of the written files)."""
    import uuid

    from pyspark.sql import functions as F

    from fathom.session import checkpoint_dir, read_table
    root = f"{checkpoint_dir(spark).rstrip('/')}/run-files-{uuid.uuid4().hex}"
    sup = read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("run"), "s_suppkey", "s_acctbal")
    cust = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("run"), "c_custkey", "c_mktsegment")

    def write(df, kind, fmt="parquet", parts=None):
        dealt = df.withColumn("kind", F.lit(kind)).repartition(*([parts] if parts else ["run"]))
        dealt.write.mode("append").partitionBy("kind", "run").format(fmt).option("header", True).save(root)

    write(sup.where("run % 3 <> 0"), "input")
    write(sup.where("run % 2 = 0"), "first")
    write(sup.withColumn("source", F.lit("second")), "second", parts=3)
    write(cust.where("run % 5 NOT IN (0, 1)"), "predictions")
    write(cust.where("run % 5 = 1"), "predictions", "csv", parts=2)
    write(cust.where("run % 5 = 0").groupBy("run").agg(F.min(F.lit("not a table")).alias("value")), "predictions", "text")
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("run_key"))
    key = F.col("run_key").cast("string")
    name = F.when(F.expr("run_key % 5 = 1"), "predictions.csv").otherwise("predictions.parquet")
    comp = lambda at, cid: F.struct(F.concat(F.lit(at), cid).alias("@id"), cid.alias("componentId"))
    url = lambda kind: F.concat(F.lit(f"https://files.example/{kind}/"), key, F.lit("/in.parquet"))
    recorded = F.to_json(F.struct(url("first").alias("@id"), F.lit(_QUERY).alias("schema:query")))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    used = F.concat(F.lit("["), F.when(F.expr("run_key % 2 = 0"), recorded).otherwise(quoted(url("first"))), F.lit(","), quoted(url("second")), F.lit("]"))
    kernel = F.to_json(F.struct(F.array(comp("components/input/", F.lit("in.parquet")), comp("components/output/", name)).alias("fdo:hasComponent")))
    doc = F.concat(F.lit('{"@id":"Q'), key, F.lit('","kernel":'), kernel, F.lit(',"provenance":{"prov:used":'), used, F.lit("}}"))
    return nation.select("run_key", F.concat(F.lit("Q"), key).alias("qid"), doc.alias("meta_json")), root


def _loaded(spark, sf_dir):
    from pyspark.sql import functions as F
    docs, root = _run_files(spark, sf_dir)
    plan = runfiles.load_plan(runfiles.parse_run_meta(docs), DOIP, candidates=True)
    kind = F.when(F.col("stage") == 1, F.regexp_extract("url", "example/([a-z]+)/", 1)).when(F.col("stage") == 0, "input").otherwise("predictions")
    placed = plan.withColumn("path", F.concat(F.lit("kind="), kind, F.lit("/run="), F.col("run_key").cast("string")))
    return fileload.load_files(spark, placed, root)


_FILES = """
WITH n AS (
  SELECT n_nationkey, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS has_s,
         EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) AS has_c FROM nation),
files AS (
  SELECT n_nationkey AS run_key, 0 AS stage, 0 AS pos, 'in.parquet' AS label, n_nationkey % 3 <> 0 AND has_s AS good, 'input' AS kind FROM n
  UNION ALL SELECT n_nationkey, 1, 0, CASE WHEN n_nationkey % 2 = 0 THEN 'in.parquet (filtered)' ELSE 'in.parquet' END, n_nationkey % 2 = 0 AND has_s, 'first' FROM n
  UNION ALL SELECT n_nationkey, 1, 1, 'in.parquet', has_s, 'second' FROM n
  UNION ALL SELECT n_nationkey, 2, 1, CASE WHEN n_nationkey % 5 = 1 THEN 'predictions.csv' ELSE 'predictions.parquet' END, n_nationkey % 5 <> 0 AND has_c, 'predictions' FROM n),
report AS (
  SELECT f.*, CASE WHEN stage = 1 AND EXISTS (SELECT 1 FROM files e WHERE e.run_key = f.run_key AND e.stage < 2 AND e.good
                                             AND (e.stage, e.pos) < (f.stage, f.pos)) THEN 'skipped'
                   WHEN good THEN 'ok' ELSE 'failed' END AS status FROM files f),
shown AS (SELECT DISTINCT run_key FROM report WHERE stage = 2 AND status = 'ok'),
good AS (SELECT r.* FROM report r JOIN shown USING (run_key) WHERE status = 'ok'),
rows AS (
  SELECT g.run_key, g.stage, g.label, s_suppkey AS id, CAST(s_acctbal AS DOUBLE) AS other FROM good g JOIN supplier ON s_nationkey = g.run_key
  WHERE g.kind IN ('input', 'first', 'second') AND (g.label = 'in.parquet' OR s_suppkey % 2 = 0)
  UNION ALL SELECT g.run_key, g.stage, g.label, c_custkey, NULL FROM good g JOIN customer ON c_nationkey = g.run_key WHERE g.kind = 'predictions')
"""


@register("runfiles_report", _FILES + """
SELECT run_key, CAST(stage AS INTEGER) AS stage, CAST(pos AS INTEGER) AS pos, label, status, status = 'failed' AS has_error,
  run_key IN (SELECT run_key FROM shown) AS shown FROM report
""")
def runfiles_report(spark, sf_dir):
    from pyspark.sql import functions as F
    report = _loaded(spark, sf_dir)[2]
    return report.select("run_key", F.col("stage").cast("int"), F.col("pos").cast("int"), "label", "status", F.col("error").isNotNull().alias("has_error"), "shown")


@register("runfiles_loaded", _FILES + """
SELECT run_key, label, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(id) AS BIGINT) AS id_sum,
  CAST(CASE WHEN stage = 1 THEN count(*) * (count(*) + 1) / 2 END AS BIGINT) AS x_sum
FROM rows GROUP BY run_key, label, stage
""")
def runfiles_loaded(spark, sf_dir):
    from pyspark.sql import functions as F
    rows = _loaded(spark, sf_dir)[0]
    number = lambda names: F.sum(F.when(F.col("column").isin(*names), F.col("value").cast("long")))
    return rows.groupBy("run_key", "label").agg(F.max("row_pos").alias("n_rows"), number(["s_suppkey", "c_custkey"]).alias("id_sum"),
                                                number(["x_auto_converted"]).alias("x_sum"))


# ---------------------------------------------------------------- X6: recorded queries applied
@register("runfiles_filtered", _FILES + """
SELECT run_key, CAST(row_number() OVER (PARTITION BY run_key ORDER BY id DESC) AS BIGINT) AS row_pos, CAST(id AS BIGINT) AS s_suppkey,
  other AS s_acctbal, CAST(row_number() OVER (PARTITION BY run_key ORDER BY id DESC) AS BIGINT) AS x_auto_converted
FROM rows WHERE label = 'in.parquet (filtered)'
""")
def runfiles_filtered(spark, sf_dir):
    """The rows of every file that carries the `` (filtered)`` label."""
    from pyspark.sql import functions as F
    rows = _loaded(spark, sf_dir)[0].where(F.col("label").endswith(runfiles.FILTERED_SUFFIX))
    value = lambda c, t: F.max(F.when(F.col("column") == c, F.col("value").cast(t))).alias(c)
    return rows.groupBy("run_key", "row_pos").agg(value("s_suppkey", "long"), value("s_acctbal", "double"), value("x_auto_converted", "long"))


# ---------------------------------------------------------------- X10, X11: every column of every file
@register("runfiles_columns", _FILES + """
, sizes AS (SELECT g.run_key, g.label, g.kind, g.stage, count(r.id) AS n FROM good g LEFT JOIN rows r ON r.run_key = g.run_key AND r.label = g.label GROUP BY ALL),
cols(kind, ordinal, "column", type, is_numeric) AS (VALUES
  ('supplier', 0, 's_suppkey', 'bigint', TRUE), ('supplier', 1, 's_acctbal', 'double', TRUE), ('second', 2, 'source', 'string', FALSE),
  ('predictions', 0, 'c_custkey', 'bigint', TRUE), ('predictions', 1, 'c_mktsegment', 'string', FALSE)),
every AS (
  SELECT s.run_key, s.label, c.ordinal, c."column", c.type, s.n, c.is_numeric FROM sizes s JOIN cols c
    ON c.kind = s.kind OR (c.kind = 'supplier' AND s.kind IN ('input', 'first', 'second'))
  UNION ALL SELECT run_key, label, CASE WHEN kind = 'second' THEN 3 ELSE 2 END, 'x_auto_converted', 'bigint', n, TRUE FROM sizes WHERE stage = 1)
SELECT run_key, label || ': ' || "column" AS key, CAST(ordinal AS INTEGER) AS ordinal, type, CAST(n AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_gaps, is_numeric FROM every
""")
def runfiles_columns(spark, sf_dir):
    """The typed column catalogue of all files of all runs."""
    return _loaded(spark, sf_dir)[1].select("run_key", "key", "ordinal", "type", "n_rows", "n_gaps", "is_numeric")
