"""Run enrichment: status default and class, input names, log link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.catalog import DEFAULT_DOIP_BASE
from fathom.operators.joins import broadcast_if_small

# Status classes (case-insensitive) and the log file name.
STATUS_CLASSES = [
    (("completed", "success"), "bg-green-100 text-green-700"),
    (("failed", "error"), "bg-red-100 text-red-700"),
    (("running", "in_progress"), "bg-blue-100 text-blue-700"),
]
OTHER_STATUS_CLASS = "bg-gray-100 text-gray-600"
LOG_NAME = "run.log"


def effective_status(status: Column, output_files: Column) -> Column:
    """Given status, else ``completed`` when there is any output, else ``""``."""
    s = F.coalesce(status, F.lit(""))
    return (F.when(s != "", s)
            .when(F.size(output_files) > 0, F.lit("completed"))
            .otherwise(F.lit("")))


def status_class(status: Column) -> Column:
    """R2: badge class of a status, case-insensitive."""
    s = F.lower(F.coalesce(status, F.lit("")))
    out = None
    for names, cls in STATUS_CLASSES:
        cond = s.isin(*names)
        out = F.when(cond, F.lit(cls)) if out is None else out.when(cond, F.lit(cls))
    return out.otherwise(F.lit(OTHER_STATUS_CLASS))


def log_url(output_files: Column, qid: Column, base: str = DEFAULT_DOIP_BASE) -> Column:
    """First output whose url holds ``run.log``, else the link built from the qid."""
    built = F.when(F.coalesce(qid, F.lit("")) != "",
                   F.concat(F.lit(base.rstrip("/") + "/doip/retrieve/"), qid, F.lit("/output/" + LOG_NAME)))
    return F.coalesce(F.get(F.filter(output_files, lambda u: F.contains(u, F.lit(LOG_NAME))), 0),
                      built, F.lit(""))


def name_map(datasets: DataFrame) -> DataFrame:
    """qid -> dataset name, last row in feed order wins (pre-aggregated, one row per qid)."""
    return datasets.groupBy("qid").agg(F.max_by("name", "ord").alias("_name"))


def resolve_inputs(runs: DataFrame, names: DataFrame, key: str = "ord",
                   qids_col: str = "input_dataset_qids", out_col: str = "input_names") -> DataFrame:
    """Each input qid to its dataset name; the qid itself when unknown or the
    name is blank. Order and duplicates are kept.

    The run rows are exploded whole (an outer explode: runs without inputs
    keep an empty list), joined to the one-row-per-qid name map and grouped
    back, so the runs are computed once. The name map is stored and measured:
    broadcast when small, else joined with AQE splitting a hot dataset."""
    ex = runs.select(F.struct(*runs.columns).alias("_run"), F.posexplode_outer(F.col(qids_col)).alias("_pos", "_q"))
    small = broadcast_if_small(names)
    named = ex.join(small, ex["_q"] == small["qid"], "left").select(
        F.col("_run").getField(key).alias("_key"), "_run",
        F.when(F.col("_pos").isNotNull(), F.struct(
            "_pos", F.when(F.coalesce(F.col("_name"), F.lit("")) != "", F.col("_name")).otherwise(F.col("_q")).alias("_n"))).alias("_e"))
    nested = named.groupBy("_key").agg(F.any_value("_run").alias("_run"), F.sort_array(F.collect_list("_e")).alias("_l"))
    return nested.select("_run.*", F.transform("_l", lambda e: e["_n"]).alias(out_col))


def enrich_runs(runs: DataFrame, datasets: DataFrame, base: str = DEFAULT_DOIP_BASE) -> DataFrame:
    """R1-R4 on a model run table."""
    status = effective_status(F.col("status"), F.col("output_files"))
    out = (runs.withColumn("status", status)
           .withColumn("status_cls", status_class(F.col("status")))
           .withColumn("log_url", log_url(F.col("output_files"), F.col("qid"), base)))
    return resolve_inputs(out, name_map(datasets))
