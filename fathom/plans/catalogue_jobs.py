"""Catalogue ETL and browse jobs over the package bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import browse, catalog
from fathom.plans.oracle_bindings import with_catalogue
from fathom.plans.registry import register
from fathom.sources import bindings

AS_OF = "2024-02-01 00:00:00"
DOIP = catalog.DEFAULT_DOIP_BASE


def _pkgs(spark: SparkSession, sf_dir: str, resources: bool = True) -> DataFrame:
    return bindings.packages(spark, sf_dir, resources)


def _joined(arr, sep: str = "|"):
    return F.array_join(arr, sep)


# ---------------------------------------------------------------- C5 C6 C11
@register("catalog_processed_datasets", with_catalogue(f"""
SELECT x_qid AS qid, coalesce(title, '') AS name, coalesce(notes, '') AS description, url AS source_url,
  coalesce((SELECT url FROM pkg_resources r WHERE r.pkg_id = px.pkg_id AND upper(format) = 'PARQUET'
            ORDER BY pos LIMIT 1), '') AS data_path,
  x_modified AS last_modified, metadata_created,
  CASE WHEN x_qid <> '' THEN '{DOIP}/doip/retrieve/' || x_qid ELSE '' END AS doip_url,
  coalesce((SELECT string_agg(name || '=' || url, '|' ORDER BY pos) FROM pkg_resources r
            WHERE r.pkg_id = px.pkg_id AND upper(format) = 'PARQUET'), '') AS components,
  CAST((SELECT count(*) FROM pkg_resources r WHERE r.pkg_id = px.pkg_id AND upper(format) = 'PARQUET') AS BIGINT)
    AS n_components,
  x_additional_type AS additional_type
FROM px WHERE grp = 'type-raw-data'
"""))
def catalog_processed_datasets(spark, sf_dir):
    ds, _ = catalog.split_rejects(catalog.processed_datasets(_pkgs(spark, sf_dir)))
    return ds.select(
        *catalog.PUBLISHED["processed_datasets"],
        _joined(F.transform("components", lambda c: F.concat(c["name"], F.lit("="), c["url"]))).alias("components"),
        F.size("components").cast("long").alias("n_components"),
        "additional_type")


# ---------------------------------------------------------------- B1 B8 B11 (flagship)
FLAGSHIP_NEEDLE = "Plate"


@register("browse_datasets_search", with_catalogue(f"""
SELECT x_qid AS qid, coalesce(title, '') AS name, x_modified AS last_modified
FROM px
WHERE grp = 'type-raw-data'
  AND (contains(lower(coalesce(title, '')), lower('{FLAGSHIP_NEEDLE}')) OR contains(lower(coalesce(notes, '')), lower('{FLAGSHIP_NEEDLE}')))
ORDER BY x_modified DESC, pkg_id
LIMIT 10
"""))
def browse_datasets_search(spark, sf_dir):
    ds = catalog.processed_datasets(_pkgs(spark, sf_dir, resources=False))
    hits = browse.search(ds, FLAGSHIP_NEEDLE, ["name", "description"])
    page = browse.page(hits, browse.newest_first("last_modified"), size=10)
    return page.select("qid", "name", "last_modified")


# ---------------------------------------------------------------- C7 C14
_FIRST_PARQUET = ("(SELECT {col} FROM pkg_resources r WHERE r.pkg_id = px.pkg_id AND upper(format) = 'PARQUET' "
                  "ORDER BY pos LIMIT 1)")


@register("catalog_raw_datasets", with_catalogue(f"""
SELECT coalesce(title, '') AS path, {_FIRST_PARQUET.format(col='size')} AS size_bytes, x_modified AS last_modified
FROM px WHERE grp = 'type-raw-data' AND {_FIRST_PARQUET.format(col='size')} IS NOT NULL
"""))
def catalog_raw_datasets(spark, sf_dir):
    ok, _ = catalog.split_rejects(catalog.raw_datasets(_pkgs(spark, sf_dir)))
    return catalog.publish(ok, "raw_datasets")


# ---------------------------------------------------------------- C2 C3 C4 C12 M4
_PARAMS_OK = ("(CASE WHEN x_model_parameters = '' THEN TRUE WHEN json_valid(x_model_parameters) "
              "THEN json_type(x_model_parameters) = 'ARRAY' ELSE FALSE END)")

_MODELS_BODY = f"""
prm AS (
  SELECT pkg_id, unnest(from_json(x_model_parameters, '["JSON"]')) AS e,
         generate_subscripts(from_json(x_model_parameters, '["JSON"]'), 1) AS i
  FROM px WHERE grp = 'type-model' AND x_model_parameters <> '' AND {_PARAMS_OK}),
named AS (SELECT pkg_id, i, json_extract_string(e, '$.name') AS name, json_extract(e, '$.value') AS value FROM prm),
dedup AS (SELECT pkg_id, name, min(i) AS first_i, arg_max(value, i) AS value FROM named GROUP BY pkg_id, name),
cfg AS (SELECT pkg_id, '{{' || string_agg(to_json(name) || ':' || CAST(value AS VARCHAR), ',' ORDER BY first_i) || '}}' AS config_json,
        count(*) AS n_keys FROM dedup GROUP BY pkg_id),
np AS (SELECT pkg_id, count(*) AS n_params FROM named GROUP BY pkg_id),
m AS (
  SELECT px.pkg_id, x_model_qid AS qid, coalesce(title, '') AS name, x_docker_image AS docker_image, x_docker_tag AS docker_tag,
    coalesce(notes, '') AS description,
    CASE WHEN x_model_qid <> '' THEN '{DOIP}/doip/retrieve/' || x_model_qid ELSE '' END AS doip_url,
    CASE WHEN url <> '' THEN url WHEN starts_with(x_docker_image, 'ghcr.io/') THEN 'https://github.com/' || substring(x_docker_image, 9)
         ELSE '' END AS git_repo,
    CAST(coalesce(np.n_params, 0) AS BIGINT) AS n_params, coalesce(cfg.config_json, '{{}}') AS config_json
  FROM px LEFT JOIN cfg USING (pkg_id) LEFT JOIN np USING (pkg_id)
  WHERE grp = 'type-model' AND {_PARAMS_OK})"""


def _valid_models(spark, sf_dir):
    ok, _ = catalog.split_rejects(catalog.models(_pkgs(spark, sf_dir)))
    return ok


@register("catalog_models", with_catalogue(f""", {_MODELS_BODY.lstrip()}
SELECT qid, name, docker_image, docker_tag, description, doip_url, git_repo, n_params, config_json FROM m
"""))
def catalog_models(spark, sf_dir):
    from fathom.functions.nested import params_to_config_json
    m = _valid_models(spark, sf_dir)
    return m.select(*catalog.PUBLISHED["models"],
                    F.size("additional_properties").cast("long").alias("n_params"),
                    params_to_config_json(F.col("additional_properties")).alias("config_json"))


# ---------------------------------------------------------------- C14 / D2 rejects
@register("catalog_rejects", with_catalogue(f"""
SELECT 'raw_datasets' AS kind, 'size_bytes is null' AS reason, CAST(count(*) AS BIGINT) AS n
FROM px WHERE grp = 'type-raw-data' AND {_FIRST_PARQUET.format(col='size')} IS NULL
UNION ALL
SELECT 'models', 'model_parameters is not a JSON list', CAST(count(*) AS BIGINT)
FROM px WHERE grp = 'type-model' AND NOT {_PARAMS_OK}
"""))
def catalog_rejects(spark, sf_dir):
    bad = catalog.reject_reasons(_pkgs(spark, sf_dir))
    return bad.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- C8 C9 C10
def _json_list_text(col: str) -> str:
    return (f"CASE WHEN {col} = '' THEN '' WHEN NOT json_valid({col}) THEN '' WHEN json_type({col}) = 'ARRAY' "
            f"THEN array_to_string(from_json({col}, '[\"VARCHAR\"]'), '|') ELSE '' END")


_RUNS_SQL = f"""
SELECT x_qid AS run_id, x_qid AS qid, x_model AS model_name, x_docker_tag AS docker_tag, x_status AS status,
  x_run_timestamp AS run_timestamp, x_computation_time AS computation_time,
  coalesce((SELECT string_agg(url, '|' ORDER BY pos) FROM pkg_resources r WHERE r.pkg_id = px.pkg_id
            AND description = 'Input file'), '') AS input_files,
  coalesce((SELECT string_agg(url, '|' ORDER BY pos) FROM pkg_resources r WHERE r.pkg_id = px.pkg_id
            AND description = 'Output file'), '') AS output_files,
  {_json_list_text('x_input_dataset_qids')} AS input_dataset_qids,
  {_json_list_text('x_data_transformation_sql')} AS data_transformation_sql,
  CASE WHEN x_qid <> '' THEN '{DOIP}/doip/retrieve/' || x_qid ELSE '' END AS doip_url
FROM px WHERE grp = 'type-model-run'"""


@register("catalog_model_runs", with_catalogue(_RUNS_SQL))
def catalog_model_runs(spark, sf_dir):
    r = catalog.model_runs(_pkgs(spark, sf_dir))
    return r.select(
        "run_id", "qid", "model_name", "docker_tag", "status", "run_timestamp", "computation_time",
        *[F.array_join(c, "|").alias(c) for c in ("input_files", "output_files", "input_dataset_qids",
                                                   "data_transformation_sql")],
        "doip_url")


# ---------------------------------------------------------------- C13
def _lookup_ids(spark, sf_dir):
    from fathom.session import read_table
    return read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("q"), (F.col("c_custkey") * 3).cast("string")).alias("run_id"))


@register("catalog_run_lookup", with_catalogue("""
, ids AS (SELECT 'q' || CAST(c_custkey * 3 AS STRING) AS run_id FROM customer),
runs AS (SELECT upper(x_qid) AS k, arg_min(x_qid, pkg_id) AS qid, arg_min(x_model, pkg_id) AS model_name
         FROM px WHERE grp = 'type-model-run' GROUP BY upper(x_qid))
SELECT ids.run_id, runs.qid IS NOT NULL AS found, runs.qid AS qid, runs.model_name AS model_name
FROM ids LEFT JOIN runs ON runs.k = upper(ids.run_id)
"""))
def catalog_run_lookup(spark, sf_dir):
    # only the shown columns are aggregated
    runs = catalog.model_runs(_pkgs(spark, sf_dir, resources=False)).select("ord", "qid", "model_name")
    out = catalog.lookup_runs(runs, _lookup_ids(spark, sf_dir))
    return out.select("run_id", "found", F.col("run.qid").alias("qid"), F.col("run.model_name").alias("model_name"))
