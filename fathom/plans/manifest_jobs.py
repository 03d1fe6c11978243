"""Run-manifest jobs (M1-M10) over the request bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions.rows import rows_where
from fathom.operators import manifest
from fathom.plans.registry import register
from fathom.sources import bindings
from fathom.sources.bindings import REQUEST_INPUT_SQL, REQUEST_SQL, RESOURCE_ORDER

_ORDER = ", ".join(RESOURCE_ORDER)
_HAS_SQL = "regexp_matches(coalesce({0}, ''), '(^|\\n)[ \\t]*([^-\\s]|-([^-]|$))')"
_CFG = "regexp_replace(coalesce(config, ''), '^\\s+|\\s+$', '', 'g')"

_BASE = f"""
WITH r AS (SELECT o_orderkey, {', '.join(f'{sql} AS {n}' for n, sql in REQUEST_SQL.items())} FROM orders),
i AS (SELECT l_orderkey AS o_orderkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS pos,
        {', '.join(f'{sql} AS {n}' for n, sql in REQUEST_INPUT_SQL.items())} FROM lineitem),
n AS (SELECT o_orderkey, pos, data_path,
        trim(coalesce(target_name, 'input' || CASE WHEN pos = 0 THEN '' ELSE CAST(pos + 1 AS VARCHAR) END
          || CASE WHEN contains(split_part(data_path, '/', -1), '.') THEN '.' || split_part(split_part(data_path, '/', -1), '.', -1)
             ELSE '' END)) AS target,
        CASE WHEN {_HAS_SQL.format('sql')} THEN sql ELSE '' END AS eff_sql FROM i),
agg AS (SELECT o_orderkey, count(*) AS n_datasets, count(*) FILTER (WHERE eff_sql <> '') AS n_transforms,
          count(DISTINCT target) AS n_names, string_agg(data_path || '=>' || target, '|' ORDER BY pos) AS input_files,
          string_agg(eff_sql, ' ;; ' ORDER BY pos) AS sql_list FROM n GROUP BY o_orderkey),
c AS (SELECT r.*, {_CFG} AS cfg, coalesce(agg.n_datasets, 0) AS n_datasets, coalesce(agg.n_transforms, 0) AS n_transforms,
        coalesce(agg.n_names, 0) AS n_names, coalesce(agg.input_files, '') AS input_files, coalesce(agg.sql_list, '') AS sql_list
      FROM r LEFT JOIN agg USING (o_orderkey)),
v AS (SELECT c.*, json_valid(cfg) AND cfg <> '' AS cfg_ok FROM c),
chk AS (SELECT v.*, list_filter([
          CASE WHEN n_datasets = 0 THEN 'Select at least one input dataset' END,
          CASE WHEN model_image IS NULL THEN 'Select a model' END,
          CASE WHEN NOT cfg_ok THEN 'Invalid JSON' END,
          CASE WHEN n_names <> n_datasets THEN 'All target filenames must be unique' END], lambda x: x IS NOT NULL) AS reasons
        FROM v)
"""

_SUMMARY = ("CASE WHEN NOT (cfg_ok AND json_type(cfg) = 'OBJECT') THEN 'Not configured yet' "
            "WHEN len(json_keys(cfg)) = 0 THEN 'Configured' "
            "ELSE array_to_string(list_transform(json_keys(cfg)[1:2], lambda k: k || ': ' || json_extract_string(cfg, '$.\"' || k || '\"')), ', ') END")


@register("manifest_payloads", _BASE + f"""
SELECT request_id, CAST(n_datasets AS BIGINT) AS n_datasets, CAST(n_transforms AS BIGINT) AS n_transforms,
  model_image, coalesce(model_tag, 'latest') AS model_tag, {_SUMMARY} AS config_summary, input_files, sql_list
FROM chk WHERE len(reasons) = 0
""")
def manifest_payloads(spark, sf_dir):
    chk = manifest.validate(bindings.requests(spark, sf_dir))
    ok = rows_where(chk, F.size("reasons") == 0)
    files = F.array_join(F.transform(F.arrays_zip(F.col("inputs"), F.col("target_names")),
                                     lambda z: F.concat(z["inputs"]["data_path"], F.lit("=>"), z["target_names"])), "|")
    return ok.select("request_id", "n_datasets", "n_transforms", "model_image",
                     F.col("effective_tag").alias("model_tag"), "config_summary",
                     files.alias("input_files"), F.array_join("effective_sql", " ;; ").alias("sql_list"))


@register("manifest_rejects", _BASE + """
SELECT request_id, array_to_string(reasons, '; ') AS reasons FROM chk WHERE len(reasons) > 0
""")
def manifest_rejects(spark, sf_dir):
    chk = manifest.validate(bindings.requests(spark, sf_dir))
    bad = rows_where(chk.select("request_id", "reasons"), F.size("reasons") > 0)
    return bad.select("request_id", F.array_join("reasons", "; ").alias("reasons"))
