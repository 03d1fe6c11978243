"""Object-listing and sidecar jobs (L1-L11) over the documents-derived store."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import listing
from fathom.plans.registry import register
from fathom.session import read_table
from fathom.sources import bindings
from fathom.sources.bindings import COMPONENT_ARMS, OBJECT_COLUMNS, SIDECAR_COLUMNS

DOIP = listing.DEFAULT_DOIP_BASE
STORE = listing.DEFAULT_STORE


def _with_store(body: str) -> str:
    obj = ", ".join(f"{sql} AS {n}" for n, sql in OBJECT_COLUMNS.items())
    sc = ", ".join(f"{sql} AS {n}" for n, sql in SIDECAR_COLUMNS.items())
    comps = "\nUNION ALL ".join(
        f"SELECT doc_id, {pos} AS pos, {at} AS at_id, {cid} AS cid FROM documents WHERE doc_id % 3 = 0"
        for pos, at, cid in COMPONENT_ARMS)
    body = body.lstrip("\n")
    if body.startswith(","):
        body = ",\n" + body[1:].lstrip()
    return (f"WITH objects AS (SELECT doc_id, {obj} FROM documents),\n"
            f"sidecars AS (SELECT d.doc_id, {sc}, o.path, o.mtime, o.size_bytes FROM documents d "
            f"JOIN objects o USING (doc_id) WHERE d.doc_id % 3 = 0),\n"
            f"comps AS ({comps})\n{body}")


_QID_FROM_PATH = ("CASE WHEN ends_with(split_part(path, '/', -1), '.fdo.json') "
                  "THEN substring(split_part(path, '/', -1), 1, length(split_part(path, '/', -1)) - 9) "
                  "ELSE split_part(path, '/', -1) END")


@register("listing_raw_objects", _with_store("""
SELECT path, CAST(mtime AS VARCHAR) AS last_modified, size_bytes FROM objects WHERE NOT ends_with(path, '.fdo.json')
"""))
def listing_raw_objects(spark, sf_dir):
    return listing.raw_objects(bindings.objects(spark, sf_dir))


@register("listing_processed_datasets", _with_store(f"""
, ok AS (SELECT c.doc_id, c.pos, c.cid, s.id AS qid,
           '{DOIP}/doip/retrieve/' || s.id || '/' || c.cid AS url,
           '{STORE}/' || regexp_replace(s.path, '/[^/]*$', '') || '/' || c.at_id AS lakefs_path
         FROM comps c JOIN sidecars s USING (doc_id) WHERE c.cid <> '' AND c.at_id <> '')
SELECT s.id AS qid, s.name, s.description, s.url AS source_url, '{STORE}/' || s.path AS lakefs_path,
  coalesce((SELECT lakefs_path FROM ok WHERE ok.doc_id = s.doc_id ORDER BY pos LIMIT 1), '') AS data_path,
  CAST(s.mtime AS VARCHAR) AS last_modified,
  CASE WHEN s.id <> '' THEN '{DOIP}/doip/retrieve/' || s.id ELSE '' END AS doip_url,
  coalesce((SELECT string_agg(cid || '=' || url || '=' || lakefs_path, '|' ORDER BY pos) FROM ok WHERE ok.doc_id = s.doc_id), '')
    AS components
FROM sidecars s
"""))
def listing_processed_datasets(spark, sf_dir):
    ds = listing.datasets_from_sidecars(bindings.sidecars(spark, sf_dir), STORE, DOIP)
    return ds.select(*[c for c in ds.columns if c != "components"],
                     F.array_join(F.transform("components", lambda c: F.concat_ws("=", c["name"], c["url"], c["lakefs_path"])),
                                  "|").alias("components"))


@register("listing_model_runs", _with_store(f"""
SELECT {_QID_FROM_PATH} AS run_id, {_QID_FROM_PATH} AS qid, s.name AS model_name,
  CASE WHEN contains(attributed_to, ':') THEN split_part(attributed_to, ':', -1) ELSE '' END AS docker_tag,
  '' AS status, s.modified AS run_timestamp, '' AS computation_time,
  coalesce((SELECT string_agg(at_id, '|' ORDER BY pos) FROM comps c WHERE c.doc_id = s.doc_id
            AND starts_with(at_id, 'components/input/')), '') AS input_files,
  coalesce((SELECT string_agg(at_id, '|' ORDER BY pos) FROM comps c WHERE c.doc_id = s.doc_id
            AND starts_with(at_id, 'components/output/')), '') AS output_files,
  '{DOIP}/doip/retrieve/' || {_QID_FROM_PATH} AS doip_url
FROM sidecars s
"""))
def listing_model_runs(spark, sf_dir):
    r = listing.runs_from_sidecars(bindings.sidecars(spark, sf_dir), DOIP)
    return r.select(*[F.array_join(c, "|").alias(c) if c in ("input_files", "output_files") else F.col(c)
                      for c in r.columns])


@register("listing_models", _with_store(f"""
SELECT {_QID_FROM_PATH} AS qid, name, description, url AS docker_image, software_version AS docker_tag FROM sidecars
"""))
def listing_models(spark, sf_dir):
    return listing.models_from_sidecars(bindings.sidecars(spark, sf_dir))


_SHARD_SQL = ("CASE WHEN length(ltrim(upper({0}), 'Q')) >= 6 THEN ltrim(upper({0}), 'Q') "
              "ELSE lpad(ltrim(upper({0}), 'Q'), 6, '0') END")


@register("listing_shard_lookup", _with_store(f"""
, ids AS (SELECT 'q' || CAST(c_custkey * 3 AS STRING) AS run_id FROM customer),
p AS (SELECT run_id, substring({_SHARD_SQL.format('run_id')}, 1, 2) || '/' || substring({_SHARD_SQL.format('run_id')}, 3, 2)
        || '/' || substring({_SHARD_SQL.format('run_id')}, 5, 2) || '/' || upper(run_id) || '/' || upper(run_id) || '.fdo.json'
        AS sidecar_path FROM ids)
SELECT p.run_id, s.doc_id IS NOT NULL AS found, coalesce(s.name, '') AS model_name,
  CASE WHEN contains(coalesce(s.attributed_to, ''), ':') THEN split_part(s.attributed_to, ':', -1) ELSE '' END AS docker_tag,
  p.sidecar_path
FROM p LEFT JOIN sidecars s ON s.path = p.sidecar_path
"""))
def listing_shard_lookup(spark, sf_dir):
    ids = read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("q"), (F.col("c_custkey") * 3).cast("string")).alias("run_id"))
    return listing.lookup_sidecar_runs(bindings.sidecars(spark, sf_dir), ids)
