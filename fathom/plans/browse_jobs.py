"""Browse, date and run-enrichment jobs over the catalogue tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.dates import fmt_dataset_date, fmt_model_date, fmt_run_date
from fathom.operators import browse, catalog, runs, search_index
from fathom.plans.catalogue_jobs import _PARAMS_OK, AS_OF, DOIP, _pkgs, _valid_models
from fathom.plans.oracle_bindings import with_catalogue
from fathom.plans.registry import register
from fathom.session import read_table, scratch_folder
from fathom.sources import sorted_table

MODEL_NEEDLE = "ROD"
RUN_NEEDLE = "-1"


# ---------------------------------------------------------------- B2 B9 B11 (page 2)
@register("browse_models_page", with_catalogue(f"""
SELECT x_model_qid AS qid, coalesce(title, '') AS name, x_docker_tag AS docker_tag
FROM px WHERE grp = 'type-model' AND {_PARAMS_OK}
  AND (contains(lower(coalesce(title, '')), lower('{MODEL_NEEDLE}')) OR contains(lower(coalesce(notes, '')), lower('{MODEL_NEEDLE}'))
       OR contains(lower(x_model_qid), lower('{MODEL_NEEDLE}')))
ORDER BY lower(coalesce(title, '')), pkg_id LIMIT 10 OFFSET 10
"""))
def browse_models_page(spark, sf_dir):
    m = _valid_models(spark, sf_dir)
    hits = browse.search(m, MODEL_NEEDLE, ["name", "description", "qid"])
    return browse.page(hits, browse.name_a_to_z("name"), size=10, number=2).select("qid", "name", "docker_tag")


# ---------------------------------------------------------------- B3 B8 B11
@register("browse_runs_page", with_catalogue(f"""
SELECT x_qid AS qid, x_model AS model_name, x_run_timestamp AS run_timestamp
FROM px WHERE grp = 'type-model-run'
  AND (contains(lower(x_model), lower('{RUN_NEEDLE}')) OR contains(lower(x_qid), lower('{RUN_NEEDLE}')))
ORDER BY x_run_timestamp DESC, pkg_id LIMIT 10
"""))
def browse_runs_page(spark, sf_dir):
    r = catalog.model_runs(_pkgs(spark, sf_dir, resources=False))
    hits = browse.search(r, RUN_NEEDLE, ["model_name", "qid"])
    return browse.page(hits, browse.newest_first("run_timestamp"), size=10).select("qid", "model_name", "run_timestamp")


# ---------------------------------------------------------------- B11 keyset pages, both orders
# the run timestamps have a date only, so many rows tie with the last one shown
@register("browse_page_after", with_catalogue("""
, r AS (SELECT x_qid AS qid, substring(x_run_timestamp, 1, 7) AS key, pkg_id FROM px WHERE grp = 'type-model-run')
SELECT * FROM (SELECT 'newest' AS listing, qid, key, pkg_id AS feed_pos FROM r ORDER BY key DESC, pkg_id LIMIT 10 OFFSET 10)
UNION ALL SELECT * FROM (SELECT 'a_to_z' AS listing, qid, key, pkg_id FROM r ORDER BY key, pkg_id LIMIT 10 OFFSET 10)
"""))
def browse_page_after(spark, sf_dir):
    r = catalog.model_runs(_pkgs(spark, sf_dir, resources=False)).select("qid", F.substring("run_timestamp", 1, 7).alias("key"), F.col("ord.pos").alias("ord"))
    pages = []
    for listing, descending in (("newest", True), ("a_to_z", False)):
        order = [F.col("key").desc() if descending else F.col("key").asc(), F.col("ord").asc()]
        shown = browse.page(r, order, size=10).collect()    # the page on the user's screen
        nxt = browse.page_after(r, F.col("key"), shown[-1]["key"], shown[-1]["ord"], descending) if shown else r.limit(0)
        pages.append(nxt.select(F.lit(listing).alias("listing"), "qid", "key", F.col("ord").alias("feed_pos")))
    return pages[0].unionByName(pages[1])


# ---------------------------------------------------------------- B11 deep pages from a sorted copy
DEEP_PAGES = (2, 30, 250)


@register("browse_deep_pages", with_catalogue("\nUNION ALL ".join(f"""
SELECT * FROM (SELECT {n} AS page, x_qid AS qid, x_run_timestamp AS run_timestamp, pkg_id AS feed_pos FROM px WHERE grp = 'type-model-run'
  ORDER BY x_run_timestamp DESC, pkg_id LIMIT 10 OFFSET {10 * (n - 1)})""" for n in DEEP_PAGES)))
def browse_deep_pages(spark, sf_dir):
    r = catalog.model_runs(_pkgs(spark, sf_dir, resources=False)).select("qid", "run_timestamp", F.col("ord.pos").alias("feed_pos"))
    root = scratch_folder(spark, "runs-by-time")
    sorted_table.write_sorted(r, root, ["run_timestamp desc", "feed_pos"])
    pages = [sorted_table.page_at(spark, root, n, 10).select(F.lit(n).alias("page"), "qid", "run_timestamp", "feed_pos") for n in DEEP_PAGES]
    return reduce(DataFrame.unionByName, pages)


# ---------------------------------------------------------------- B1-B5 from a trigram index
# rare, frequent, absent, short, and one that a scan serves better
INDEX_NEEDLES = ("hot pink", "Plate", "zzqx", "ro", "e")


@register("browse_search_index", with_catalogue(f"""
, needles(needle) AS (VALUES {", ".join(f"('{n}')" for n in INDEX_NEEDLES)})
SELECT needle, x_qid AS qid, coalesce(title, '') AS name, pkg_id AS feed_pos FROM px JOIN needles
  ON contains(lower(coalesce(title, '')), lower(needle)) OR contains(lower(coalesce(notes, '')), lower(needle)) OR contains(lower(x_qid), lower(needle))
WHERE grp = 'type-raw-data'
"""))
def browse_search_index(spark, sf_dir):
    cols = ["name", "description", "qid"]
    ds = catalog.processed_datasets(_pkgs(spark, sf_dir, resources=False)).select(*cols, "last_modified", F.col("ord.pos").alias("feed_pos"))
    root = scratch_folder(spark, "dataset-search")
    search_index.build(ds, root, ["last_modified desc", "feed_pos"], cols)
    found = [search_index.search(spark, root, n, cols).select(F.lit(n).alias("needle"), "qid", "name", "feed_pos") for n in INDEX_NEEDLES]
    return reduce(DataFrame.unionByName, found)


# ---------------------------------------------------------------- B6 B7 B10
_BADGE = "coalesce(nullif(x_additional_type, ''), 'Dataset')"


@register("browse_type_facets", with_catalogue(f"""
SELECT {_BADGE} AS badge, CAST(count(*) AS BIGINT) AS n,
  'Showing ' || CAST(count(*) AS STRING) || ' dataset' || CASE WHEN count(*) <> 1 THEN 's' ELSE '' END AS label
FROM px WHERE grp = 'type-raw-data' GROUP BY 1
UNION ALL
SELECT 'All Types', CAST(count(*) AS BIGINT),
  'Showing ' || CAST(count(*) AS STRING) || ' dataset' || CASE WHEN count(*) <> 1 THEN 's' ELSE '' END
FROM px WHERE grp = 'type-raw-data'
"""))
def browse_type_facets(spark, sf_dir):
    ds = catalog.processed_datasets(_pkgs(spark, sf_dir, resources=False))
    return browse.facets_with_total(ds).select("badge", "n", browse.count_label(F.col("n"), "dataset").alias("label"))


@register("browse_type_filter", with_catalogue(f"""
SELECT x_qid AS qid, coalesce(title, '') AS name, {_BADGE} AS badge
FROM px WHERE grp = 'type-raw-data' AND {_BADGE} = 'incidence'
"""))
def browse_type_filter(spark, sf_dir):
    ds = catalog.processed_datasets(_pkgs(spark, sf_dir, resources=False))
    return browse.type_filter(ds, "incidence").select("qid", "name", browse.badge(F.col("additional_type")).alias("badge"))


# ---------------------------------------------------------------- B12
@register("browse_selection", with_catalogue("""
SELECT x_qid AS qid, coalesce(title, '') AS name, pkg_id AS feed_pos
FROM px WHERE grp = 'type-raw-data'
  AND x_qid IN (SELECT 'Q' || CAST(c_custkey * 7 AS STRING) FROM customer UNION ALL SELECT 'Q' || CAST(c_custkey * 7 AS STRING) FROM customer)
"""))
def browse_selection(spark, sf_dir):
    ds = catalog.processed_datasets(_pkgs(spark, sf_dir, resources=False))
    cust = read_table(spark, sf_dir, "customer")
    sel = cust.select(F.concat(F.lit("Q"), (F.col("c_custkey") * 7).cast("string")).alias("qid"))
    sel = sel.unionByName(sel)  # a repeated pick must not repeat the row
    return browse.select_rows(ds, sel).select("qid", "name", F.col("ord.pos").alias("feed_pos"))


# ---------------------------------------------------------------- B13
@register("browse_model_pick", with_catalogue(f"""
SELECT coalesce(title, '') AS name, arg_min(x_model_qid, pkg_id) AS qid, arg_min(x_docker_tag, pkg_id) AS docker_tag,
  arg_min(x_docker_image, pkg_id) AS docker_image
FROM px WHERE grp = 'type-model' AND {_PARAMS_OK} GROUP BY 1
"""))
def browse_model_pick(spark, sf_dir):
    m = _valid_models(spark, sf_dir).select("ord", "name", "qid", "docker_tag", "docker_image")
    return browse.first_by(m, "name").select("name", "qid", "docker_tag", "docker_image")


# ---------------------------------------------------------------- B14 B15
@register("browse_links", with_catalogue(f"""
, comp AS (SELECT pkg_id, ROW_NUMBER() OVER (PARTITION BY pkg_id ORDER BY pos) - 1 AS component_pos, name, url
           FROM pkg_resources WHERE upper(format) = 'PARQUET')
SELECT px.pkg_id AS feed_pos, x_qid AS qid, '{browse.DEFAULT_HUB_BASE}' || lower(x_qid) AS hub_url,
  CASE WHEN x_qid <> '' THEN '{DOIP}/doip/versions/' || x_qid || '?include_sizes=true' ELSE '' END AS versions_url,
  substring(coalesce(notes, ''), 1, 100) AS short_description,
  CAST(comp.component_pos AS INTEGER) AS component_pos, comp.name AS component_name, comp.url AS download_url
FROM px LEFT JOIN comp ON comp.pkg_id = px.pkg_id WHERE grp = 'type-raw-data'
"""))
def browse_links(spark, sf_dir):
    ds = catalog.processed_datasets(_pkgs(spark, sf_dir))
    return browse.links(ds, DOIP).withColumn("feed_pos", F.col("ord.pos")).drop("ord")


# ---------------------------------------------------------------- T1 T4
def _oracle_rel(ts: str) -> str:
    d = f"CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({ts})) / 86400000000) AS BIGINT)"
    return (f"CASE WHEN {ts} IS NULL THEN '' WHEN {d} = 0 THEN 'Today' WHEN {d} = 1 THEN '1 day ago' "
            f"ELSE CAST({d} AS STRING) || ' days ago' END")


def _oracle_disp(raw: str, ts: str, fmt: str) -> str:
    return f"CASE WHEN {raw} = '' THEN '—' WHEN {ts} IS NOT NULL THEN strftime({ts}, '{fmt}') ELSE {raw} END"


_T1 = "try_strptime(substring(trim({0}), 1, 10), '%Y-%m-%d')"


@register("dates_datasets", with_catalogue(f"""
, d AS (SELECT pkg_id, x_modified AS m, metadata_created AS c, {_T1.format('x_modified')} AS mt,
               {_T1.format('metadata_created')} AS ct FROM px WHERE grp = 'type-raw-data')
SELECT pkg_id AS feed_pos, {_oracle_disp('m', 'mt', '%b %-d, %Y')} AS modified_display, {_oracle_rel('mt')} AS modified_rel,
  {_oracle_disp('c', 'ct', '%b %-d, %Y')} AS created_display, {_oracle_rel('ct')} AS created_rel
FROM d
"""))
def dates_datasets(spark, sf_dir):
    ds = catalog.processed_datasets(_pkgs(spark, sf_dir))
    md, mr = fmt_dataset_date(F.col("last_modified"), AS_OF)
    cd, cr = fmt_dataset_date(F.col("metadata_created"), AS_OF)
    return ds.select(F.col("ord.pos").alias("feed_pos"), md.alias("modified_display"), mr.alias("modified_rel"),
                     cd.alias("created_display"), cr.alias("created_rel"))


# ---------------------------------------------------------------- T2
_T2 = ("try_strptime(regexp_replace(regexp_replace(trim({0}), 'Z+$', ''), '(\\.\\d{{6}})\\d+', '\\1'), "
       "['%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d'])")


@register("dates_models", with_catalogue(f"""
, d AS (SELECT pkg_id, x_docker_image_created AS c, {_T2.format('x_docker_image_created')} AS ct
        FROM px WHERE grp = 'type-model' AND {_PARAMS_OK})
SELECT pkg_id AS feed_pos, {_oracle_disp('c', 'ct', '%b %-d, %Y')} AS created_display, {_oracle_rel('ct')} AS created_rel
FROM d
"""))
def dates_models(spark, sf_dir):
    m = _valid_models(spark, sf_dir)
    cd, cr = fmt_model_date(F.col("docker_image_created"), AS_OF)
    return m.select(F.col("ord.pos").alias("feed_pos"), cd.alias("created_display"), cr.alias("created_rel"))


# ---------------------------------------------------------------- T3
_T3 = ("coalesce(try_strptime(substring(trim({0}), 1, 19), ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d']), "
       "try_strptime(substring(trim({0}), 1, 10), '%Y-%m-%d'))")


@register("dates_runs", with_catalogue(f"""
, d AS (SELECT pkg_id, x_run_timestamp AS r, {_T3.format('x_run_timestamp')} AS rt FROM px WHERE grp = 'type-model-run')
SELECT pkg_id AS feed_pos, {_oracle_disp('r', 'rt', '%b %-d, %Y  %H:%M')} AS run_display, {_oracle_rel('rt')} AS run_rel
FROM d
"""))
def dates_runs(spark, sf_dir):
    r = catalog.model_runs(_pkgs(spark, sf_dir))
    rd, rr = fmt_run_date(F.col("run_timestamp"), AS_OF)
    return r.select(F.col("ord.pos").alias("feed_pos"), rd.alias("run_display"), rr.alias("run_rel"))


# ---------------------------------------------------------------- R1-R4
@register("runs_enriched", with_catalogue(f"""
, names AS (SELECT x_qid AS qid, arg_max(coalesce(title, ''), pkg_id) AS name FROM px WHERE grp = 'type-raw-data' GROUP BY x_qid),
r AS (SELECT pkg_id, x_qid AS qid, x_status AS status,
        EXISTS (SELECT 1 FROM pkg_resources z WHERE z.pkg_id = px.pkg_id AND description = 'Output file') AS has_out,
        (SELECT url FROM pkg_resources z WHERE z.pkg_id = px.pkg_id AND description = 'Output file' AND contains(url, 'run.log')
         ORDER BY pos LIMIT 1) AS log_file,
        CASE WHEN x_input_dataset_qids = '' THEN [] WHEN NOT json_valid(x_input_dataset_qids) THEN []
             WHEN json_type(x_input_dataset_qids) = 'ARRAY' THEN from_json(x_input_dataset_qids, '["VARCHAR"]') ELSE [] END AS qids
      FROM px WHERE grp = 'type-model-run'),
ex AS (SELECT pkg_id, unnest(qids) AS q, generate_subscripts(qids, 1) AS i FROM r),
rn AS (SELECT ex.pkg_id, string_agg(CASE WHEN coalesce(names.name, '') <> '' THEN names.name ELSE ex.q END, '|' ORDER BY i) AS input_names
       FROM ex LEFT JOIN names ON names.qid = ex.q GROUP BY ex.pkg_id),
s AS (SELECT r.*, CASE WHEN status <> '' THEN status WHEN has_out THEN 'completed' ELSE '' END AS st FROM r)
SELECT s.pkg_id AS feed_pos, qid, st AS status,
  CASE WHEN lower(st) IN ('completed', 'success') THEN 'bg-green-100 text-green-700'
       WHEN lower(st) IN ('failed', 'error') THEN 'bg-red-100 text-red-700'
       WHEN lower(st) IN ('running', 'in_progress') THEN 'bg-blue-100 text-blue-700'
       ELSE 'bg-gray-100 text-gray-600' END AS status_cls,
  coalesce(rn.input_names, '') AS input_names,
  coalesce(log_file, CASE WHEN qid <> '' THEN '{DOIP}/doip/retrieve/' || qid || '/output/run.log' ELSE '' END) AS log_url
FROM s LEFT JOIN rn ON rn.pkg_id = s.pkg_id
"""))
def runs_enriched(spark, sf_dir):
    names = catalog.processed_datasets(_pkgs(spark, sf_dir, resources=False))
    enriched = runs.enrich_runs(catalog.model_runs(_pkgs(spark, sf_dir)), names, DOIP)
    return enriched.select(F.col("ord.pos").alias("feed_pos"), "qid", "status", "status_cls",
                           F.array_join("input_names", "|").alias("input_names"), "log_url")


# ---------------------------------------------------------------- B5
ANY_NEEDLE = "Q12"


@register("browse_any_column", with_catalogue(f"""
SELECT x_qid AS qid, coalesce(title, '') AS name, x_modified AS last_modified
FROM px WHERE grp = 'type-raw-data'
  AND (contains(lower(x_qid), lower('{ANY_NEEDLE}')) OR contains(lower(coalesce(title, '')), lower('{ANY_NEEDLE}'))
       OR contains(lower(x_modified), lower('{ANY_NEEDLE}')))
"""))
def browse_any_column(spark, sf_dir):
    ds = catalog.processed_datasets(_pkgs(spark, sf_dir, resources=False)).select("qid", "name", "last_modified")
    return browse.any_column_filter(ds, ANY_NEEDLE)
