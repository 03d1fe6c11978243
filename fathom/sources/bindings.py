"""Catalogue inputs derived from the test tables.

The catalogue, object store and run metadata of the service live behind
HTTP services. For tests and the bench they are derived, by Spark, from the
TPC-H-like tables, so every job's work grows with the data:

* ``packages``  - one package per ``orders`` row, ``lineitem`` rows as its
  resources, key/value extras computed per row (no shuffle for extras).
* ``objects``   - ``documents`` rows as an object listing (paths sharded by qid).
* ``series_rows`` - ``events`` per ``event_type`` as one numbered file each.
* ``run_meta`` - ``orders`` with ``lineitem`` rows as run components.

Each extra is one SQL expression over an ``orders`` row (plus ``p_name``),
kept here as text so the DuckDB oracle reads the very same definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.session import read_table

_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"

# The extras of each package, (position, key, value SQL, row filter SQL).
# Repeated 'status' (last wins) and malformed JSON ('[oops', '[{"name":"alpha"') are on purpose.
EXTRA_ARMS: list[tuple[int, str, str, str | None]] = [
    (0, "qid", "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Q' || CAST(o_orderkey AS STRING) END", None),
    (1, "modified", f"{_DAY} || 'T08:30:00'", None),
    (2, "status", "CASE o_orderpriority WHEN '1-URGENT' THEN 'FAILED' WHEN '2-HIGH' THEN 'running' ELSE '' END", None),
    (3, "status", "'completed'", "o_orderkey % 7 = 0"),
    (4, "docker_image", "CASE WHEN o_orderkey % 2 = 0 THEN 'ghcr.io/org/m' ELSE 'docker.io/m' END || CAST(o_custkey % 20 AS STRING)", None),
    (5, "docker_tag", "'v' || CAST(o_orderkey % 5 AS STRING)", None),
    (6, "input_dataset_qids", "CASE WHEN o_orderkey % 13 = 0 THEN '[oops' ELSE '[\"Q' || CAST(o_custkey AS STRING) || '\",\"Q' || CAST(o_custkey + 1 AS STRING) || '\"]' END", "o_orderkey % 5 <> 0"),
    (7, "additional_type", "CASE o_orderpriority WHEN '3-MEDIUM' THEN 'incidence' WHEN '5-LOW' THEN 'climate' ELSE '' END", None),
    (8, "model_qid", "CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'M' || CAST(o_custkey % 50 AS STRING) END", None),
    (9, "model", "'model-' || CAST(o_custkey % 20 AS STRING)", None),
    (10, "model_parameters",
     "CASE WHEN o_orderkey % 23 = 0 THEN '[{\"name\":\"alpha\"'"
     " WHEN o_orderkey % 4 = 0 THEN ''"
     " WHEN o_orderkey % 4 = 1 THEN '[{\"name\":\"horizon\",\"value\":' || CAST(o_custkey % 10 AS STRING)"
     " || '},{\"name\":\"mode\",\"value\":\"fast\"},{\"name\":\"horizon\",\"value\":7}]'"
     " WHEN o_orderkey % 4 = 2 THEN '[]'"
     " ELSE '[{\"name\":\"alpha\",\"value\":0.5}]' END", None),
    (11, "run_timestamp",
     f"CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN {_DAY} || 'T' || LPAD(CAST(o_custkey % 24 AS STRING), 2, '0') || ':15:00'"
     f" WHEN 2 THEN {_DAY} || ' 09:45:30' WHEN 3 THEN {_DAY} ELSE {_DAY} || 'T23:59:59.123456Z' END", None),
    (12, "computation_time", "CAST(o_custkey % 600 AS STRING) || 's'", None),
    (13, "docker_image_created",
     f"CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN {_DAY} || 'T10:20:30.123456789Z' WHEN 2 THEN {_DAY} || 'T10:20:30Z'"
     f" WHEN 3 THEN {_DAY} || ' 10:20:30' WHEN 4 THEN {_DAY} ELSE 'unknown' END", None),
    (14, "data_transformation_sql",
     "CASE WHEN o_orderkey % 3 = 0 THEN '[\"SELECT * FROM df WHERE y > 0\"]' ELSE '' END", "o_orderkey % 5 <> 0"),
]

# Package columns as SQL over orders LEFT JOIN part ON p_partkey = o_custkey.
PKG_COLUMNS = {
    "grp": "CASE o_orderstatus WHEN 'F' THEN 'type-raw-data' WHEN 'P' THEN 'type-model' ELSE 'type-model-run' END",
    "title": "p_name || ' ' || CAST(o_custkey AS STRING)",
    "notes": "p_type || ' ' || o_orderpriority",
    "url": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'https://src.example/' || CAST(o_orderkey AS STRING) END",
    "metadata_created": f"{_DAY} || 'T08:30:00'",
}

# Resource columns as SQL over one lineitem row.
RESOURCE_COLUMNS = {
    "name": "'part' || CAST(l_partkey AS STRING) || '.parquet'",
    "url": ("'https://files.example/' || CAST(l_orderkey AS STRING) || CASE WHEN l_partkey % 13 = 0 THEN '/run.log' "
            "ELSE '/part' || CAST(l_partkey AS STRING) || '.parquet' END"),
    "format": "CASE l_returnflag WHEN 'R' THEN 'PARQUET' WHEN 'A' THEN 'parquet' ELSE 'CSV' END",
    "description": "CASE l_linestatus WHEN 'O' THEN 'Output file' ELSE 'Input file' END",
    "size": "CAST(FLOOR(l_extendedprice) AS BIGINT)",
}
# Resource order inside a package (the pair l_orderkey, l_linenumber is not unique).
RESOURCE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def _extras_array() -> F.Column:
    items = []
    for pos, key, value_sql, where_sql in EXTRA_ARMS:
        item = F.struct(F.lit(key).alias("key"), F.expr(value_sql).alias("value"))
        items.append(F.when(F.expr(where_sql), item) if where_sql else item)
    # Conditional arms give null elements; drop them, order stays by position.
    return F.filter(F.array(*items), lambda e: e.isNotNull())


def resources_by_package(lineitem: DataFrame) -> DataFrame:
    """One row per order key with its resources in line order.

    The group is one package's resource list, i.e. one catalogue document.
    """
    sort_fields = [F.col(c).alias(f"k{i}") for i, c in enumerate(RESOURCE_ORDER)]
    res = F.struct(*sort_fields, *[F.expr(sql).alias(n) for n, sql in RESOURCE_COLUMNS.items()])
    return (lineitem
            .groupBy("l_orderkey")
            .agg(F.array_sort(F.collect_list(res)).alias("_r"))
            .select(F.col("l_orderkey").alias("_pkg_id"),
                    F.transform("_r", lambda r: F.struct(*[r[n].alias(n) for n in RESOURCE_COLUMNS]))
                    .alias("resources")))


def packages(spark: SparkSession, sf_dir: str, resources: bool = True) -> DataFrame:
    """The package feed as exploded package rows (see ``sources.feed.packages``).

    Columns: ``ord`` (feed order), ``title, notes, url, metadata_created``,
    ``groups``, ``extras``, ``resources``. A feed read from files holds the
    resources in the row, and a job that ignores them prunes the column;
    ``resources=False`` is the same here (empty lists, ``lineitem`` not read).
    """
    orders = read_table(spark, sf_dir, "orders", spread=True).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    lineitem = read_table(spark, sf_dir, "lineitem", spread=True).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_linestatus")
    base = orders.join(part, F.col("p_partkey") == F.col("o_custkey"), "left")
    pk = base.select(
        F.struct(F.lit("").alias("src"), F.col("o_orderkey").alias("pos")).alias("ord"),
        F.col("o_orderkey").alias("_pkg_id"),
        F.coalesce(F.expr(PKG_COLUMNS["title"]), F.lit("")).alias("title"),
        F.coalesce(F.expr(PKG_COLUMNS["notes"]), F.lit("")).alias("notes"),
        F.expr(PKG_COLUMNS["url"]).alias("url"),
        F.expr(PKG_COLUMNS["metadata_created"]).alias("metadata_created"),
        F.array(F.struct(F.expr(PKG_COLUMNS["grp"]).alias("name"))).alias("groups"),
        _extras_array().alias("extras"),
    )
    if not resources:
        return pk.withColumn("resources", F.array().cast(resources_by_package(lineitem).schema["resources"].dataType)).drop("_pkg_id")
    # both sides grow with the data: a sort-merge join on the package key,
    # never a broadcast of the aggregated resources
    res = resources_by_package(lineitem).hint("merge")
    return (pk.join(res, "_pkg_id", "left")
            .withColumn("resources", F.coalesce("resources", F.array().cast(res.schema["resources"].dataType)))
            .drop("_pkg_id"))


# ---------------------------------------------------------------- object listing / sidecars
_DOC = "CAST(doc_id AS STRING)"
_FILLED = f"CASE WHEN length({_DOC}) >= 6 THEN {_DOC} ELSE lpad({_DOC}, 6, '0') END"
_SHARD = f"substring({_FILLED}, 1, 2) || '/' || substring({_FILLED}, 3, 2) || '/' || substring({_FILLED}, 5, 2)"

# One object per documents row, at <shard>/<QID>/<QID>.<ext>;
# every third object is a sidecar. mtime is epoch seconds.
OBJECT_COLUMNS = {
    "path": f"{_SHARD} || '/Q' || {_DOC} || '/Q' || {_DOC} || CASE WHEN doc_id % 3 = 0 THEN '.fdo.json' ELSE '.parquet' END",
    "mtime": "1704067200 + doc_id * 61",
    "size_bytes": "n_chars",
}
# Sidecar fields per sidecar object (doc_id % 3 = 0).
SIDECAR_COLUMNS = {
    "id": f"CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'Q' || {_DOC} END",
    "name": f"'doc ' || {_DOC} || ' ' || lang",
    "description": "source",
    "url": "'ghcr.io/org/' || lang",
    "software_version": "'v' || CAST(doc_id % 4 AS STRING)",
    "modified": "'2024-01-' || lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') || 'T12:00:00'",
    "attributed_to": "CASE doc_id % 9 WHEN 0 THEN 'img' WHEN 3 THEN 'img:v1' ELSE 'img:v1:2' END",
}
# Sidecar components, (position, @id SQL, componentId SQL).
COMPONENT_ARMS = [
    (0, f"'components/input/in_' || {_DOC} || '.parquet'", f"'in_' || {_DOC} || '.parquet'"),
    (1, f"'components/output/predictions_' || {_DOC} || '.csv'",
     f"CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'predictions_' || {_DOC} || '.csv' END"),
    (2, "CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'misc/readme.txt' END", "'readme.txt'"),
]


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object listing (path, mtime, size_bytes) derived from ``documents``."""
    docs = read_table(spark, sf_dir, "documents", spread=True).select("doc_id", "n_chars")
    return docs.select(*[F.expr(sql).alias(n) for n, sql in OBJECT_COLUMNS.items()]) \
        .withColumn("mtime", F.col("mtime").cast("long"))


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecar rows as ``sources.listing.read_sidecars`` returns them (schema
    ``schemas.SIDECAR`` plus path, mtime, size_bytes), derived from ``documents``."""
    from fathom.schemas import SIDECAR
    docs = read_table(spark, sf_dir, "documents", spread=True).select("doc_id", "n_chars", "lang", "source").where("doc_id % 3 = 0")
    e = {n: F.expr(sql) for n, sql in SIDECAR_COLUMNS.items()}
    comps = F.array(*[F.struct(F.expr(at).alias("@id"), F.expr(cid).alias("componentId"))
                      for _, at, cid in COMPONENT_ARMS])
    out = docs.select(
        e["id"].alias("@id"),
        F.struct(e["name"].alias("name"), e["description"].alias("description"), e["url"].alias("url"),
                 e["software_version"].alias("softwareVersion")).alias("profile"),
        F.struct(e["modified"].alias("modified"), comps.alias("fdo:hasComponent")).alias("kernel"),
        F.struct(e["attributed_to"].alias("prov:wasAttributedTo"),
                 F.lit(None).cast(SIDECAR["provenance"].dataType["prov:used"].dataType).alias("prov:used"))
        .alias("provenance"),
        *[F.expr(sql).alias(n) for n, sql in OBJECT_COLUMNS.items()],
    )
    return out.withColumn("mtime", F.col("mtime").cast("long"))


# ---------------------------------------------------------------- run files (series)
# Each event_type is one loaded run file, rows numbered by (ts, event_id).
# Files with an x_auto_converted column (provenance inputs) and the y text with gaps.
SERIES_FILES_WITH_X = ("click", "view")
SERIES_LABEL_SQL = "CAST(CAST(ts AS DATE) AS STRING)"
SERIES_Y_SQL = ("CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN 'nan' "
                "ELSE CAST(CAST(FLOOR(value) AS BIGINT) AS STRING) END")
SERIES_X_SQL = "row_pos / 3"  # repeated and fractional positions on purpose


def series_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table of run files: file_id, row_pos (dense 1..n per file), label,
    y_text and x_auto_converted (null for files without that column)."""
    from fathom.operators.position import dense_position
    ev = read_table(spark, sf_dir, "events", spread=True).select("event_id", "ts", "event_type", "value")
    numbered = dense_position(ev, ["event_type"], ["ts", "event_id"], out_col="row_pos")
    return numbered.select(
        F.col("event_type").alias("file_id"), "row_pos",
        F.expr(SERIES_LABEL_SQL).alias("label"),
        F.expr(SERIES_Y_SQL).alias("y_text"),
        F.when(F.col("event_type").isin(*SERIES_FILES_WITH_X), F.expr(SERIES_X_SQL)).alias("x_auto_converted"),
    )


# ---------------------------------------------------------------- run metadata documents
# One run per orders row with status 'O'; its lineitem rows (in
# RESOURCE_ORDER) give components and prov:used entries.
RUN_STATUS = "O"
RUN_COMPONENT_SQL = {
    "cid": ("CASE WHEN l_linenumber = 1 THEN 'predictions_' || CAST(l_partkey AS STRING) "
            "|| CASE WHEN l_returnflag = 'N' THEN '.csv' ELSE '.parquet' END "
            "WHEN l_linenumber = 2 AND l_returnflag = 'N' THEN 'input_annotated.parquet' "
            "ELSE 'part' || CAST(l_partkey AS STRING) || CASE l_returnflag WHEN 'R' THEN '.parquet' "
            "WHEN 'A' THEN '.TSV' ELSE '.json' END END"),
    # null = key absent (the default output/<cid> applies)
    "at_id": ("CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linestatus = 'O' THEN 'components/output/' "
              "ELSE 'components/input/' END"),
    "prov_url": ("'https://files.example/src/' || CASE l_suppkey % 4 WHEN 0 THEN 'part' || CAST(l_partkey AS STRING) "
                 "|| '.parquet' WHEN 1 THEN 'shared.parquet?x=1' WHEN 2 THEN 'notes.csv' "
                 "ELSE 'src' || CAST(l_partkey AS STRING) || '.PARQUET/' END"),
    "prov_is_object": "l_linenumber % 2 = 0",
    "prov_query": "CASE WHEN l_quantity > 25 THEN 'SELECT * FROM df WHERE y > 0' ELSE '' END",
}


def run_meta_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_key, qid, meta_json): run metadata documents written by Spark as
    JSON text. A run with one component stores it as an object, not a list;
    prov:used mixes plain strings and objects."""
    orders = read_table(spark, sf_dir, "orders", spread=True).where(F.col("o_orderstatus") == RUN_STATUS).select("o_orderkey")
    li = read_table(spark, sf_dir, "lineitem", spread=True).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_linestatus")
    cid = F.expr(RUN_COMPONENT_SQL["cid"])
    at = F.expr(RUN_COMPONENT_SQL["at_id"])
    comp = F.struct(F.when(at.isNotNull(), F.concat(at, cid)).alias("@id"), cid.alias("componentId"))
    prov = F.struct(F.expr(RUN_COMPONENT_SQL["prov_url"]).alias("url"),
                    F.expr(RUN_COMPONENT_SQL["prov_is_object"]).alias("obj"),
                    F.expr(RUN_COMPONENT_SQL["prov_query"]).alias("query"))
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(RESOURCE_ORDER)]
    per_run = (li.groupBy("l_orderkey")
               .agg(F.array_sort(F.collect_list(F.struct(*keys, comp.alias("comp"), prov.alias("prov")))).alias("_l")))
    runs = orders.join(per_run.hint("merge"), orders["o_orderkey"] == per_run["l_orderkey"], "left")
    comps = F.coalesce(F.transform("_l", lambda e: e["comp"]), F.array())
    has = F.when(F.size(comps) == 1, F.to_variant_object(F.get(comps, 0))).otherwise(F.to_variant_object(comps))
    used = F.coalesce(F.transform("_l", lambda e: F.when(
        e["prov"]["obj"],
        F.to_variant_object(F.struct(e["prov"]["url"].alias("@id"), e["prov"]["query"].alias("schema:query"))))
        .otherwise(e["prov"]["url"].cast("variant"))), F.array().cast("array<variant>"))
    qid = F.concat(F.lit("Q"), F.col("o_orderkey").cast("string"))
    doc = F.to_json(F.struct(qid.alias("@id"),
                             F.struct(has.alias("fdo:hasComponent")).alias("kernel"),
                             F.struct(used.alias("prov:used")).alias("provenance")))
    return runs.select(F.col("o_orderkey").alias("run_key"), qid.alias("qid"), doc.alias("meta_json"))


# ---------------------------------------------------------------- run requests
# One request per orders row; its lineitem rows (in RESOURCE_ORDER)
# are the selected datasets. Bad config, no model, no dataset and repeated
# target names occur on purpose.
REQUEST_SQL = {
    "request_id": "'R' || CAST(o_orderkey AS STRING)",
    "model_image": ("CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'ghcr.io/org/m' "
                    "ELSE 'docker.io/m' END || CAST(o_custkey % 20 AS STRING) END"),
    "model_tag": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'v' || CAST(o_orderkey % 5 AS STRING) END",
    "config": ("CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN '{bad' WHEN 2 THEN '{}' "
               "WHEN 3 THEN '  {\"only\": \"yes\"}  ' ELSE '{\"horizon\": 7, \"mode\": \"fast\", \"alpha\": 0.5}' END"),
}
REQUEST_INPUT_SQL = {
    "data_path": ("'https://files.example/' || CAST(l_orderkey AS STRING) || '/part' || CAST(l_partkey AS STRING) "
                  "|| CASE WHEN l_returnflag = 'N' THEN '' ELSE '.parquet' END"),
    "target_name": "CASE WHEN l_linenumber = 3 THEN ' input.parquet ' ELSE NULL END",
    "sql": ("CASE l_returnflag WHEN 'R' THEN '-- comment only' "
            "WHEN 'A' THEN '  -- note' || chr(10) || 'SELECT * FROM df WHERE y > 0' ELSE '' END"),
}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run requests: (request_id, model_image, model_tag, config, inputs[])."""
    orders = read_table(spark, sf_dir, "orders", spread=True).select("o_orderkey", "o_custkey")
    li = read_table(spark, sf_dir, "lineitem")
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(RESOURCE_ORDER)]
    item = F.struct(*[F.expr(sql).alias(n) for n, sql in REQUEST_INPUT_SQL.items()])
    # Dealt by key before the lists are made: the items are then built by the
    # scan's compiled projection, not row by row inside collect_list, and each
    # list is collected once, where all its rows are.
    items = li.select(F.col("l_orderkey").alias("o_orderkey"), F.struct(*keys, item.alias("i")).alias("_e")).repartition("o_orderkey")
    per = (items.groupBy("o_orderkey").agg(F.sort_array(F.collect_list("_e")).alias("_l"))
           .select("o_orderkey", F.col("_l.i").alias("inputs")))
    req = orders.select("o_orderkey", *[F.expr(sql).alias(n) for n, sql in REQUEST_SQL.items()])
    out = req.join(per.hint("merge"), "o_orderkey", "left")
    return out.withColumn("inputs", F.coalesce("inputs", F.array().cast(per.schema["inputs"].dataType)))
