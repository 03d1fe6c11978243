"""Jobs over files and text that Spark writes from the tables: replies (S1),
object listing (S3), sidecars (S4, L11), payloads (M6, S8), publishing (S9),
staging (M11), text rendering (P6) and text numbers (X12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions.text import to_number
from fathom.operators import catalog, manifest, preview
from fathom.plans.catalogue_jobs import _FIRST_PARQUET, _PARAMS_OK, _pkgs
from fathom.plans.manifest_jobs import _BASE, _CFG
from fathom.plans.oracle_bindings import with_catalogue
from fathom.plans.registry import register
from fathom.session import read_table, scratch_folder
from fathom.sources import bindings, feed, feed_split, listing, sinks, snapshots
from fathom.streaming import upkeep


# ---------------------------------------------------------------- S1: reply files
# one reply per 100 customers of a nation; every fifth nation's replies failed
@register("feed_replies", """
SELECT CASE WHEN c_nationkey % 5 = 0 THEN 'failed' ELSE 'package' END AS kind,
  CASE WHEN c_nationkey % 5 = 0 THEN 'nation ' || CAST(c_nationkey AS VARCHAR) ELSE c_name END AS name,
  CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE c_custkey % 100 END AS pos, CAST(count(*) AS BIGINT) AS n
FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY ALL
UNION ALL
SELECT 'failed', 'nation ' || CAST(c_nationkey AS VARCHAR), 0, CAST(count(DISTINCT c_custkey // 100) AS BIGINT)
FROM customer WHERE c_nationkey % 5 = 0 GROUP BY c_nationkey
""")
def feed_replies(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name")
    item = F.struct(F.col("c_name").alias("title"), (F.col("c_custkey") % 100).cast("string").alias("notes"))
    replies = cust.groupBy("c_nationkey", F.expr("c_custkey div 100").alias("_page")).agg(F.collect_list(item).alias("results"))
    bad = F.col("c_nationkey") % 5 == 0
    text = F.to_json(F.struct((~bad).alias("success"), F.when(bad, F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))).alias("error"),
                              F.struct(F.when(~bad, F.col("results")).alias("results")).alias("result")))
    root = scratch_folder(spark, "replies")
    replies.select(text.alias("value")).write.text(root)
    env = feed.read_feed(spark, root, multi_line=False)
    ok = feed.packages(env).groupBy("title", F.col("notes").cast("long").alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    failed = feed.feed_rejects(env).groupBy("error").agg(F.count(F.lit(1)).alias("n"))
    return (ok.select(F.lit("package").alias("kind"), F.col("title").alias("name"), "pos", "n")
            .unionByName(failed.select(F.lit("failed").alias("kind"), F.col("error").alias("name"), F.lit(0).cast("long").alias("pos"), "n")))


# ---------------------------------------------------------------- S1: replies of any size, by many tasks
# one reply file per nation with all its customers; every fifth nation's reply failed
_NOTES = """c_mktsegment || ' "}, {[\\' || CAST(c_acctbal AS STRING)"""


@register("feed_split", f"""
SELECT c_nationkey, c_name AS name, {_NOTES} AS notes, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) AS pos
FROM customer WHERE c_nationkey % 5 <> 0
UNION ALL SELECT DISTINCT c_nationkey, 'failed', 'no "results": [ of ' || CAST(c_nationkey AS VARCHAR), CAST(0 AS BIGINT) FROM customer WHERE c_nationkey % 5 = 0
""")
def feed_split_replies(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    ends = cust.groupBy("nation").agg(F.min("c_custkey").alias("first"), (F.max("c_custkey") + 1).alias("last"))
    good, key = cust.where("nation % 5 <> 0"), F.col("nation").cast("string")
    notes = F.expr(_NOTES.replace("\\", "\\\\"))
    item = F.to_json(F.struct(F.col("c_name").alias("title"), notes.alias("notes"), F.array(F.struct(F.lit("k").alias("key"), notes.alias("value"))).alias("extras")))
    items = good.join(ends, "nation").select("nation", F.col("c_custkey").alias("ord"), F.concat(F.when(F.col("c_custkey") > F.col("first"), ",").otherwise(""), item).alias("value"))
    said = F.to_json(F.struct(F.lit(False).alias("success"), F.concat(F.lit('no "results": [ of '), key).alias("error")))
    head = F.when(F.expr("nation % 5 = 0"), said).otherwise(F.lit('{"success": true, "help": "}",\n "result": {"count": 1, "results": ['))
    heads = ends.select("nation", F.lit(-1).cast("long").alias("ord"), head.alias("value"))
    tails = ends.where("nation % 5 <> 0").select("nation", F.col("last").alias("ord"), F.lit(']}, "tags": [{"results": [{"title": "no package"}]}]}').alias("value"))
    root = scratch_folder(spark, "large-replies")
    (items.unionByName(heads).unionByName(tails).repartition("nation").sortWithinPartitions("nation", "ord")
     .drop("ord").write.partitionBy("nation").text(root))
    env, pkgs = feed_split.read_feed_split(spark, root)
    nation = lambda src: F.regexp_extract(src, "nation=([0-9]+)/", 1).cast("long").alias("c_nationkey")
    return (pkgs.select(nation(F.col("ord.src")), F.col("title").alias("name"), "notes", F.col("ord.pos").alias("pos"))
            .unionByName(feed.feed_rejects(env).select(nation(F.col("src")), F.lit("failed").alias("name"), F.col("error").alias("notes"), F.lit(0).cast("long").alias("pos"))))


# ---------------------------------------------------------------- S3: object listing
@register("object_listing", """
SELECT CAST(n_nationkey AS VARCHAR) AS folder, CAST(1 AS BIGINT) AS n_objects, TRUE AS has_size, TRUE AS has_mtime
FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey)
""")
def object_listing(spark, sf_dir):
    root = scratch_folder(spark, "objects")
    read_table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey").repartition("c_nationkey").write.partitionBy("c_nationkey").parquet(root)
    found = listing.list_objects(spark, root).where(F.col("path").endswith(".parquet"))
    return (found.groupBy(F.regexp_extract("path", "^c_nationkey=([0-9]+)/", 1).alias("folder"))
            .agg(F.count(F.lit(1)).alias("n_objects"), F.bool_and(F.col("size_bytes") > 0).alias("has_size"),
                 F.bool_and(F.col("mtime") > 1_700_000_000).alias("has_mtime")))


# ---------------------------------------------------------------- S4: sidecar text
_SIDECAR_TEXT = ("CASE doc_id % 6 WHEN 0 THEN '{\"@id\": \"Q' || CAST(doc_id AS STRING) || '\", \"profile\": {\"name\": \"' || lang || '\"}}' "
                 "WHEN 1 THEN '{\"@id\": \"Q' || CAST(doc_id AS STRING) WHEN 2 THEN '[1, 2]' WHEN 3 THEN 'plain' WHEN 4 THEN '' ELSE '{}' END")


@register("sidecar_texts", """
SELECT doc_id, doc_id % 6 IN (0, 5) AS parsed, CASE WHEN doc_id % 6 = 0 THEN 'Q' || CAST(doc_id AS VARCHAR) END AS qid,
  CASE WHEN doc_id % 6 = 0 THEN lang END AS name FROM documents
""")
def sidecar_texts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.expr(_SIDECAR_TEXT).alias("text"))
    good, bad = listing.parse_sidecars(docs)
    none = F.lit(None).cast("string")
    return (good.select("doc_id", F.lit(True).alias("parsed"), F.col("`@id`").alias("qid"), F.col("profile.name").alias("name"))
            .unionByName(bad.select("doc_id", F.lit(False).alias("parsed"), none.alias("qid"), none.alias("name"))))


# ---------------------------------------------------------------- L11: point lookups
_ASKED = ("q3", "Q12", "Qabc", "", "Q9999999999")


@register("listing_point_lookup", """
SELECT 'Q' || CAST(doc_id AS VARCHAR) AS qid, 'doc ' || CAST(doc_id AS VARCHAR) || ' ' || lang AS name FROM documents WHERE doc_id IN (3, 12)
""")
def listing_point_lookup(spark, sf_dir):
    root = scratch_folder(spark, "sidecars")
    sinks.write_sidecar_table(bindings.sidecars(spark, sf_dir).select("path", "profile"), root)
    return sinks.lookup_sidecars(spark, root, list(_ASKED)).select(
        F.regexp_extract("path", "([^/]+)[.]fdo[.]json$", 1).alias("qid"), F.col("profile.name").alias("name"))


# ---------------------------------------------------------------- M6, S8: payload JSON
@register("manifest_payload_json", _BASE + f"""
, files AS (SELECT o_orderkey, list([data_path, target] ORDER BY pos) AS f, list(eff_sql ORDER BY pos) AS q FROM n GROUP BY o_orderkey)
SELECT request_id, CAST(len(f) AS BIGINT) AS n_files, f[1][1] AS first_path, f[1][2] AS first_target, f[len(f)][2] AS last_target,
  model_image, coalesce(model_tag, 'latest') AS model_tag, {_CFG} AS config_text, array_to_string(q, '|') AS sql_text
FROM chk JOIN files USING (o_orderkey) WHERE len(reasons) = 0
""")
def manifest_payload_json(spark, sf_dir):
    path = scratch_folder(spark, "payloads")
    manifest.write_payloads(manifest.validate(bindings.requests(spark, sf_dir)), path)
    got = spark.read.schema("request_id string, payload string").json(path)
    p = F.from_json("payload", "parameters struct<input_data_files:array<array<string>>,model_image:string,model_tag:string,config_json:string,"
                               "data_transformation_sql:array<string>>")["parameters"]
    files = F.col("p.input_data_files")
    return got.select("request_id", p.alias("p")).select(
        "request_id", F.size(files).cast("long").alias("n_files"), files[0][0].alias("first_path"), files[0][1].alias("first_target"),
        F.element_at(F.element_at(files, -1), 2).alias("last_target"), F.col("p.model_image").alias("model_image"), F.col("p.model_tag").alias("model_tag"),
        F.col("p.config_json").alias("config_text"), F.array_join("p.data_transformation_sql", "|").alias("sql_text"))


# ---------------------------------------------------------------- S9: published tables
_OK_RAW = f"{_FIRST_PARQUET.format(col='size')} IS NOT NULL"


@register("catalog_published", with_catalogue(f"""
SELECT 'raw_datasets' AS kind, NOT ({_OK_RAW}) AS rejected, CAST(count(*) AS BIGINT) AS n FROM px WHERE grp = 'type-raw-data' GROUP BY 2
UNION ALL SELECT 'models', NOT ({_PARAMS_OK}), CAST(count(*) AS BIGINT) FROM px WHERE grp = 'type-model' GROUP BY 2
UNION ALL SELECT 'processed_datasets', FALSE, CAST(count(*) AS BIGINT) FROM px WHERE grp = 'type-raw-data'
UNION ALL SELECT 'model_runs', FALSE, CAST(count(*) AS BIGINT) FROM px WHERE grp = 'type-model-run'
"""))
def catalog_published(spark, sf_dir):
    """Rows per published table, and rejected packages, of one publication."""
    root, pk = scratch_folder(spark, "published"), _pkgs(spark, sf_dir)
    sinks.publish_catalogue(pk, root)
    parts = [spark.read.parquet(f"{root}/{kind}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit(False).alias("rejected"), "n")
             for kind in sinks.catalogue_tables(pk)]
    bad = spark.read.parquet(f"{root}/rejects").groupBy("kind").agg(F.count_distinct("ord").alias("n")).select("kind", F.lit(True).alias("rejected"), "n")
    for p in parts:
        bad = bad.unionByName(p)
    return bad


@register("catalog_snapshot", with_catalogue(f"""
SELECT 'current' AS version, coalesce(title, '') AS path, {_FIRST_PARQUET.format(col='size')} AS size_bytes, x_modified AS last_modified
FROM px WHERE grp = 'type-raw-data' AND {_OK_RAW}
UNION ALL SELECT 'before', coalesce(title, ''), {_FIRST_PARQUET.format(col='size')}, x_modified
FROM px WHERE grp = 'type-raw-data' AND {_OK_RAW} AND contains(coalesce(title, ''), '1')
"""))
def catalog_snapshot(spark, sf_dir):
    """The rows of the current snapshot, and of the one before it."""
    root, pk = scratch_folder(spark, "snapshots"), _pkgs(spark, sf_dir)
    first = snapshots.publish_snapshot(pk.where(F.contains(F.coalesce("title", F.lit("")), F.lit("1"))), root)
    snapshots.publish_snapshot(pk, root)
    rows = lambda name, version: snapshots.read_snapshot(spark, root, "raw_datasets", version).select(F.lit(name).alias("version"), "*")
    return rows("current", None).unionByName(rows("before", first))


# ---------------------------------------------------------------- S9, R3: upkeep by batches, the last version of a qid wins
_SENT = ((0, "TRUE", ""), (1, "pkg_id % 5 = 0", " v1"), (2, "pkg_id % 7 = 0", " v2"))


@register("catalog_upkeep", with_catalogue(", sent AS (\n" + "\nUNION ALL ".join(
    f"SELECT {b} AS batch_id, pkg_id, x_qid AS qid, coalesce(title, '') || '{v}' AS name FROM px WHERE grp = 'type-raw-data' AND {cond}" for b, cond, v in _SENT) + """)
SELECT qid, name, CAST(batch_id AS BIGINT) AS batch_id, pkg_id AS feed_pos FROM sent
QUALIFY row_number() OVER (PARTITION BY qid, CASE WHEN qid = '' THEN pkg_id END ORDER BY batch_id DESC, pkg_id DESC) = 1
"""))
def catalog_upkeep(spark, sf_dir):
    """All packages, some of them sent again under other names; the first two
    batches have become a base."""
    root, pk = scratch_folder(spark, "upkeep"), _pkgs(spark, sf_dir)
    for b, cond, version in _SENT:
        sent = pk.where(cond.replace("pkg_id", "ord.pos")).withColumn("title", F.concat(F.coalesce("title", F.lit("")), F.lit(version)))
        upkeep.merge_batch(sent, root, b, ("processed_datasets",))
    upkeep.compact(spark, root, "processed_datasets")
    upkeep.retire(spark, root, "processed_datasets", keep=1)
    return upkeep.current(spark, root, "processed_datasets").select("qid", "name", "batch_id", F.col("ord.pos").alias("feed_pos"))


# ---------------------------------------------------------------- M11: staged inputs
@register("manifest_staged", """
SELECT 'input.parquet' AS target, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events WHERE value > 100
UNION ALL SELECT 'input2.csv', CAST(count(*) AS BIGINT), CAST(sum(c_custkey) AS BIGINT) FROM customer
UNION ALL SELECT 'again.tsv', CAST(count(*) AS BIGINT), CAST(sum(c_custkey) AS BIGINT) FROM customer WHERE c_custkey % 2 = 0
""")
def manifest_staged(spark, sf_dir):
    root, d = scratch_folder(spark, "staged"), sf_dir.rstrip("/")
    manifest.stage_inputs(spark, [(f"{d}/events.parquet", "input.parquet", "SELECT event_id AS id FROM df WHERE value > 100"),
                                  (f"{d}/customer.parquet", "input2.csv", "SELECT c_custkey AS id FROM df")], root)
    manifest.stage_inputs(spark, [(f"{root}/input2.csv", "again.tsv", "SELECT id FROM df WHERE id % 2 = 0")], root)
    out = None
    for target in ("input.parquet", "input2.csv", "again.tsv"):
        rows = preview.register_dataset(preview.isolated(spark), f"{root}/{target}", manifest.file_format(target))
        one = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("id").cast("long").alias("id_sum")).select(F.lit(target).alias("target"), "n", "id_sum")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- P6: all columns as text
@register("preview_as_text", """
SELECT coalesce(CAST(nullif(event_id % 3, 0) AS VARCHAR), 'None') AS k, coalesce(CAST(CASE WHEN event_id % 5 <> 0 THEN CAST(ts AS DATE) END AS VARCHAR), 'NaT') AS d,
  coalesce(CASE WHEN event_id % 7 <> 0 THEN event_type END, 'None') AS s, CASE WHEN event_id % 2 = 0 THEN 'nan' ELSE '0.5' END AS x, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY ALL
""")
def preview_as_text(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select(
        F.expr("nullif(event_id % 3, 0)").alias("k"), F.expr("CASE WHEN event_id % 5 <> 0 THEN CAST(ts AS DATE) END").alias("d"),
        F.expr("CASE WHEN event_id % 7 <> 0 THEN event_type END").alias("s"), F.expr("CASE WHEN event_id % 2 <> 0 THEN CAST(0.5 AS DOUBLE) END").alias("x"))
    return preview.as_text(ev).groupBy("k", "d", "s", "x").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- X12: text to number
_NUMBER_TEXT = ("CASE event_id % 8 WHEN 0 THEN ' ' || CAST(event_id AS STRING) || ' ' WHEN 1 THEN CAST(event_id AS STRING) || 'd' WHEN 2 THEN 'nan' "
                "WHEN 3 THEN '' WHEN 4 THEN CAST(event_id AS STRING) || '.' WHEN 5 THEN '-.5' WHEN 6 THEN '1_000' ELSE '+' || CAST(event_id AS STRING) || 'e1' END")


@register("series_text_numbers", """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN CAST(event_id AS DOUBLE) WHEN 4 THEN CAST(event_id AS DOUBLE) WHEN 5 THEN -0.5
  WHEN 7 THEN CAST(event_id * 10 AS DOUBLE) END AS x FROM events
""")
def series_text_numbers(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", to_number(F.expr(_NUMBER_TEXT)).alias("x"))
