"""Object-listing and sidecar projections (datasets, runs, models from sidecars)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.catalog import DEFAULT_DOIP_BASE, doip_url

SIDECAR_SUFFIX = ".fdo.json"
INPUT_PREFIX = "components/input/"
OUTPUT_PREFIX = "components/output/"
DEFAULT_STORE = "store://data/main"    # a job names its own


def _s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def qid_from_path(path: Column) -> Column:
    """Last path segment without the sidecar suffix."""
    last = F.substring_index(path, "/", -1)
    return F.when(last.endswith(SIDECAR_SUFFIX),
                  F.substring(last, F.lit(1), F.length(last) - len(SIDECAR_SUFFIX))).otherwise(last)


def shard_path(qid: Column) -> Column:
    """Upper-case, strip leading Qs, zero-fill to 6, ``dd/dd/dd/QID``.

    Zero-fill never cuts: ids of 7+ digits keep all digits, only chars 1-6
    are used for the shard folders."""
    up = F.upper(qid)
    digits = F.regexp_replace(up, "^Q+", "")
    filled = F.when(F.length(digits) >= 6, digits).otherwise(F.lpad(digits, 6, "0"))
    return F.concat_ws("/", F.substring(filled, 1, 2), F.substring(filled, 3, 2), F.substring(filled, 5, 2), up)


def sidecar_lookup_path(run_id: Column) -> Column:
    """Where the sidecar of a run id lives: ``<shard>/<QID>.fdo.json``."""
    return F.concat(shard_path(run_id), F.lit("/"), F.upper(run_id), F.lit(SIDECAR_SUFFIX))


def raw_objects(listing: DataFrame) -> DataFrame:
    """L1: listing minus sidecars; mtime shown as text."""
    return (listing.where(~F.col("path").endswith(SIDECAR_SUFFIX))
            .select("path", F.col("mtime").cast("string").alias("last_modified"), "size_bytes"))


def tag_after_colon(attribution: Column) -> Column:
    """Text after the last ``:``, ``""`` when there is none."""
    a = _s(attribution)
    return F.when(F.contains(a, F.lit(":")), F.substring_index(a, ":", -1)).otherwise(F.lit(""))


def _components(sidecars_col: str = "kernel") -> Column:
    return F.coalesce(F.col(f"{sidecars_col}.`fdo:hasComponent`"),
                      F.array().cast("array<struct<`@id`:string,componentId:string>>"))


def datasets_from_sidecars(sc: DataFrame, store: str = DEFAULT_STORE, base: str = DEFAULT_DOIP_BASE) -> DataFrame:
    """L2-L4: processed datasets from sidecars (listing fields come with the scan)."""
    qid = _s(F.col("`@id`"))
    fdo_dir = F.regexp_replace("path", "/[^/]*$", "")
    comp_base = F.concat(F.lit(store.rstrip("/") + "/"), fdo_dir, F.lit("/"))
    link = F.lit(base.rstrip("/") + "/doip/retrieve/")
    comps = F.transform(
        F.filter(_components(), lambda c: (_s(c["componentId"]) != "") & (_s(c["@id"]) != "")),
        lambda c: F.struct(c["componentId"].alias("name"),
                           F.concat(link, qid, F.lit("/"), c["componentId"]).alias("url"),
                           F.concat(comp_base, c["@id"]).alias("lakefs_path")))
    return sc.select(
        qid.alias("qid"),
        _s(F.col("profile.name")).alias("name"),
        _s(F.col("profile.description")).alias("description"),
        _s(F.col("profile.url")).alias("source_url"),
        F.concat(F.lit(store.rstrip("/") + "/"), F.col("path")).alias("lakefs_path"),
        F.coalesce(F.get(comps, 0)["lakefs_path"], F.lit("")).alias("data_path"),
        F.col("mtime").cast("string").alias("last_modified"),
        doip_url(qid, base).alias("doip_url"),
        comps.alias("components"),
    )


def runs_from_sidecars(sc: DataFrame, base: str = DEFAULT_DOIP_BASE) -> DataFrame:
    """Model runs from sidecars; qid from the object path."""
    qid = qid_from_path(F.col("path"))
    ids = F.transform(_components(), lambda c: _s(c["@id"]))
    return sc.select(
        qid.alias("run_id"), qid.alias("qid"),
        _s(F.col("profile.name")).alias("model_name"),
        tag_after_colon(F.col("provenance.`prov:wasAttributedTo`")).alias("docker_tag"),
        F.lit("").alias("status"),
        _s(F.col("kernel.modified")).alias("run_timestamp"),
        F.lit("").alias("computation_time"),
        F.filter(ids, lambda i: i.startswith(INPUT_PREFIX)).alias("input_files"),
        F.filter(ids, lambda i: i.startswith(OUTPUT_PREFIX)).alias("output_files"),
        F.concat(F.lit(base.rstrip("/") + "/doip/retrieve/"), qid).alias("doip_url"),
    )


def models_from_sidecars(sc: DataFrame) -> DataFrame:
    """Models from sidecars: image = profile url, tag = software version."""
    qid = qid_from_path(F.col("path"))
    return sc.select(
        qid.alias("qid"),
        _s(F.col("profile.name")).alias("name"),
        _s(F.col("profile.description")).alias("description"),
        _s(F.col("profile.url")).alias("docker_image"),
        _s(F.col("profile.softwareVersion")).alias("docker_tag"),
    )


def lookup_sidecar_runs(sc: DataFrame, ids: DataFrame, id_col: str = "run_id",
                        base: str = DEFAULT_DOIP_BASE) -> DataFrame:
    """L11, batch form: each id to the run whose sidecar sits at its shard path.

    An equi-join on the computed path (no scan per id); ids without a sidecar
    keep a row with ``found = false``. The run id shown is the id as asked.
    """
    side = sc.select(F.col("path").alias("_path"), "profile", "provenance")
    looked = ids.withColumn("_path", sidecar_lookup_path(F.col(id_col)))
    hit = looked.join(side, "_path", "left")
    return hit.select(
        F.col(id_col).alias("run_id"),
        F.col("profile").isNotNull().alias("found"),
        _s(F.col("profile.name")).alias("model_name"),
        tag_after_colon(F.col("provenance.`prov:wasAttributedTo`")).alias("docker_tag"),
        F.col("_path").alias("sidecar_path"),
    )
