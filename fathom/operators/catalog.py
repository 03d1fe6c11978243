"""Catalogue projections: package rows -> datasets, models, runs.

All work happens inside each package row with higher-order functions
(``filter`` / ``transform`` / ``get``), so a projection is one narrow stage:
no shuffle, and the filters and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.nested import extra, first_or_blank, lenient_json_list, with_extras
from fathom.functions.rows import explode_kept, rows_where
from fathom.functions.text import strip_ws
from fathom.operators.joins import broadcast_if_small
from fathom.schemas import PUBLISHED

# Catalogue groups.
GROUP_MODELS = "type-model"
GROUP_DATASETS = "type-raw-data"  # raw and processed lists both read this group
GROUP_RUNS = "type-model-run"

# Link bases (job parameters in production).
DEFAULT_DOIP_BASE = "https://doip.example"
GHCR_PREFIX = "ghcr.io/"
GITHUB_BASE = "https://github.com/"
INPUT_DESC = "Input file"
OUTPUT_DESC = "Output file"

PARAMS_TYPE = "array<struct<name:string,value:variant>>"


def in_group(pkgs: DataFrame, group: str, max_rows: int | None = None) -> DataFrame:
    """Packages of one group; a cap only when asked for, as ordered top-k."""
    out = pkgs.where(F.exists("groups", lambda g: g["name"] == F.lit(group)))
    if max_rows is not None:
        out = out.orderBy("ord").limit(max_rows)
    return out


def doip_url(qid: Column, base: str = DEFAULT_DOIP_BASE) -> Column:
    """``<base>/doip/retrieve/<qid>``, ``""`` for a blank qid."""
    return F.when(qid != "", F.concat(F.lit(base.rstrip("/") + "/doip/retrieve/"), qid)).otherwise(F.lit(""))


def _s(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def parquet_components(resources: Column | str) -> Column:
    """Resources whose format is PARQUET (any case), as {name, url}."""
    r = F.col(resources) if isinstance(resources, str) else resources
    return F.transform(
        F.filter(r, lambda x: F.upper(F.coalesce(x["format"], F.lit(""))) == "PARQUET"),
        lambda x: F.struct(x["name"].alias("name"), x["url"].alias("url")))


# Reject reasons.
R_NULL_FORMAT = "resource format is null"
R_NO_SIZE = "size_bytes is null"
R_BAD_PARAMS = "model_parameters is not a JSON list"


def _null_format() -> Column:
    """A resource without a format (the original fails the whole list on it)."""
    return F.exists("resources", lambda r: r["format"].isNull())


def _first_parquet() -> Column:
    return F.get(F.filter("resources", lambda r: F.upper(F.coalesce(r["format"], F.lit(""))) == "PARQUET"), 0)


def _bad_params(raw_params: Column, parsed: Column | None = None) -> Column:
    """Non-blank model parameters that are not a JSON list."""
    parsed = F.from_json(raw_params, PARAMS_TYPE) if parsed is None else parsed
    return (raw_params.isNotNull() & (raw_params != "")
            & (parsed.isNull() | ~strip_ws(raw_params).startswith("[")))


def _reasons(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(msg)) for c, msg in checks]))


def models(pkgs: DataFrame, base: str = DEFAULT_DOIP_BASE) -> DataFrame:
    """Model rows with ``reasons`` (empty = valid)."""
    p = with_extras(in_group(pkgs, GROUP_MODELS),
                    ["model_qid", "docker_image", "docker_tag", "docker_image_created", "model_parameters"])
    p = p.withColumn("_params", F.from_json("_x_model_parameters", PARAMS_TYPE))
    image = F.col("_x_docker_image")
    raw_params = F.col("_x_model_parameters")
    url = _s("url")
    git = (F.when(url != "", url)
           .when(image.startswith(GHCR_PREFIX),
                 F.concat(F.lit(GITHUB_BASE), F.substring(image, len(GHCR_PREFIX) + 1, 1 << 20)))
           .otherwise(F.lit("")))
    return p.select(
        "ord",
        F.col("_x_model_qid").alias("qid"),
        _s("title").alias("name"),
        image.alias("docker_image"),
        F.col("_x_docker_tag").alias("docker_tag"),
        _s("notes").alias("description"),
        F.col("_x_docker_image_created").alias("docker_image_created"),
        doip_url(F.col("_x_model_qid"), base).alias("doip_url"),
        git.alias("git_repo"),
        F.when(raw_params == "", F.array().cast(PARAMS_TYPE)).otherwise(F.col("_params")).alias("additional_properties"),
        _reasons((_bad_params(raw_params, F.col("_params")), R_BAD_PARAMS)).alias("reasons"),
    )


def processed_datasets(pkgs: DataFrame, base: str = DEFAULT_DOIP_BASE) -> DataFrame:
    """Processed dataset rows (components kept as an array)."""
    p = with_extras(in_group(pkgs, GROUP_DATASETS), ["qid", "modified", "additional_type"])
    p = p.withColumn("_comps", parquet_components("resources"))
    qid = F.col("_x_qid")
    comps = F.col("_comps")
    return p.select(
        "ord",
        qid.alias("qid"),
        _s("title").alias("name"),
        _s("notes").alias("description"),
        _s("url").alias("source_url"),
        first_or_blank(comps, "url").alias("data_path"),
        F.col("_x_modified").alias("last_modified"),
        _s("metadata_created").alias("metadata_created"),
        doip_url(qid, base).alias("doip_url"),
        comps.alias("components"),
        F.col("_x_additional_type").alias("additional_type"),
        _reasons((_null_format(), R_NULL_FORMAT)).alias("reasons"),
    )


def raw_datasets(pkgs: DataFrame) -> DataFrame:
    """Raw rows; a package without a Parquet resource has no size -> reason."""
    p = in_group(pkgs, GROUP_DATASETS).withColumn("_size", _first_parquet()["size"])
    size = F.col("_size")
    return p.select(
        "ord",
        _s("title").alias("path"),
        size.alias("size_bytes"),
        extra("extras", "modified").alias("last_modified"),
        _reasons((size.isNull(), R_NO_SIZE), (_null_format(), R_NULL_FORMAT)).alias("reasons"),
    )


def model_runs(pkgs: DataFrame, base: str = DEFAULT_DOIP_BASE) -> DataFrame:
    """Model run rows."""
    p = with_extras(in_group(pkgs, GROUP_RUNS), ["qid"])
    qid = F.col("_x_qid")

    def urls(desc: str) -> Column:
        return F.transform(F.filter("resources", lambda r: r["description"] == F.lit(desc)), lambda r: r["url"])

    return p.select(
        "ord",
        qid.alias("run_id"),
        qid.alias("qid"),
        extra("extras", "model").alias("model_name"),
        extra("extras", "docker_tag").alias("docker_tag"),
        extra("extras", "status").alias("status"),
        extra("extras", "run_timestamp").alias("run_timestamp"),
        extra("extras", "computation_time").alias("computation_time"),
        urls(INPUT_DESC).alias("input_files"),
        urls(OUTPUT_DESC).alias("output_files"),
        lenient_json_list(extra("extras", "input_dataset_qids")).alias("input_dataset_qids"),
        lenient_json_list(extra("extras", "data_transformation_sql")).alias("data_transformation_sql"),
        doip_url(qid, base).alias("doip_url"),
        F.array().cast("array<string>").alias("reasons"),
    )


def reject_reasons(pkgs: DataFrame) -> DataFrame:
    """All rejected rows of the four tables in one pass over the packages:
    (ord, kind, reason), one row per reason, by the same rules the table
    builders apply, without building each table."""
    def grp(g):
        return F.exists("groups", lambda x: x["name"] == F.lit(g))

    def item(kind, cond, reason):
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason")))
    items = F.array_compact(F.array(
        item("raw_datasets", grp(GROUP_DATASETS) & _first_parquet()["size"].isNull(), R_NO_SIZE),
        item("raw_datasets", grp(GROUP_DATASETS) & _null_format(), R_NULL_FORMAT),
        item("processed_datasets", grp(GROUP_DATASETS) & _null_format(), R_NULL_FORMAT),
        item("models", grp(GROUP_MODELS) & _bad_params(extra("extras", "model_parameters")), R_BAD_PARAMS),
    ))
    return explode_kept(pkgs, ["ord"], items, None, "r").select("ord", "r.kind", "r.reason")


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reasons). valid + rejects = input."""
    ok = rows_where(rows, F.size("reasons") == 0).drop("reasons")
    bad = rows_where(rows, F.size("reasons") > 0)
    return ok, bad


def strict(rows: DataFrame) -> DataFrame:
    """All-or-nothing mode (one bad row fails the list): raise when any row is rejected."""
    bad = rows.where(F.size("reasons") > 0).select("reasons").limit(1).collect()
    if bad:
        raise ValueError(f"catalogue rows rejected: {bad[0]['reasons']}")
    return rows.drop("reasons")


def publish(rows: DataFrame, kind: str) -> DataFrame:
    """Keep only the declared fields of a published table."""
    return rows.select(*PUBLISHED[kind])


def lookup_runs(runs: DataFrame, ids: DataFrame, id_col: str = "run_id") -> DataFrame:
    """C13, batch form: case-insensitive id match, first run in feed order per id.

    ``ids`` may hold many ids; missing ids keep a row with ``found = false``.
    Only runs with a wanted id are kept, and reduced to one row per upper-cased
    qid (partial aggregation, so a hot qid never gathers in one task) before
    the join.
    """
    wanted = broadcast_if_small(ids.select(F.upper(F.col(id_col)).alias("_k")).distinct())
    first = (runs.withColumn("_k", F.upper("qid")).join(wanted, "_k", "left_semi").groupBy("_k")
             .agg(F.min_by(F.struct(*[c for c in runs.columns if c != "ord"]), F.col("ord")).alias("run")))
    out = (ids.withColumn("_k", F.upper(F.col(id_col)))
           .join(first, "_k", "left")
           .withColumn("found", F.col("run").isNotNull())
           .drop("_k"))
    return out
