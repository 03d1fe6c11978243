"""Run manifests: validate run requests and build their payloads.

A request row carries its selected datasets in selection order:
``inputs: array<struct<data_path, target_name, sql>>``. Every rule is an
expression inside the row, so validating any number of requests is one
narrow stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import WS_CLASS, strip_ws

# Fixed values.
DEFAULT_TAG = "latest"
TARGET_STEM = "input"
NO_DATASET = "Select at least one input dataset"
NO_MODEL = "Select a model"
BAD_JSON = "Invalid JSON"
DUP_NAMES = "All target filenames must be unique"
CONFIGURED = "Configured"
NOT_CONFIGURED = "Not configured yet"
# What a payload is made of.
PAYLOAD_COLUMNS = ("request_id", "inputs", "target_names", "model_image", "effective_tag", "config", "effective_sql")
# Line breaks as str.splitlines() knows them.
_BREAK = "[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
_SQL_LINE = f"(?:^|{_BREAK}){WS_CLASS}*(?:[^-{WS_CLASS[1:]}|-(?:[^-]|\\z))"


def has_sql(sql: Column) -> Column:
    """M2: some line is non-blank and not a ``--`` comment.

    One regex search over the whole text: at the start of the text or after
    a line break, skip whitespace (blank lines included) and find a
    character other than ``-``, or a ``-`` not followed by another."""
    text = F.coalesce(sql, F.lit(""))
    return (text != "") & text.rlike(_SQL_LINE)


def effective_sql(sql: Column) -> Column:
    return F.when(has_sql(sql), sql).otherwise(F.lit(""))


def name_suffix(data_path: Column) -> Column:
    """``.ext`` of the last path segment, ``""`` when it has no dot."""
    last = F.substring_index(F.coalesce(data_path, F.lit("")), "/", -1)
    return F.when(F.contains(last, F.lit(".")), F.concat(F.lit("."), F.substring_index(last, ".", -1))) \
        .otherwise(F.lit(""))


def target_names(inputs: Column) -> Column:
    """M1: the given name (trimmed) or ``input``, ``input2``, ... + the source suffix."""
    return F.transform(inputs, lambda e, i: strip_ws(F.coalesce(
        e["target_name"],
        F.concat(F.lit(TARGET_STEM), F.when(i == 0, F.lit("")).otherwise((i + 1).cast("string")),
                 name_suffix(e["data_path"])))))


def _py_text(v: Column) -> Column:
    """A JSON value as Python's str() shows the parsed value: True / False /
    None, floats with a point, ints and strings as they are. Nested lists and
    objects stay JSON text."""
    t = F.schema_of_variant(v)
    as_str = F.try_variant_get(v, "$", "string")
    return (F.when(t == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), F.lit("True")).otherwise(F.lit("False")))
            .when(t == "VOID", F.lit("None"))
            .when(t.startswith("DECIMAL") | (t == "DOUBLE") | (t == "FLOAT"),
                  F.try_variant_get(v, "$", "double").cast("string"))
            .otherwise(as_str))


def config_summary(config: Column) -> Column:
    """M5: first two ``key: value`` pairs of a JSON object, ``Configured`` for
    an empty one, ``Not configured yet`` when it is not a JSON object.

    The text is read once per row, into the one element of an array; written
    into the lambda below, the parse would run again for every use of a value."""
    cfg = strip_ws(F.coalesce(config, F.lit("")))
    read = F.struct(cfg.startswith("{").alias("braced"), F.try_parse_json(cfg).isNotNull().alias("ok"),
                    F.from_json(cfg, "map<string,variant>").alias("values"),
                    F.slice(F.json_object_keys(cfg), 1, 2).alias("keys"))

    def shown(r: Column) -> Column:
        pairs = F.array_join(F.transform(r["keys"], lambda k: F.concat(k, F.lit(": "), F.coalesce(
            _py_text(r["values"][k]), F.lit("None")))), ", ")
        return (F.when(~(r["braced"] & r["ok"] & r["values"].isNotNull()), F.lit(NOT_CONFIGURED))
                .when(F.size(r["keys"]) == 0, F.lit(CONFIGURED))
                .otherwise(pairs))
    return F.get(F.transform(F.array(read), shown), 0)


def _texts_where(*cases: tuple[Column, str]) -> Column:
    """The texts whose condition holds, in order. Plain array functions, no
    lambda, so the conditions are compiled with the rest of the row's work."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(cond, F.array(F.lit(text))).otherwise(none) for cond, text in cases])


def validate(requests: DataFrame) -> DataFrame:
    """Names, SQL, counts and reasons (empty = valid).

    Built in steps so each array expression is evaluated once per row; the
    optimizer does not merge projections that would repeat them."""
    cfg = strip_ws(F.coalesce(F.col("config"), F.lit("")))
    step = (requests
            .withColumn("target_names", target_names(F.col("inputs")))
            .withColumn("effective_sql", F.transform("inputs", lambda e: effective_sql(e["sql"]))))
    return step.select(
        "*",
        F.size("inputs").cast("long").alias("n_datasets"),
        F.size(F.filter("effective_sql", lambda s: s != "")).cast("long").alias("n_transforms"),
        F.coalesce(F.col("model_tag"), F.lit(DEFAULT_TAG)).alias("effective_tag"),
        config_summary(F.col("config")).alias("config_summary"),
        _texts_where(
            (F.size("inputs") == 0, NO_DATASET),
            (F.col("model_image").isNull(), NO_MODEL),
            (F.try_parse_json(cfg).isNull(), BAD_JSON),
            (F.size(F.array_distinct("target_names")) != F.size("target_names"), DUP_NAMES),
        ).alias("reasons"),
    )


def payload_json(checked: DataFrame) -> Column:
    """M6: the run payload as JSON text: files as [source, target] pairs in
    selection order, image, tag, the config text, and the SQL list aligned
    with the files."""
    files = F.zip_with("inputs", "target_names", lambda e, name: F.array(e["data_path"], name))
    return F.to_json(F.struct(F.struct(
        files.alias("input_data_files"),
        F.col("model_image").alias("model_image"),
        F.col("effective_tag").alias("model_tag"),
        strip_ws(F.col("config")).alias("config_json"),
        F.col("effective_sql").alias("data_transformation_sql"),
    ).alias("parameters")))


def write_payloads(checked: DataFrame, path: str) -> None:
    """Valid payloads as JSON lines (one per request).

    Only the columns of the payload are packed for the selection, so the
    others (``config_summary``) are never computed here."""
    from fathom.functions.rows import rows_where
    ok = rows_where(checked.select(*PAYLOAD_COLUMNS, "reasons"), F.size("reasons") == 0)
    (ok.select("request_id", payload_json(ok).alias("payload"))
     .write.mode("overwrite").json(path))


def file_format(name: str) -> str:
    """``csv`` / ``tsv`` by suffix, else ``parquet``."""
    low = name.lower().rstrip("/")
    return next((e for e in ("csv", "tsv") if low.endswith("." + e)), "parquet")


def stage_inputs(spark, inputs: list[tuple[str, str, str]], out_root: str) -> None:
    """One request's selected datasets, each through its effective SQL,
    written under its target name. ``inputs`` are the request's
    (data_path, target_name, sql) triples; each dataset is its own Spark job
    in a session of its own, reading and writing in parallel, in the formats
    that the names' suffixes say. Nothing passes through the driver."""
    from fathom.operators.preview import query_dataset
    for data_path, target, sql in inputs:
        rows = query_dataset(spark, data_path, sql if (sql or "").strip() else "SELECT * FROM df", file_format(data_path))
        out, to = rows.write.mode("overwrite"), f"{out_root.rstrip('/')}/{target}"
        if file_format(target) == "parquet":
            out.parquet(to)
        else:
            out.option("header", True).option("sep", "\t" if file_format(target) == "tsv" else ",").csv(to)
