"""Loading run files with Spark's readers.

The files of a request may have any schema. Their schemas are indexed first,
from Parquet footers and CSV header lines, with one small read per file and
many of them at once; the driver holds one schema per file, as Spark's own
file index holds one status per file. Then every group of files with one
schema is one scan, so no file's content is ever held in a row, a large file
is read by many tasks, and a file may have any number of parts. A recorded
query (X6) runs on its source in a session of its own; its result is loaded
like a file.

All rows go into one stored long table (path, query, part, block, i, ordinal,
column, value). A row's number in its file is its place in its part plus the
rows of the parts before, which takes one small table of counts (X9).

One file never fails another (X22): a schema that cannot be read, a query
that fails, a CSV row with more fields than the header, and Parquet data of
which fewer rows can be read than the footers promise give that file an error.
CSV rows are lines; a row with fewer fields is filled with nulls.
"""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.text import gap_to_null, is_strict_number
from fathom.operators import preview
from fathom.operators.joins import broadcast_if_small
from fathom.session import checkpoint_dir, cut_lineage

READ_ERRORS = (PySparkException, Py4JJavaError)
AT_ONCE = 8                 # small reads, scans and replays in flight
NOT_FOUND, UNREADABLE, TOO_WIDE = "not found", "unreadable data", "a row has more fields than the header"
ROWS = "path string, query string, part string, block long, i long, ordinal int, column string, value string, wide boolean"
EXPECTED = "path string, query string, expected long"
_TEXT = {".csv": ",", ".tsv": "\t"}


@dataclass(frozen=True)
class LoadedFile:
    """One distinct (path, query) of a request and what is known of it."""

    path: str
    ext: str
    query: str
    schema: T.StructType | None = None
    error: str | None = None


def _message(e: Exception) -> str:
    said = str(e.java_exception.getMessage()) if isinstance(e, Py4JJavaError) else str(e)
    causes = re.findall(r"^Caused by: [\w.$]+: (.*)$", said, re.M)    # of a failed job: what its task says
    text = causes[0] if causes else (said.strip() or type(e).__name__).splitlines()[0]
    return NOT_FOUND if "PATH_NOT_FOUND" in text else text[:200]


def _text_reader(spark: SparkSession, ext: str):
    return spark.read.option("header", True).option("sep", _TEXT[ext])


def _in_pool(spark: SparkSession, work, items: list) -> list:
    """``work`` of every item, ``AT_ONCE`` at a time, each on a scheduler pool
    of its own so that one large job does not hold the others up."""
    def run(numbered):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"load-{numbered[0] % AT_ONCE}")
        return work(numbered[1])
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(run, enumerate(items)))


def index_files(spark: SparkSession, root: str, wanted: list[tuple[str, str, str]]) -> list[LoadedFile]:
    """The schema, or the error, of every (path under ``root``, ext, query)."""
    def one(key: tuple[str, str, str]) -> LoadedFile:
        path, ext, query = key
        at = f"{root.rstrip('/')}/{path}"
        try:
            if ext in _TEXT:
                schema = _text_reader(spark, ext).csv(at).schema
            elif query.strip():
                schema = preview.query_dataset(spark, at, query).schema
            else:
                schema = spark.read.parquet(at).schema
        except READ_ERRORS as e:
            return LoadedFile(path, ext, query, None, _message(e))
        return LoadedFile(path, ext, query, schema)
    return _in_pool(spark, one, wanted)


def _cells(df: DataFrame, schema: T.StructType, keys: list[Column], wide: Column) -> DataFrame:
    """Long rows: ``keys`` and one row per column of ``schema``, whose values
    are the first columns of ``df`` in order (names may repeat)."""
    named = df.select(*[F.col(f"_{i}").cast("string").alias(f"_{i}") for i in range(len(schema))], *keys, wide.alias("wide"))
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"), F.col(f"_{i}").alias("value")) for i, f in enumerate(schema)])
    return named.select("path", "query", "part", "block", "i", F.inline(cells), "wide").select(*T.StructType.fromDDL(ROWS).names)


def _positional(df: DataFrame, n: int, extra: list[Column]) -> DataFrame:
    """``df`` with its first ``n`` columns named by place, and ``extra``."""
    out = df.select("*", *extra)
    return out.toDF(*[f"_{i}" for i in range(n)], *out.columns[n:])


def _wanted_path(root: str) -> Column:
    """The path under ``root`` that a part belongs to."""
    from fathom.sources.listing import relative_path
    return F.regexp_replace(relative_path(F.col("_metadata.file_path"), root), "/part-[^/]*$", "")


def scan_group(spark: SparkSession, root: str, files: list[LoadedFile]) -> tuple[DataFrame, DataFrame | None]:
    """(long rows, rows expected by the footers) of files with one schema."""
    ext, schema = files[0].ext, files[0].schema
    paths, n = [f"{root.rstrip('/')}/{f.path}" for f in files], len(schema)
    part, path = F.col("_metadata.file_path").alias("part"), _wanted_path(root).alias("path")
    if ext in _TEXT:
        extra = "_more"
        while extra in schema.names:
            extra += "_"
        read = T.StructType([*(T.StructField(f.name, T.StringType()) for f in schema), T.StructField(extra, T.StringType())])
        df = _text_reader(spark, ext).schema(read).csv(paths)
        flat = _positional(df, n + 1, [part, path, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i")])
        return _cells(flat, schema, [F.col("path"), F.lit("").alias("query"), F.col("part"), F.col("block"), F.col("i")], F.col(f"_{n}").isNotNull()), None
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", True)
    flat = _positional(reader.parquet(*paths), n, [part, path, F.col("_metadata.row_index").alias("i")])
    rows = _cells(flat, schema, [F.col("path"), F.lit("").alias("query"), F.col("part"), F.lit(0).cast("long").alias("block"), F.col("i")], F.lit(False))
    counted = spark.read.schema(schema).parquet(*paths).select(path).groupBy("path").agg(F.count(F.lit(1)).alias("expected"))
    return rows, counted.select("path", F.lit("").alias("query"), "expected")


def replay_rows(spark: SparkSession, root: str, f: LoadedFile) -> DataFrame:
    """The long rows of a recorded query's result, in the result's order
    (a sorted result has its rows in the order of its partitions)."""
    result = preview.query_dataset(spark, f"{root.rstrip('/')}/{f.path}", f.query)
    row = F.monotonically_increasing_id()
    flat = _positional(result, len(f.schema), [row.alias("_row")])
    keys = [F.lit(f.path).alias("path"), F.lit(f.query).alias("query"), F.lpad(F.shiftright("_row", 33).cast("string"), 10, "0").alias("part"),
            F.lit(0).cast("long").alias("block"), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)).alias("i")]
    return _cells(flat, f.schema, keys, F.lit(False))


def read_files(spark: SparkSession, root: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, columns, outcome) of the distinct (path, ext, query) in ``wanted``.

    rows: path, query, row_pos 1..n, ordinal, column, value as text, of the
    files that could be read. columns: path, query, ordinal, column, type (null
    in text files).
    outcome: path, query, error (null for a file that was read)."""
    keys = sorted({(r["path"], r["ext"], r["query"] or "") for r in wanted.select("path", "ext", "query").distinct().toLocalIterator()})
    index = index_files(spark, root, keys)
    groups: dict[tuple, list[LoadedFile]] = {}
    for f in index:
        if f.schema is not None and len(f.schema):
            groups.setdefault((f.path, f.query) if f.query.strip() else (f.ext, f.schema.json()), []).append(f)
    out = f"{checkpoint_dir(spark).rstrip('/')}/loaded-{uuid.uuid4().hex}"
    spark.createDataFrame([], ROWS).write.parquet(f"{out}/rows/none")
    spark.createDataFrame([], EXPECTED).write.parquet(f"{out}/expected/none")

    def load(item: tuple[int, list[LoadedFile]]) -> list[tuple[str, str, str]]:
        number, files = item
        try:
            if files[0].query.strip():
                rows, expected = replay_rows(spark, root, files[0]), None
            else:
                rows, expected = scan_group(spark, root, files)
            rows.write.mode("overwrite").parquet(f"{out}/rows/{number}")
            if expected is not None:
                expected.write.mode("overwrite").parquet(f"{out}/expected/{number}")
        except READ_ERRORS as e:
            if len(files) == 1:
                return [(files[0].path, files[0].query, _message(e))]
            # one file of the group fails the scan: halves of it, until it is alone
            half = len(files) // 2
            return load((f"{number}-0", files[:half])) + load((f"{number}-1", files[half:]))
        return []
    failed = [x for xs in _in_pool(spark, load, list(enumerate(groups.values()))) for x in xs]
    errors = {(p, q): e for p, q, e in failed}
    known = spark.createDataFrame([(f.path, f.query, f.error or errors.get((f.path, f.query))) for f in index], "path string, query string, failure string")
    columns = spark.createDataFrame([(f.path, f.query, i, c.name, None if f.ext in _TEXT else c.dataType.simpleString()) for f in index if f.schema is not None for i, c in enumerate(f.schema)],
                                    "path string, query string, ordinal int, column string, type string")
    stored = spark.read.schema(ROWS).parquet(f"{out}/rows/*")
    expected = spark.read.schema(EXPECTED).parquet(f"{out}/expected/*")
    parts = cut_lineage(stored.where("ordinal = 0").groupBy("path", "query", "part", "block")
                        .agg(F.min("i").alias("low"), F.count(F.lit(1)).alias("n"), F.max("wide").alias("wide")))
    before = Window.partitionBy("path", "query").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).select("path", "query", "part", "block", "low", "shift")
    seen = parts.groupBy("path", "query").agg(F.sum("n").alias("n"), F.max("wide").alias("wide"))
    error = (F.when(F.col("failure").isNotNull(), F.col("failure")).when(F.col("wide"), TOO_WIDE)
             .when(F.col("expected") > F.coalesce("n", F.lit(0)), UNREADABLE))
    outcome = cut_lineage(known.join(seen, ["path", "query"], "left").join(expected, ["path", "query"], "left").select("path", "query", error.alias("error")))
    good = broadcast_if_small(outcome.where("error IS NULL").select("path", "query"))
    rows = (stored.join(good, ["path", "query"], "left_semi").join(broadcast_if_small(shift), ["path", "query", "part", "block"])
            .select("path", "query", (F.col("i") - F.col("low") + F.col("shift") + 1).alias("row_pos"), "ordinal", "column", "value"))
    return rows, columns, outcome


_TYPED = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz")


def file_profile(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per (path, query, ordinal): column, type, n_rows, n_gaps,
    is_numeric (X11), n_distinct (approximate), low and high of the numbers.

    One pass with mergeable aggregates. A Parquet column has its own type. A
    text column has the least type that takes all its values, gaps aside:
    boolean, bigint, double or string; so a column of gaps alone is double."""
    value = gap_to_null(F.col("value"))
    long = F.expr("try_cast(value AS bigint)").isNotNull() & F.col("value").rlike("^[-+]?[0-9]+$")
    of_text = rows.groupBy("path", "query", "ordinal").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(value.isNull()).alias("n_gaps"),
        F.bool_and(value.isNull() | F.lower("value").isin("true", "false")).alias("_bool"), F.bool_and(value.isNull() | long).alias("_long"),
        F.bool_and(is_strict_number(F.col("value"))).alias("_number"), F.approx_count_distinct(value).alias("n_distinct"),
        F.min(F.expr("try_cast(value AS double)")).alias("low"), F.max(F.expr("try_cast(value AS double)")).alias("high"))
    least = (F.when(F.col("n_gaps") == F.col("n_rows"), "double").when(F.col("_bool"), "boolean").when(F.col("_long") & (F.col("n_gaps") == 0), "bigint")
             .when(F.col("_long") | F.col("_number"), "double").otherwise("string"))
    typed = F.col("type").isin(*_TYPED) | F.col("type").startswith("decimal")
    zero = F.lit(0).cast("long")
    return columns.join(of_text, ["path", "query", "ordinal"], "left").select(
        "path", "query", "ordinal", "column", F.coalesce("type", least).alias("type"),
        F.coalesce("n_rows", zero).alias("n_rows"), F.coalesce("n_gaps", zero).alias("n_gaps"),
        (F.coalesce(typed, F.lit(False)) | F.coalesce("_number", F.lit(True))).alias("is_numeric"), F.coalesce("n_distinct", zero).alias("n_distinct"), "low", "high")


ADDED = "x_auto_converted"


def load_files(spark: SparkSession, candidates: DataFrame, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, columns, report) of the candidate files under ``root``.

    The report is ``runfiles.resolve_loaded``'s. Rows and columns are those of
    the ``ok`` files of shown runs. A provenance file with a recorded query
    holds the query's rows (X6); any file from provenance has one more
    column, ``x_auto_converted`` = row_pos (X9), in place of one it has."""
    from fathom.operators.runfiles import resolve_loaded
    asked = candidates.withColumn("query", F.when(F.col("stage") == 1, F.coalesce("query", F.lit(""))).otherwise(F.lit("")))
    rows, columns, outcome = read_files(spark, root, asked)
    report = cut_lineage(resolve_loaded(asked, outcome))
    ok = broadcast_if_small(report.where("status = 'ok' AND shown").select("run_key", "stage", "label", "path", "query"))
    kept = F.expr(f"stage <> 1 OR column <> '{ADDED}'")
    shown = rows.join(ok, ["path", "query"]).select("run_key", "stage", "label", "row_pos", "ordinal", "column", "value").where(kept)
    profile = file_profile(rows, columns).join(ok, ["path", "query"]).where(kept)
    sizes = profile.where("stage = 1").groupBy("run_key", "label", "stage").agg((F.max("ordinal") + 1).alias("ordinal"), F.max("n_rows").alias("n_rows"))
    added = shown.where("stage = 1").groupBy("run_key", "label", "row_pos").agg((F.max("ordinal") + 1).alias("ordinal")).select(
        "run_key", "label", "row_pos", "ordinal", F.lit(ADDED).alias("column"), F.col("row_pos").cast("string").alias("value"))
    added_column = sizes.select("run_key", "stage", "label", "ordinal", F.lit(ADDED).alias("column"), F.lit("bigint").alias("type"), "n_rows",
                                F.lit(0).cast("long").alias("n_gaps"), F.lit(True).alias("is_numeric"), F.col("n_rows").alias("n_distinct"),
                                F.when(F.col("n_rows") > 0, F.lit(1.0)).alias("low"), F.when(F.col("n_rows") > 0, F.col("n_rows").cast("double")).alias("high"))
    every = profile.select(*added_column.columns).unionByName(added_column).withColumn("key", F.concat_ws(": ", "label", "column"))
    return shown.drop("stage").unionByName(added), every, report
