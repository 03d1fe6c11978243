"""Sorted tables: Parquet files that hold consecutive ranges of a total order,
and a small index of them (one row per file).

``write_sorted`` deals the rows by ranges of the order and sorts each range, so
a file's rows are consecutive in the order and a row's position is the rows of
the files before it plus its index in the file. The index has the file's name,
its first position, its rows and the least and greatest value of the leading
column. Two reads need a few files only, however many there are:

- ``rows_between`` (B11, deep pages): the files whose positions meet the page;
- ``rows_with`` (L11, point lookups): the files whose range can hold a value;
  inside them row groups go by statistics, pages by the column index and
  absent values by bloom filters;
- ``rows_at``: the files that a table of places names.

A leading value with many rows spans several files, as the further columns of
the order split it. Nulls sort as Spark sorts them; ``rows_with`` finds values
that are not null. The order must be total (end it with a unique column), so a
task that is run again writes the same file. An empty table has no files and
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.operators.joins import broadcast_if_small
from fathom.session import cut_lineage

ROWS_PER_FILE = 1_000_000
POSITION = "_position"
RANGE, ROW = "_range", "_row"    # a row's place: the number of its file's range, and its index in the file


def _lead(order: list[str]) -> str:
    return order[0].split()[0]


def _keys(order: list[str]) -> list[Column]:
    return [F.col(f"`{o.split()[0]}`").desc() if o.endswith(" desc") else F.col(f"`{o.split()[0]}`").asc() for o in order]


def write_sorted(df: DataFrame, root: str, order: list[str], bloom: tuple[str, ...] = (), rows_per_file: int = ROWS_PER_FILE) -> None:
    """``df`` under ``root`` in the order of the columns ``order`` (``"name"``
    or ``"name desc"``), with bloom filters on the columns ``bloom``.

    The rows are stored once before they are dealt, since counting them and
    sampling the range borders read them again."""
    root, stored, spark = root.rstrip("/"), cut_lineage(df), df.sparkSession
    files = max(1, -(-stored.count() // rows_per_file))
    dealt = stored.repartitionByRange(files, *_keys(order)).sortWithinPartitions(*_keys(order)).withColumn(RANGE, F.spark_partition_id())
    out = dealt.write.option("maxRecordsPerFile", 0)    # one file a range
    for c in bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(rows_per_file))
    out.parquet(f"{root}/rows")
    spark.createDataFrame([], dealt.schema).coalesce(1).write.parquet(f"{root}/schema")
    lead = F.col(f"`{_lead(order)}`")
    index = located(spark, root).groupBy(RANGE, "_file").agg(F.count(F.lit(1)).alias("rows"), F.min(lead).alias("low"), F.max(lead).alias("high"))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)    # one row per file
    index = index.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    index.select(RANGE, F.col("_file").alias("file"), "first", "rows", "low", "high").coalesce(1).write.parquet(f"{root}/files")


def index_of(spark: SparkSession, root: str) -> DataFrame:
    """(_range, file, first, rows, low, high) of every file."""
    return spark.read.parquet(f"{root.rstrip('/')}/files")


def _read(spark: SparkSession, root: str, files: list[str] | None) -> DataFrame:
    root = root.rstrip("/")
    schema = spark.read.parquet(f"{root}/schema").schema    # one empty file, instead of listing all
    if files is not None and not files:
        return spark.read.parquet(f"{root}/schema").where("false")
    return spark.read.schema(schema).parquet(*([f"{root}/rows"] if files is None else [f"{root}/rows/{f}" for f in files]))


def located(spark: SparkSession, root: str, files: list[str] | None = None) -> DataFrame:
    """The rows (of ``files``, else all) with their places ``_range``, ``_row``
    and ``_file``."""
    rows = _read(spark, root, files)
    return rows.select("*", F.col("_metadata.row_index").alias(ROW), F.col("_metadata.file_name").alias("_file"))


def rows_between(spark: SparkSession, root: str, start: int, end: int) -> DataFrame:
    """Rows at the positions ``start`` <= position < ``end`` (from 0), with
    ``_position``. Only files that meet the span are read."""
    wanted = index_of(spark, root).where((F.col("first") < end) & (F.col("first") + F.col("rows") > start)).select(RANGE, "file", "first").collect()
    rows = located(spark, root, [r["file"] for r in wanted])
    first = F.coalesce(F.lit(None).cast("long"), *[F.when(F.col(RANGE) == r[RANGE], F.lit(r["first"])) for r in wanted])
    return rows.withColumn(POSITION, first + F.col(ROW)).where(F.col(POSITION).between(start, end - 1)).drop(RANGE, ROW, "_file")


def page_at(spark: SparkSession, root: str, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows in the table's order."""
    start = size * (max(1, number) - 1)
    return rows_between(spark, root, start, start + size).orderBy(POSITION).limit(size)


def rows_with(spark: SparkSession, root: str, column: str, values: list) -> DataFrame:
    """Rows whose leading order column ``column`` has one of ``values``. The
    values are those of a request; join a table of values instead."""
    values = sorted({v for v in values if v is not None})
    if not values:
        return _read(spark, root, []).drop(RANGE)
    near = F.exists(F.array(*[F.lit(v) for v in values]), lambda v: (F.col("low") <= v) & (F.col("high") >= v))
    files = [r["file"] for r in index_of(spark, root).where(near).select("file").collect()]
    return _read(spark, root, files).where(F.col(f"`{column}`").isin(values)).drop(RANGE)


def rows_at(spark: SparkSession, root: str, places: DataFrame) -> DataFrame:
    """Rows at ``places`` (_range, _row: distinct), with these columns. The
    driver sees the names of the files only."""
    kept = broadcast_if_small(places)
    files = [r["file"] for r in index_of(spark, root).join(kept, RANGE, "left_semi").select("file").collect()]
    return located(spark, root, files).drop("_file").join(kept, [RANGE, ROW], "left_semi")
