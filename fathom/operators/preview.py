"""Dataset SQL and previews: a file registered as view ``df``, user SQL on it,
count + ordered first-n preview, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
VIEW_NAME = "df"
DEFAULT_LIMIT = 500
DEFAULT_QUERY = f"SELECT * FROM {VIEW_NAME} LIMIT {DEFAULT_LIMIT}"


def register_dataset(spark: SparkSession, path: str, fmt: str = "parquet", view: str = VIEW_NAME) -> DataFrame:
    """Register one dataset file as view ``df``.

    Parquet keeps its schema. CSV / TSV (separator from the extension) are
    read with a header and an inferred schema, as a preview does.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt in ("csv", "tsv"):
        df = (spark.read.option("header", True).option("inferSchema", True)
              .option("sep", "\t" if fmt == "tsv" else ",").csv(path))
    else:
        raise ValueError(f"unsupported dataset format: {fmt}")
    df.createOrReplaceTempView(view)
    return df


# Settings copied from the caller's session into an isolated one.
_CARRY = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes",
          "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.enabled",
          "spark.sql.autoBroadcastJoinThreshold")


def isolated(spark: SparkSession) -> SparkSession:
    """A session of its own (shared SparkContext and cache, separate temp views),
    so concurrent previews can each register their dataset as ``df``."""
    from fathom.session import prepare
    s = spark.newSession()
    for k in _CARRY:
        v = spark.conf.get(k, None)
        if v is not None:
            s.conf.set(k, v)
    return prepare(s)


def query_dataset(spark: SparkSession, path: str, sql: str | None, fmt: str = "parquet") -> DataFrame:
    """S5 + P1 in an isolated session: ``path`` registered as ``df``, then the
    user SQL. Blank SQL is the default preview: the file's first rows in file
    order."""
    s = isolated(spark)
    df = register_dataset(s, path, fmt)
    return run_sql(s, sql) if (sql or "").strip() else file_order_head(df, DEFAULT_LIMIT)


def wrap_user_sql(sql: str | None) -> str:
    """One trailing ``;`` is dropped; the text is wrapped as a
    subquery, so CTEs and inner ORDER BY work while DDL or a second statement
    fail to parse. Blank text is the default query, whose rows have no order:
    where the file is known, ``query_dataset`` gives them in file order."""
    q = (sql or "").strip()
    if not q:
        return DEFAULT_QUERY
    if q.endswith(";"):
        q = q[:-1].rstrip()
    return f"SELECT * FROM (\n{q}\n) q"


def run_sql(spark: SparkSession, sql: str | None) -> DataFrame:
    """User SQL over the registered view."""
    return spark.sql(wrap_user_sql(sql))


def file_order_head(df: DataFrame, n: int = DEFAULT_LIMIT) -> DataFrame:
    """First ``n`` rows of a file scan in file order (TakeOrdered: per-task
    top-n, then a merge of n rows per task; no full sort, no shuffle).

    Parquet gives each row's index in its file. Text sources (CSV / TSV) do
    not, so their key is (file, split start, id in read order): rows of one
    split are read in file order, and the split start orders the splits of a
    file."""
    meta = [f.name for f in df.select("_metadata").schema.fields[0].dataType.fields]
    if "row_index" in meta:
        keyed = df.select("*", F.col("_metadata.file_path").alias("_f"),
                          F.lit(0).cast("long").alias("_s"), F.col("_metadata.row_index").alias("_i"))
    else:
        keyed = df.select("*", F.col("_metadata.file_path").alias("_f"),
                          F.col("_metadata.file_block_start").alias("_s"),
                          F.monotonically_increasing_id().alias("_i"))
    return keyed.orderBy("_f", "_s", "_i").limit(n).drop("_f", "_s", "_i")


def count_and_head(result: DataFrame, n: int = DEFAULT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """The total row count and the first ``n`` rows of the same plan.

    The count runs as its own aggregate (Parquet answers an empty-schema scan
    from footers), the head as a limit; nothing else reaches the driver.
    """
    total = result.agg(F.count(F.lit(1)).alias("total_rows"))
    return total, result.limit(n)


def row_label(shown: Column, total: Column) -> Column:
    """``n rows`` / ``shown of total rows`` with thousands separators."""
    fmt = lambda c: F.format_number(c.cast("long"), 0)
    return (F.when(total.isNull(), F.concat(fmt(shown), F.lit(" rows")))
            .when(total > shown, F.concat(fmt(shown), F.lit(" of "), fmt(total), F.lit(" rows")))
            .otherwise(F.concat(fmt(total), F.lit(" rows"))))


def shape_label(label: Column, n_cols: int) -> Column:
    """P5: ``<rows label> × <columns> columns``."""
    return F.concat(label, F.lit(f" × {n_cols} columns"))


def null_text(dt: T.DataType) -> str:
    """A null's text by type."""
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "nan"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "NaT"
    return "None"


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text; nulls by type (numbers ``nan``, temporals
    ``NaT``, others ``None``), integers stay integers."""
    return df.select(*[F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit(null_text(f.dataType))).alias(f.name)
                       for f in df.schema.fields])
