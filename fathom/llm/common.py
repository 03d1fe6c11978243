"""Helpers shared by the operators: stored intermediate tables, word
splitting, dense positions and columns of record batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.session import checkpoint_dir

# The word classes of the operators' contracts, over UTF-8 bytes.
# Bytes from 0x80 up are word bytes in both, so matching bytes and matching
# characters give the same words.
ALNUM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ROW_ID = "_row_id"


def alnum_words(text: str | None) -> list[bytes]:
    """Words of ``text`` with A-Z lower-cased (``bytes.lower`` is ASCII-only)."""
    return ALNUM_WORD.findall(text.encode().lower()) if text else []


def space_words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space (0x09-0x0D, 0x20), A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts lineage: a lost executor recomputes from the written files, and
    values that are only fixed once written (row ids) stay the same. The
    folder is the cluster's ``spark.checkpoint.dir``; ``clear_scratch``
    removes what a session has stored."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own for one stored table."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession) -> str:
    """This application's folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table this application stored (results read from them
    must have been written elsewhere before)."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def aside(df: DataFrame, taken: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns of the names in ``taken`` (space-separated)
    renamed out of the way, and the function that gives them back."""
    names = {c.lower() for c in [*df.columns, *taken.split()]}
    moved = {}
    for c in df.columns:
        if c.lower() in taken.lower().split():
            new = f"_aside_{c}"
            while new.lower() in names:
                new = f"_{new}"
            names.add(new.lower())
            moved[c] = new
    return df.withColumnsRenamed(moved), lambda out: out.withColumnsRenamed({new: c for c, new in moved.items()})


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored with a unique long ``_row_id``: rows that repeat in every
    column, null ids included, stay separate rows."""
    return store(df.withColumn(ROW_ID, F.monotonically_increasing_id()), name)


# Dense positions: rows one window partition takes, and the most buckets of a
# group (their counts are summed in one window partition).
BUCKET_ROWS = 400
MAX_BUCKETS = 20_000


def dense_positions(df: DataFrame, group: str, counts: dict[int, int], out: str) -> DataFrame:
    """Add ``out`` = 0, 1, 2, ... within each value of the integer column
    ``group``, in no particular but fixed order of ``_row_id``.

    ``counts`` holds the rows of every group (groups are few: shards or
    lengths). A group is cut by a hash of ``_row_id`` into buckets of about
    ``BUCKET_ROWS`` rows, so a group with a third of all rows is spread over
    the cluster; rows are numbered inside their bucket and shifted by the
    rows of the buckets before it."""
    spark = df.sparkSession
    if not counts:
        return df.withColumn(out, F.lit(0).cast("long"))
    sizes = F.broadcast(spark.createDataFrame(
        [(int(g), max(1, min(MAX_BUCKETS, -(-n // BUCKET_ROWS)))) for g, n in counts.items()],
        f"{group} int, _buckets int"))
    cut = df.join(sizes, group).withColumn("_b", F.pmod(F.xxhash64(ROW_ID), F.col("_buckets")).cast("int")).drop("_buckets")
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = (cut.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy(group, "_b").orderBy(ROW_ID)
    return (cut.withColumn("_inside", F.row_number().over(inside) - 1).join(shift, [group, "_b"])
            .withColumn(out, (F.col("_inside") + F.col("_shift")).cast("long")).drop("_b", "_inside", "_shift"))


def pylist(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def add_columns(batch: pa.RecordBatch, schema: pa.Schema, new: dict[str, list]) -> pa.RecordBatch:
    """``batch`` with further columns, by position in ``schema``."""
    cols = [pa.array(new[f.name], f.type) if f.name in new else batch.column(batch.schema.get_field_index(f.name))
            for f in schema]
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def chunks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int, max_rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of the record batches with at most ``max_rows`` rows and, unless
    one row alone is larger, about ``max_bytes`` bytes in ``column``."""
    import pyarrow.compute as pc

    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not len(col):
            continue
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
