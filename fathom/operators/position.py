"""Dense row positions 1..n per group without a one-partition window.

A plain ``row_number() OVER (PARTITION BY g ORDER BY k)`` sends each group to
one task, so a group holding a third of the rows becomes one task holding a
third of the data. Here the rows are first cut into ordered buckets by value
ranges of the leading order column (cut points from ``approx_percentile``,
one small driver action), numbered inside each (group, bucket), and shifted
by the row count of the earlier buckets of the same group. The count table
has (groups x buckets) rows, whatever the data size. Exact: the bucket is a
non-decreasing function of the leading order key, so bucket order followed
by the in-bucket order equals the full order. Deterministic on recompute.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _numeric_key(df: DataFrame, col: str) -> Column:
    """A numeric, order-preserving form of ``col`` for ``approx_percentile``."""
    dt = df.schema[col].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp"))
    if isinstance(dt, T.DateType):
        return F.unix_date(F.col(col)).cast("long")
    if isinstance(dt, T.NumericType):
        return F.col(col).cast("double")
    raise TypeError(f"leading order column {col} must be numeric or temporal, got {dt}")


def _order_key(df: DataFrame, col: str, desc: bool) -> Column:
    """A double that is non-decreasing along the sort order of ``col``.

    Ascending as is (nulls first, NaN last, as Spark sorts). Descending
    negated, with NaN (first in a descending sort) mapped to -inf; nulls
    (last in a descending sort) are placed by ``_bucketize``. Ties are fine:
    a bucket only has to be non-decreasing along the order."""
    k = _numeric_key(df, col).cast("double")
    k = F.when(k == 0, F.lit(0.0)).otherwise(k)   # -0.0 sorts equal to 0.0 in Spark, not in a binary search
    return F.when(F.isnan(k), F.lit(float("-inf"))).otherwise(-k) if desc else k


# The most rows one window partition may take (larger groups
# are split into ordered buckets of about this size), bucket count cap, and
# sample size per bucket for the cut points.
WINDOW_GROUP_MAX_ROWS = 2_000_000
MAX_BUCKETS = 65536
SAMPLE_PER_BUCKET = 100
_SEED = 17


def _bucketize(df: DataFrame, in_col: str, cuts: list, out_col: str, nulls_last: bool = False) -> DataFrame:
    """``out_col`` = number of distinct cut points <= ``in_col``; null -> 0,
    or after every other bucket with ``nulls_last``.

    ``Bucketizer`` does a binary search in the JVM, so a row costs
    O(log cuts) however many buckets there are; NaN lands in a last bucket of
    its own, after every number, as NaN sorts last."""
    from pyspark.ml.feature import Bucketizer
    splits = [float("-inf"), *sorted(set(_finite(cuts))), float("inf")]
    b = Bucketizer(splits=splits, inputCol=in_col, outputCol=out_col, handleInvalid="keep")
    null_bucket = F.lit(len(splits) if nulls_last else 0)
    return b.transform(df).withColumn(out_col, F.coalesce(F.col(out_col).cast("int"), null_bucket))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` where null matches null (as a window's
    PARTITION BY groups nulls together); the right key columns are dropped."""
    r = right.select(*[F.col(k).alias(f"_rk_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_rk_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_rk_{k}" for k in keys])


def _finite(cuts: list) -> list[float]:
    """Finite cut points only. NaN and infinite keys still get a bucket that
    keeps the order (NaN after all numbers, -inf first, +inf last) but are
    never split points, nor hot values."""
    return [float(c) for c in cuts if c is not None and math.isfinite(c)]


def _cut_points(sample: DataFrame, col: str, n_buckets: int) -> list:
    probs = [i / n_buckets for i in range(1, n_buckets)]
    accuracy = max(10000, 10 * n_buckets)
    return sample.agg(F.approx_percentile(col, probs, accuracy).alias("c")).first()["c"] or []


def group_sizes(df: DataFrame, group_cols: list[str]) -> tuple[int, int]:
    """(rows, rows of the largest group) in one small job: counted per group
    with partial aggregation, so a hot group is one row per task."""
    r = df.groupBy(*group_cols).count().agg(F.sum("count").alias("n"), F.max("count").alias("m")).first()
    return int(r["n"] or 0), int(r["m"] or 0)


def groups_fit(df: DataFrame, group_cols: list[str], max_rows: int | None = None) -> tuple[bool, tuple[int, int]]:
    """(every group fits one window partition, the measured ``group_sizes``)."""
    limit = WINDOW_GROUP_MAX_ROWS if max_rows is None else max_rows
    sizes = group_sizes(df, group_cols)
    return sizes[1] <= limit, sizes


def dense_position(df: DataFrame, group_cols: list[str], order_cols: list[str],
                   out_col: str = "row_pos", n_buckets: int | None = None,
                   descending: frozenset[str] | set[str] = frozenset(),
                   total_col: str | None = None, max_group_rows: int | None = None,
                   sizes: tuple[int, int] | None = None) -> DataFrame:
    """Add ``out_col`` = 1..n within each group in ``order_cols`` order, i.e.
    ``row_number() OVER (PARTITION BY group_cols ORDER BY order_cols)``.

    ``order_cols`` must make the order total (end with a unique key). Columns
    named in ``descending`` sort descending; nulls sort as Spark's defaults
    (first ascending, last descending). A null group is a group.
    ``total_col`` also adds the group's row count (from the small count
    table, with no further join).

    One small job first measures the largest group. When it fits one window
    partition (``max_group_rows``, default ``WINDOW_GROUP_MAX_ROWS``) the
    plain window is used; the numbers are the same either way. ``sizes``
    passes a measurement already made on ``df`` (``group_sizes``).

    Buckets are ranges of the leading order key, cut at percentiles of a
    seeded sample of about ``SAMPLE_PER_BUCKET`` rows per bucket (a row count
    sizes the sample, so the percentile sketches stay small however large
    the input is). A single leading value that holds more than one bucket's
    share of rows shows up as a repeated cut point; those hot rows are split
    further into sub-buckets by cut points of the second order key over the
    sampled hot rows. Rows are numbered per (group, bucket, sub-bucket) and
    shifted by the counts of the earlier (bucket, sub-bucket) pairs of their
    group, which is exact because the pair is non-decreasing in the full
    order: the cut points only decide how even the buckets are, never the
    numbers. A leading key that is neither a number nor a time (text, for
    one) takes ``_range_position`` instead, with the same numbers.
    """
    desc = [c in descending for c in order_cols]
    order = [F.col(c).desc() if d else F.col(c).asc() for c, d in zip(order_cols, desc)]
    n, largest = sizes if sizes is not None else group_sizes(df, group_cols)
    if largest <= (WINDOW_GROUP_MAX_ROWS if max_group_rows is None else max_group_rows):
        out = df.withColumn(out_col, F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order)).cast("long"))
        if total_col:
            out = out.withColumn(total_col, F.count(F.lit(1)).over(Window.partitionBy(*group_cols)))
        return out
    if not isinstance(df.schema[order_cols[0]].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return _range_position(df, group_cols, order, out_col, total_col)
    if n_buckets is None:
        # enough buckets for the largest group to come out near the bound,
        # and at least one per shuffle partition
        n_buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")),
                        -(-largest // WINDOW_GROUP_MAX_ROWS))
    n_buckets = min(max(2, n_buckets), MAX_BUCKETS)
    staged = df.withColumn("_key", _order_key(df, order_cols[0], desc[0]))
    split_second = len(order_cols) > 1 and isinstance(
        df.schema[order_cols[1]].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
    if split_second:
        staged = staged.withColumn("_key2", _order_key(df, order_cols[1], desc[1]))
    fraction = min(1.0, SAMPLE_PER_BUCKET * n_buckets / max(n, 1))
    sample = staged if fraction >= 1.0 else staged.sample(fraction=fraction, seed=_SEED)
    cuts = _cut_points(sample, "_key", n_buckets)
    repeats = {c: k for c, k in Counter(_finite(cuts)).items() if k > 1}
    hot = sorted(repeats)
    staged = _bucketize(staged, "_key", cuts, "_b", nulls_last=desc[0])
    if hot and split_second:
        # A hot value is the lower cut of its bucket, so its rows come first
        # there, in second-key order; every other row of that bucket follows.
        # Sub-buckets come from second-key cut points over all sampled hot
        # rows, folded to as many as the value's repeated cut points (its
        # share in buckets): the count table stays about n_buckets rows per
        # group however many values are hot. The hot table has at most
        # n_buckets / 2 rows, so broadcasting it is bounded.
        sub_cuts = _cut_points(sample.where(F.col("_key").isin(*hot)), "_key2", n_buckets)
        width = len(set(_finite(sub_cuts))) + 3   # Bucketizer values 0..n+1, nulls n+2
        staged = _bucketize(staged, "_key2", sub_cuts, "_sb2", nulls_last=desc[1])
        need = df.sparkSession.createDataFrame([(float(v), int(k)) for v, k in repeats.items()],
                                               "_hv double, _need int")
        staged = staged.join(F.broadcast(need), F.col("_key") == F.col("_hv"), "left")
        staged = staged.withColumn("_sb", F.when(F.col("_need").isNotNull(),
                                                 F.floor(F.col("_sb2") * F.col("_need") / F.lit(width)))
                                   .otherwise(F.lit(n_buckets + 1)).cast("int")).drop("_sb2", "_hv", "_need")
    else:
        staged = staged.withColumn("_sb", F.lit(0))
    local = Window.partitionBy(*group_cols, "_b", "_sb").orderBy(*order)
    numbered = staged.withColumn("_r", F.row_number().over(local))
    counts = staged.groupBy(*group_cols, "_b", "_sb").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_b", "_sb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total_col:
        offsets = offsets.withColumn(total_col, F.sum("_n").over(Window.partitionBy(*group_cols)))
    offsets = offsets.drop("_n")
    return (join_null_safe(numbered, offsets, [*group_cols, "_b", "_sb"])
            .withColumn(out_col, (F.col("_off") + F.col("_r")).cast("long"))
            .drop("_key", "_key2", "_b", "_sb", "_r", "_off"))


def _range_position(df: DataFrame, group_cols: list[str], order: list[Column], out_col: str, total_col: str | None) -> DataFrame:
    """``dense_position`` for any sortable key: the rows are range-partitioned
    by (group, order), which splits a hot group and a hot leading value alike,
    and stored with their partition number. Rows are numbered inside (group,
    partition) and shifted by the rows of the group's earlier partitions: at
    most partitions + groups counts."""
    from fathom.session import cut_lineage
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))
    placed = cut_lineage(df.repartitionByRange(n, *[F.col(g) for g in group_cols], *order).withColumn("_b", F.spark_partition_id()))
    numbered = placed.withColumn("_r", F.row_number().over(Window.partitionBy(*group_cols, "_b").orderBy(*order)))
    before = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    if total_col:
        offsets = offsets.withColumn(total_col, F.sum("_n").over(Window.partitionBy(*group_cols)))
    return (join_null_safe(numbered, offsets.drop("_n"), [*group_cols, "_b"])
            .withColumn(out_col, (F.col("_off") + F.col("_r")).cast("long")).drop("_b", "_r", "_off"))


def file_row_numbers(df: DataFrame, out_col: str = "row_num") -> DataFrame:
    """X9 for file scans: 1..n in file order across all files of ``df``.

    Per-file row counts (one row per file) give each file's offset; the row
    index inside the file comes from the Parquet reader. No window over the
    rows and no shuffle of them.
    """
    staged = df.select("*", F.col("_metadata.file_path").alias("_f"),
                       F.col("_metadata.row_index").alias("_i"))
    per_file = staged.groupBy("_f").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_file.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    # one row per file, broadcast after a size check: the rows are not
    # shuffled by file (one file may hold a third of them)
    from fathom.operators.joins import broadcast_if_small
    return (staged.join(broadcast_if_small(offsets), "_f")
            .withColumn(out_col, (F.col("_off") + F.col("_i") + 1).cast("long"))
            .drop("_f", "_i", "_off"))
