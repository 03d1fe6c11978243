"""Ranking, neighbour, moving-frame and ordered-pair results per group
without sending a whole group to one task.

``rank() / lag() / SUM() OVER (PARTITION BY g ...)`` puts every row of a
group in one window partition, and a self-join on ``g`` with an order
predicate emits every pair of a group. Here row positions come from
``position.dense_position`` (ordered buckets, so a hot group spreads over
many tasks), and everything else is an equi-join or aggregate on
(group, position) keys, which are unique per row and hash evenly. Rank is
the exception: it joins each row to its value's first position on
(group, value), where a much-repeated value is a skewed key that AQE's
skew-join handling splits (the other side has one row per key).

Each function first measures the largest group in one small job
(``position.groups_fit``). When every group fits one window partition the
plain window or aggregate is used; beyond that the bucketed plan. Both give
the same result; ``max_group_rows`` overrides the bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators.position import dense_position, groups_fit, join_null_safe


def ranks(df: DataFrame, group: str, order: str, tiebreak: str, descending: bool = True,
          max_group_rows: int | None = None) -> DataFrame:
    """Adds ``rn`` (row_number by order, tiebreak), ``rnk`` (rank) and ``drnk``
    (dense_rank) by ``order`` within ``group``."""
    o = F.col(order).desc() if descending else F.col(order).asc()
    fit, sizes = groups_fit(df, [group], max_group_rows)
    if fit:
        w = Window.partitionBy(group).orderBy(o)
        return df.select("*", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("drnk"),
                         F.row_number().over(Window.partitionBy(group).orderBy(o, F.col(tiebreak))).cast("long")
                         .alias("rn"))
    desc = {order} if descending else set()
    numbered = dense_position(df, [group], [order, tiebreak], out_col="rn", descending=desc, max_group_rows=0,
                              sizes=sizes)
    # rank = first position of the value; dense rank = position of the value
    # among the group's distinct values (partially aggregated to one row per
    # (group, value) before any shuffle, and numbered from the input itself)
    firsts = numbered.groupBy(group, order).agg(F.min("rn").alias("rnk"))
    by_value = dense_position(df.select(group, order).distinct(), [group], [order], out_col="drnk", descending=desc,
                              max_group_rows=max_group_rows)
    return join_null_safe(join_null_safe(numbered, firsts, [group, order]), by_value, [group, order])


def neighbours(df: DataFrame, group: str, order_cols: list[str], value: str,
               max_group_rows: int | None = None) -> DataFrame:
    """Adds ``prev_value`` / ``next_value``: ``value`` of the row before and
    after in ``order_cols`` order within ``group`` (lag / lead)."""
    fit, sizes = groups_fit(df, [group], max_group_rows)
    if fit:
        w = Window.partitionBy(group).orderBy(*order_cols)
        return df.select("*", F.lag(value).over(w).alias("prev_value"), F.lead(value).over(w).alias("next_value"))
    numbered = dense_position(df, [group], order_cols, out_col="_p", max_group_rows=0, sizes=sizes)
    prev = numbered.select(group, (F.col("_p") + 1).alias("_p"), F.col(value).alias("prev_value"))
    nxt = numbered.select(group, (F.col("_p") - 1).alias("_p"), F.col(value).alias("next_value"))
    out = join_null_safe(join_null_safe(numbered, prev, [group, "_p"]), nxt, [group, "_p"])
    return out.drop("_p")


def rows_frame_sum(df: DataFrame, group: str, order_cols: list[str], value: str, preceding: int,
                   out_col: str = "frame_sum", max_group_rows: int | None = None) -> DataFrame:
    """Adds ``out_col`` = SUM(value) OVER (PARTITION BY group ORDER BY
    order_cols ROWS BETWEEN ``preceding`` PRECEDING AND CURRENT ROW).

    Each row adds its value to its own position and the next ``preceding``
    ones; a partial aggregate per (group, position) sums them."""
    fit, sizes = groups_fit(df, [group], max_group_rows)
    if fit:
        w = Window.partitionBy(group).orderBy(*order_cols).rowsBetween(-preceding, 0)
        return df.select("*", F.sum(value).over(w).alias(out_col))
    numbered = dense_position(df, [group], order_cols, out_col="_p", max_group_rows=0, sizes=sizes)
    shifts = F.array(*[F.col("_p") + i for i in range(preceding + 1)])
    sums = (numbered.select(group, F.explode(shifts).alias("_p"), value)
            .groupBy(group, "_p").agg(F.sum(value).alias(out_col)))
    return join_null_safe(numbered, sums, [group, "_p"]).drop("_p")


def count_earlier_pairs(df: DataFrame, keys: list[str], ts: str, tiebreak: str,
                        is_left, is_right, max_group_rows: int | None = None) -> DataFrame:
    """Per ``keys[0]``: the number of (left row, right row) pairs with equal
    ``keys`` and ``right.ts > left.ts``, i.e. the count of

        df l JOIN df r ON l.k = r.k (all keys) AND r.ts > l.ts
        WHERE is_left(l) AND is_right(r) GROUP BY l.keys[0]

    without emitting the pairs (no row may be both kinds). In the order (ts,
    right before left at equal ts, tiebreak) the left rows before a right row
    are exactly those with a smaller ts: the right row's position among both
    kinds minus its position among right rows. Summed over the m right rows
    of a key group, the second term is 1 + ... + m. Only first keys with at
    least one pair are returned, as the inner join gives. Rows with a null
    key or ts never pair. ``tiebreak`` is numeric and unique."""
    rows = (df.where(F.col(ts).isNotNull() & F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys)))
            .select(*keys, ts, tiebreak,
                    F.when(is_right, F.lit(0)).when(is_left, F.lit(1)).alias("_kind"))
            .where(F.col("_kind").isNotNull()))
    fit, sizes = groups_fit(rows, keys, max_group_rows)
    if fit:
        # left rows before each right row: a running count in the same order
        w = (Window.partitionBy(*keys).orderBy(ts, "_kind", tiebreak)
             .rowsBetween(Window.unboundedPreceding, -1))
        before = rows.select(*keys, "_kind", F.sum("_kind").over(w).alias("_earlier"))
        return (before.where(F.col("_kind") == 0).groupBy(keys[0])
                .agg(F.sum("_earlier").cast("long").alias("n")).where(F.col("n") > 0))
    # (kind, tiebreak) as one number that never decreases along that order
    # (ties only where doubles round), so a hot ts value is split by the
    # tiebreak rather than by two kinds; the tiebreak stays the last key
    k2 = F.col("_kind") * F.lit(4e19) + F.col(tiebreak).cast("double")
    both = dense_position(rows.withColumn("_k2", k2), keys, [ts, "_k2", tiebreak], out_col="_pa",
                          max_group_rows=0, sizes=sizes)
    # exact in decimal: sums of positions of a hot group outgrow a long
    per_key = (both.where(F.col("_kind") == 0).groupBy(*keys)
               .agg(F.sum(F.col("_pa").cast("decimal(38,0)")).alias("_s"),
                    F.count(F.lit(1)).cast("decimal(38,0)").alias("_m"))
               .select(keys[0], (F.col("_s") - F.col("_m") * (F.col("_m") + 1) / 2).alias("_earlier")))
    return (per_key.groupBy(keys[0]).agg(F.sum("_earlier").cast("long").alias("n"))
            .where(F.col("n") > 0))


def exact_median(df: DataFrame, group: str, value: str, tiebreak: str, out_col: str = "median",
                 max_group_rows: int | None = None) -> DataFrame:
    """Per ``group``: the exact median of non-null ``value`` as Spark's
    ``median`` gives it (the middle value, or the lower middle plus half the
    gap to the upper one), without gathering a group's values in one task:
    only the one or two middle rows of each group are kept from the dense
    positions, whose count table also gives the group size."""
    rows = df.where(F.col(value).isNotNull()).select(group, value, tiebreak)
    fit, sizes = groups_fit(rows, [group], max_group_rows)
    if fit:
        return rows.groupBy(group).agg(F.median(value).alias(out_col))
    numbered = dense_position(rows, [group], [value, tiebreak], out_col="_p", total_col="_tot", max_group_rows=0,
                              sizes=sizes)
    middle = numbered.where((F.col("_p") == F.floor((F.col("_tot") + 1) / 2)) | (F.col("_p") == F.floor(F.col("_tot") / 2) + 1))
    mid = middle.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    half = F.when(F.col("_lo") == F.col("_hi"), F.lit(0.0)).otherwise(F.lit(0.5))
    return mid.select(group, (F.col("_lo") + half * (F.col("_hi") - F.col("_lo"))).alias(out_col))


def collect_bounded(df: DataFrame, key: str, value: str, order_cols: list[str], out_col: str = "items",
                    max_len: int | None = None) -> DataFrame:
    """Non-null ``value`` per ``key`` in arrays of at most ``max_len``
    elements: columns (key, chunk, ``out_col``), one row per key and run of
    ``max_len`` consecutive positions in ``order_cols`` order, numbered from
    0. No array holds a hot key's rows, and a key with null values only has
    no row. The elements of one array have no fixed order."""
    from fathom.operators.position import WINDOW_GROUP_MAX_ROWS
    limit = WINDOW_GROUP_MAX_ROWS if max_len is None else max_len
    rows = df.where(F.col(value).isNotNull())
    fit, sizes = groups_fit(rows, [key], limit)
    if fit:     # every key is one chunk
        return rows.groupBy(key).agg(F.collect_list(value).alias(out_col)).select(key, F.lit(0).cast("long").alias("chunk"), out_col)
    numbered = dense_position(rows, [key], order_cols, out_col="_p", max_group_rows=0, sizes=sizes)
    return (numbered.groupBy(key, F.floor((F.col("_p") - 1) / limit).alias("chunk"))
            .agg(F.collect_list(value).alias(out_col)))
