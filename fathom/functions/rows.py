"""Row selection on computed columns without duplicated work.

``df.where(cond)`` is pushed by the optimizer below the projections that
compute ``cond``, with their expressions copied into the filter, so costly
array / JSON expressions run twice per row (once to filter, once to
project). Likewise a plain ``explode`` makes Spark infer a
``size(array) > 0`` filter that is pushed down the same way. Selecting
through ``explode_outer`` of a 0-or-1 element array keeps the condition
above the projection: a filter on a generator's output cannot move below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_where(df: DataFrame, cond: Column) -> DataFrame:
    """``df.where(cond)`` evaluated once per row on the projected columns."""
    cols = df.columns
    packed = df.select(F.explode_outer(F.when(cond, F.array(F.struct(*[F.col(f"`{c}`") for c in cols]))))
                       .alias("_r"))
    return packed.where(F.col("_r").isNotNull()).select(*[F.col("_r").getField(c).alias(c) for c in cols])


def explode_kept(df: DataFrame, keep: list[str], arr: Column, pos: str | None, value: str) -> DataFrame:
    """``posexplode`` / ``explode`` of a computed array without the inferred
    non-empty filter being pushed below the array's computation. Rows whose
    array is empty or null produce nothing, as with the plain form."""
    p = pos or "_pos"
    out = df.select(*keep, F.posexplode_outer(arr).alias(p, value)).where(F.col(p).isNotNull())
    return out if pos else out.drop(p)
