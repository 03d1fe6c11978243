"""Join helpers: broadcast only a side whose size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.session import cut_lineage

# The most rows, and bytes as JSON text, a side may have to be broadcast.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 32 << 20


def broadcast_if_small(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``small`` hinted for broadcast when it is within both bounds.

    It is computed once into the shared checkpoint folder first, so the
    measurement and the join read the stored rows instead of computing them
    twice. Beyond a bound it stays a shuffle join, whose skewed partitions
    AQE splits. A missing checkpoint folder is an error. Spark deletes the
    stored files when the session no longer refers to them
    (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    stored = cut_lineage(small)
    size = stored.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()
    return F.broadcast(stored) if size["n"] <= max_rows and (size["b"] or 0) <= max_bytes else stored
