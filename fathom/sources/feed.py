"""Package feed (S1, S2): catalogue reply documents -> package rows.

A reply is ``{success, error, result: {results: [package]}}``. Replies are
read with an explicit schema (no inference pass), failed replies go to a
rejects table instead of failing the job, and each package keeps its feed
order as ``ord = (source file, position)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.schemas import FEED_ENVELOPE


def read_feed(spark: SparkSession, paths: str | list[str], multi_line: bool = True) -> DataFrame:
    """Raw envelopes with their source file (one JSON document per file by default)."""
    reader = spark.read.schema(FEED_ENVELOPE).option("multiLine", multi_line).option("mode", "PERMISSIVE")
    df = reader.json(paths)
    return df.select("*", F.col("_metadata.file_path").alias("src"))


def feed_rejects(envelopes: DataFrame) -> DataFrame:
    """Replies that failed (``success`` not true), with the error text."""
    return (envelopes.where(~F.coalesce(F.col("success"), F.lit(False)))
            .select("src", F.coalesce(F.col("error"), F.lit("unknown error")).alias("error")))


def packages(envelopes: DataFrame) -> DataFrame:
    """One row per package of every successful reply (posexplode keeps the order)."""
    ok = envelopes.where(F.coalesce(F.col("success"), F.lit(False)))
    ex = ok.select("src", F.posexplode_outer("result.results").alias("pos", "p")).where(F.col("p").isNotNull())
    return ex.select(F.struct(F.col("src"), F.col("pos").cast("long").alias("pos")).alias("ord"), "p.*")


def strict_packages(envelopes: DataFrame) -> DataFrame:
    """All-or-nothing mode: any failed reply raises, with its error."""
    bad = feed_rejects(envelopes).limit(1).collect()
    if bad:
        raise RuntimeError(f"catalogue reply failed: {bad[0]['error']}")
    return packages(envelopes)
