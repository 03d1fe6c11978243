"""Sinks (S8, S9): published catalogue tables and run payloads."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import catalog
from fathom.sources import sorted_table


def catalogue_tables(pkgs: DataFrame, base: str = catalog.DEFAULT_DOIP_BASE) -> dict[str, DataFrame]:
    """The four table builders over one package frame (rows still carry reasons)."""
    return {
        "raw_datasets": catalog.raw_datasets(pkgs),
        "processed_datasets": catalog.processed_datasets(pkgs, base),
        "models": catalog.models(pkgs, base),
        "model_runs": catalog.model_runs(pkgs, base),
    }


def publish_catalogue(pkgs: DataFrame, root: str, base: str = catalog.DEFAULT_DOIP_BASE,
                      mode: str = "overwrite", partition: dict[str, object] | None = None,
                      kinds: list[str] | None = None) -> None:
    """The published tables (valid rows, declared fields only; all four
    or only ``kinds``) and one rejects table (ord, kind, reason), written as
    Parquet under ``root/<table>``; valid + rejected = input per table. The
    packages are kept on the executors' disks meanwhile, so the feed is
    parsed once.

    Without ``partition`` a table is replaced whole, rejects of an earlier
    publication included. ``partition`` adds constant partition columns (e.g.
    a micro-batch id). Overwrites then replace only those partitions (dynamic
    overwrite), so a retried batch replaces its own output and leaves other
    batches alone."""
    root = root.rstrip("/")
    part = partition or {}
    cols = [F.lit(v).alias(k) for k, v in part.items()]

    def write(df: DataFrame, name: str, by: list[str]) -> None:
        (df.write.mode(mode).option("partitionOverwriteMode", "dynamic" if part else "static")
         .partitionBy(*by).parquet(f"{root}/{name}"))

    kept = pkgs.persist(StorageLevel.DISK_ONLY)
    try:
        for kind, rows in catalogue_tables(kept, base).items():
            if kinds is None or kind in kinds:
                ok, _ = catalog.split_rejects(rows)
                write(ok.select(*catalog.PUBLISHED[kind], *cols), kind, list(part))
        rejects = catalog.reject_reasons(kept)
        if kinds is not None:
            rejects = rejects.where(F.col("kind").isin(*kinds))
        write(rejects.select("ord", "kind", "reason", *cols), "rejects", [*part, "kind"])
    finally:
        kept.unpersist()


def write_feed_rejects(envelopes: DataFrame, root: str, batch_id: int) -> None:
    """Failed replies of one micro-batch (src, error), under its batch id."""
    from fathom.sources import feed
    (feed.feed_rejects(envelopes).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{root.rstrip('/')}/feed_rejects"))


def write_sidecar_table(sidecars: DataFrame, root: str, rows_per_file: int = sorted_table.ROWS_PER_FILE) -> None:
    """Sidecars sorted by their path, with a bloom filter on it, for point
    lookups by run id (L11). Paths begin with the shard, so neighbours in the
    store are neighbours in the files."""
    sorted_table.write_sorted(sidecars, root, ["path"], ("path",), rows_per_file)


def lookup_sidecars(spark: SparkSession, root: str, run_ids: list[str]) -> DataFrame:
    """L11 point form: the sidecars of the run ids of one request, in one read
    of the files that can hold them. An id of any form without a sidecar gives
    no row."""
    from fathom.operators.listing import sidecar_lookup_path
    if not run_ids:
        return sorted_table.rows_with(spark, root, "path", [])
    asked = spark.createDataFrame([(i,) for i in run_ids], "id string")
    paths = [r["path"] for r in asked.select(sidecar_lookup_path(F.col("id")).alias("path")).collect()]
    return sorted_table.rows_with(spark, root, "path", paths)
