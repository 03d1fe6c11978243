"""Session helpers: one place for the settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators need for their results to be right.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Settings for throughput; a cluster may override all of them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 << 20,
               max_shuffle_partitions: int = 200_000) -> dict[str, str]:
    """Settings sized from the input volume, for a cluster session.

    Shuffle partitions start at about one per ``target_partition_bytes`` of
    input (AQE then coalesces small ones and splits skewed ones toward the
    same advisory size), and scan splits use the same target, so a task's
    data fits executor memory and spills stay rare. For 100 TB that is about
    400k, capped at ``max_shuffle_partitions``.
    """
    n = max(8, min(max_shuffle_partitions, -(-input_bytes // target_partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes * 4),
    }


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "fathom", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings above.

    Only for tests, the bench and local runs; on a cluster the caller's
    session is used as it is, see ``prepare``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {**DEFAULT_CONF, **REQUIRED_CONF,
            "spark.sql.shuffle.partitions": str(shuffle_partitions),
            "spark.driver.memory": os.environ.get("FATHOM_DRIVER_MEMORY", "16g")}
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to an existing session."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    Read from ``spark.checkpoint.dir``; a fresh folder is made only when the
    session names none (local runs and tests).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder every executor can reach")
        d = tempfile.mkdtemp(prefix="fathom-ckpt-")  # local runs only
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for files a job writes, in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# A table up to this many bytes of files may be dealt out anew.
SPREAD_MAX_BYTES = 1 << 30


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Read one table. ``spread``: when its files hold at most
    ``SPREAD_MAX_BYTES`` and the scan has fewer splits than the cluster has
    task slots (a small file, or one row group), deal its rows round-robin
    over the slots so the row-local work after it runs in parallel. A larger
    table is never shuffled for this."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SPREAD_MAX_BYTES:
        slots = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < slots:
            df = df.repartition(slots)
    return df
