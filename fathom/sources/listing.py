"""Object listings and sidecar documents.

S3: a listing is file metadata only; ``binaryFile`` with the ``content``
column pruned never opens the files. S4: sidecars (one JSON document per
``*.fdo.json`` object) are read with an explicit schema, and the hidden
``_metadata`` columns give path, size and mtime from the same scan, so no
listing join is needed. Many small files are packed into tasks by
``spark.sql.files.maxPartitionBytes`` / ``openCostInBytes``, never looped
over in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.schemas import SIDECAR

SIDECAR_SUFFIX = ".fdo.json"


def relative_path(path_col, root: str):
    """Path under ``root``. Listing paths come back as URIs (``file:/...``,
    ``s3a://bucket/...``) while ``root`` may be given without a scheme, so
    the part after the first occurrence of the root's path is kept."""
    tail = root.split(":", 1)[-1].lstrip("/").rstrip("/") + "/"
    at = F.instr(path_col, tail)
    return F.when(at > 0, F.substring(path_col, at + len(tail), F.length(path_col))).otherwise(path_col)


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """S3: (path, mtime epoch seconds, size_bytes) of every object under ``root``."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
          .select("path", "modificationTime", "length"))
    return df.select(relative_path(F.col("path"), root).alias("path"),
                     F.unix_seconds(F.col("modificationTime")).alias("mtime"),
                     F.col("length").alias("size_bytes"))


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """One row per sidecar with its listing fields (path, mtime, size_bytes)."""
    df = (spark.read.schema(SIDECAR).option("multiLine", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", "*" + SIDECAR_SUFFIX).json(root))
    return df.select("*",
                     relative_path(F.col("_metadata.file_path"), root).alias("path"),
                     F.unix_seconds(F.col("_metadata.file_modification_time")).alias("mtime"),
                     F.col("_metadata.file_size").alias("size_bytes"))


def parse_sidecars(texts: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """S4 on sidecar text: (parsed rows, rejects). A text that is not one JSON
    object of the sidecar's shape is a reject with its other columns and the
    text (D2), not a row of nulls."""
    from fathom.schemas import SIDECAR
    schema = T.StructType(list(SIDECAR)).add("_corrupt", "string")
    parsed = texts.withColumn("_s", F.from_json(F.col(text_col), schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    ok = F.col("_s").isNotNull() & F.col("_s._corrupt").isNull() & F.trim(F.col(text_col)).startswith("{")
    rest = [c for c in texts.columns if c != text_col]
    good = parsed.where(F.coalesce(ok, F.lit(False)))
    return (good.select(*rest, *[F.col(f"_s.`{f.name}`") for f in SIDECAR]),
            parsed.where(~F.coalesce(ok, F.lit(False))).select(*rest, text_col))
