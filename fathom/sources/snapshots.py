"""Atomic publication of the catalogue tables.

Every publication writes a snapshot folder of its own; readers follow a
pointer that is made last. A pointer is one empty file named by a rising
number and the snapshot, created without overwriting, so it is either there
or not, on any store, and the highest is the current one. A writer that dies
midway leaves a folder nobody points at, and readers stay on the tables they
have. ``retire`` keeps the newest snapshots, and removes older ones and the
folders of dead writers.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from fathom.operators import catalog
from fathom.sources import sinks

KEEP = 3
DEAD_AFTER_SECONDS = 24 * 3600


class Folder:
    """File operations below ``root`` through the session's file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        sc = spark.sparkContext
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(sc._jsc.hadoopConfiguration())

    def names(self, sub: str) -> list[str]:
        at = self._path(f"{self.root}/{sub}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def create(self, name: str) -> None:
        self._fs.create(self._path(f"{self.root}/{name}"), False).close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


def versions(spark: SparkSession, root: str) -> list[str]:
    """Published snapshots, oldest first."""
    return [n.split("__", 1)[1] for n in Folder(spark, root).names("pointers") if "__" in n]


def publish_snapshot(pkgs: DataFrame, root: str, base: str = catalog.DEFAULT_DOIP_BASE, keep: int = KEEP) -> str:
    """All published tables and the rejects of ``pkgs`` as the current
    snapshot under ``root``; returns its name."""
    spark = pkgs.sparkSession
    folder, name = Folder(spark, root), f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:12]}"
    sinks.publish_catalogue(pkgs, f"{folder.root}/snapshots/{name}", base, mode="errorifexists")
    before = folder.names("pointers")
    number = int(before[-1].split("__", 1)[0]) + 1 if before else 1
    folder.create(f"pointers/{number:020d}__{name}")
    retire(spark, root, keep)
    return name


def read_snapshot(spark: SparkSession, root: str, table: str, version: str | None = None) -> DataFrame:
    """``table`` of the current snapshot, or of a published ``version``."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        raise LookupError(f"no such snapshot under {root}: {version or 'none is published'}")
    return spark.read.parquet(f"{root.rstrip('/')}/snapshots/{version or known[-1]}/{table}")


def retire(spark: SparkSession, root: str, keep: int = KEEP, dead_after: float = DEAD_AFTER_SECONDS) -> list[str]:
    """Removes all but the ``keep`` newest snapshots (pointer first, so nobody
    is sent to a folder that is going), and unpublished folders that were
    begun more than ``dead_after`` seconds ago. Returns what was removed."""
    folder = Folder(spark, root)
    pointers = folder.names("pointers")
    old = pointers[:-max(1, keep)]
    for p in old:
        folder.delete(f"pointers/{p}")
    kept = {p.split("__", 1)[1] for p in pointers if p not in old}
    retired = {p.split("__", 1)[1] for p in old}
    gone = [n for n in folder.names("snapshots") if n not in kept and (n in retired or int(n.split("-", 1)[0]) < (time.time() - dead_after) * 1000)]
    for n in gone:
        folder.delete(f"snapshots/{n}")
    return gone
