"""Incremental upkeep of the catalogue tables: the last version of a package wins.

Every micro-batch adds its packages, reduced to the last one per key, as one
``changes/batch_id=N`` folder of each table; a batch that is run again replaces
its folder. ``current`` is one partial aggregation over the newest base and
the changes after it, so a package sent twice shows once, with its last fields,
and names resolved from it (R3) follow. ``compact`` writes the current rows as
a new base and makes its pointer last, so readers always have one whole base;
``retire`` removes what no reader needs.

The key is the qid (raw datasets: the path). Of two packages with one key the
one of the later batch wins; in a batch, the later in feed order (file, place).
A package with a blank key is known by its file and place. A package that is
rejected when sent again leaves its last valid version. Hot keys are reduced
before the shuffle. The tables keep all columns and ``ord``.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathom.operators import catalog
from fathom.session import checkpoint_dir
from fathom.sources import feed, sinks
from fathom.sources.snapshots import Folder
from fathom.streaming.catalogue_stream import stream_envelopes

KINDS = ("raw_datasets", "processed_datasets", "models", "model_runs")


def _key(kind: str):
    own = F.col("path" if kind == "raw_datasets" else "qid")
    place = F.concat(F.lit("\0"), F.col("ord.src"), F.lit("\0"), F.col("ord.pos").cast("string"))
    return F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(place)


def _last(rows: DataFrame) -> DataFrame:
    """The last of the rows (_key, _batch, _row) per key."""
    when = F.struct("_batch", "_row.ord")
    return rows.groupBy("_key").agg(F.max("_batch").alias("_batch"), F.max_by("_row", when).alias("_row"))


def merge_batch(pkgs: DataFrame, root: str, batch_id: int, kinds: tuple[str, ...] = KINDS, base: str = catalog.DEFAULT_DOIP_BASE) -> None:
    """One batch of packages into the tables ``kinds`` below ``root``."""
    kept, spark = pkgs.persist(StorageLevel.DISK_ONLY), pkgs.sparkSession
    try:
        for kind, rows in sinks.catalogue_tables(kept, base).items():
            if kind not in kinds:
                continue
            ok, _ = catalog.split_rejects(rows)
            last = _last(ok.select(_key(kind).alias("_key"), F.lit(batch_id).cast("long").alias("_batch"), F.struct(*ok.columns).alias("_row")))
            at = f"{root.rstrip('/')}/{kind}"
            spark.createDataFrame([], last.schema).coalesce(1).write.mode("ignore").parquet(f"{at}/schema")
            last.write.mode("overwrite").parquet(f"{at}/changes/batch_id={batch_id}")
    finally:
        kept.unpersist()


def _batches(folder: Folder) -> list[int]:
    return sorted(int(n.split("=", 1)[1]) for n in folder.names("changes") if n.startswith("batch_id="))


def _versions(spark: SparkSession, at: str, through: int | None = None) -> DataFrame:
    folder = Folder(spark, at)
    pointers = folder.names("pointers")
    done, name = pointers[-1].split("__", 1) if pointers else ("-1", None)
    new = [b for b in _batches(folder) if b > int(done) and (through is None or b <= through)]
    paths = [f"{at}/schema"] + ([f"{at}/bases/{name}"] if name else []) + [f"{at}/changes/batch_id={b}" for b in new]
    # one reader takes all folders; batch ids are in the rows, not the folders' names
    return spark.read.schema(spark.read.parquet(f"{at}/schema").schema).option("recursiveFileLookup", True).parquet(*paths)


def current(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The last version of every package of a table, with ``ord`` and the batch
    it came with (``batch_id``)."""
    return _last(_versions(spark, f"{root.rstrip('/')}/{kind}")).select("_row.*", F.col("_batch").alias("batch_id"))


def compact(spark: SparkSession, root: str, kind: str, through: int | None = None) -> str | None:
    """A new base of the batches up to ``through``, by default all but the
    newest: that one may still be run again. Returns its name, None if there
    is no such batch."""
    at = f"{root.rstrip('/')}/{kind}"
    folder = Folder(spark, at)
    known = _batches(folder)
    through = (known[-2] if len(known) > 1 else None) if through is None else through
    before = folder.names("pointers")
    if through is None or not [b for b in known if b <= through] or (before and int(before[-1].split("__", 1)[0]) >= through):
        return None
    name = uuid.uuid4().hex
    _last(_versions(spark, at, through)).write.mode("errorifexists").parquet(f"{at}/bases/{name}")
    folder.create(f"pointers/{through:020d}__{name}")
    return name


def retire(spark: SparkSession, root: str, kind: str, keep: int = 2) -> None:
    """Removes all but the ``keep`` newest bases, and the changes that the
    oldest base kept already holds."""
    folder = Folder(spark, f"{root.rstrip('/')}/{kind}")
    pointers = folder.names("pointers")
    for p in pointers[:-max(1, keep)]:
        folder.delete(f"pointers/{p}")
        folder.delete(f"bases/{p.split('__', 1)[1]}")
    if pointers:
        held = int(pointers[-max(1, keep):][0].split("__", 1)[0])
        for b in _batches(folder):
            if b <= held:
                folder.delete(f"changes/batch_id={b}")


def start_upkeep(spark: SparkSession, landing: str, root: str, kinds: tuple[str, ...] = KINDS, checkpoint: str | None = None,
                 trigger_once: bool = False, compact_every: int = 20, base: str = catalog.DEFAULT_DOIP_BASE,
                 max_files_per_trigger: int = 1000) -> StreamingQuery:
    """Keeps the tables up to date as reply files land. Every
    ``compact_every`` batches the earlier ones become a new base."""
    def batch_in(batch: DataFrame, batch_id: int) -> None:
        merge_batch(feed.packages(batch), root, batch_id, kinds, base)
        if batch_id and batch_id % compact_every == 0:
            for kind in kinds:
                compact(batch.sparkSession, root, kind, batch_id - 1)
                retire(batch.sparkSession, root, kind)

    ck = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/upkeep-{'-'.join(kinds)}"
    w = stream_envelopes(spark, landing, max_files_per_trigger).writeStream.foreachBatch(batch_in).option("checkpointLocation", ck)
    return (w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")).start()
