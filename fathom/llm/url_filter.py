"""URL filters by a sort-merge range join.

A rule (host, path, verdict) fits a url if the url's host is the rule's host
or a subdomain of it and the url's path starts with the rule's path. The
host is reversed by labels and closed with a dot ("m.example.net" becomes
"net.example.m."), so all hosts under a rule's host share a prefix: the rule
is the interval of keys that start with it, and intervals nest or are apart.
Urls and rules are sorted by key together and swept once: a stack holds the
rules' hosts whose interval is still open, and only those are looked at.

The longest fitting rule (host and path characters) wins, then the longer
host, then "block". A url without a fitting rule gets ``default``. Null urls
and urls without "://" have empty host and path, and no rule. Rules with a
null host or path are ignored; repeated rules count once. Empty tables give
empty results. Repeated rows are judged each.

Skew: urls are cut into key ranges by (key, row id), so a host with a third
of all rows is spread over many ranges. A rule is copied to the ranges its
interval meets; at every cut only nested rules are open, so the copies are
at most rules + cuts x nesting depth. The cut points come from a sample of
``SAMPLE_PER_RANGE`` keys per range, which only moves the cuts, never the
result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import ROW_ID, pylist, with_row_id

# A range takes about this many urls; never more than MAX_RANGES ranges, so
# the sample the driver holds stays below MAX_RANGES * SAMPLE_PER_RANGE keys.
RANGE_ROWS = 500
MAX_RANGES = 5_000
SAMPLE_PER_RANGE = 20


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def reversed_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot; empty for no host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit(".")))


class _Stack:
    """Open rule hosts, innermost last. Each level holds its rules by path."""

    def __init__(self) -> None:
        self.levels: list[tuple[str, dict[str, str], list[int]]] = []

    def close(self, key: str) -> None:
        while self.levels and not key.startswith(self.levels[-1][0]):
            self.levels.pop()

    def open(self, key: str, path: str, verdict: str) -> None:
        if not self.levels or self.levels[-1][0] != key:
            self.levels.append((key, {}, []))
        _, paths, sizes = self.levels[-1]
        if paths.get(path) != "block":
            paths[path] = verdict
        if len(path) not in sizes:
            bisect.insort(sizes, len(path))

    def best(self, path: str) -> tuple[str, str, str] | None:
        """(rule key, rule path, verdict) of the longest fitting rule."""
        found, most = None, (-1, -1)
        for key, paths, sizes in self.levels:
            for n in reversed(sizes):
                if n <= len(path) and (v := paths.get(path[:n])) is not None:
                    if (len(key) + n, len(key)) > most:
                        found, most = (key, path[:n], v), (len(key) + n, len(key))
                    break
        return found


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, at = _Stack(), None
        for b in batches:
            out: list[tuple] = []
            for rng, key, is_url, path, verdict, row in zip(*(pylist(b, c) for c in ("_range", "_key", "_is_url", "_path", "_verdict", ROW_ID))):
                if rng != at:
                    stack, at = _Stack(), rng
                stack.close(key)
                if not is_url:
                    stack.open(key, path, verdict)
                elif best := stack.best(path):
                    host = ".".join(reversed(best[0][:-1].split(".")))
                    out.append((row, host + best[1], best[2]))
                else:
                    out.append((row, None, default))
            yield pa.RecordBatch.from_pylist([dict(zip((ROW_ID, "rule", "verdict"), x)) for x in out],
                                             pa.schema([(ROW_ID, pa.int64()), ("rule", pa.string()), ("verdict", pa.string())]))
    return run


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", id_col: str = "page_id",
               default: str = "allow") -> DataFrame:
    """Per row of ``urls``: ``id_col``, host, path, rule (host + path text of
    the winning rule, else null) and verdict."""
    spark = urls.sparkSession
    base = with_row_id(urls.select(F.col(id_col).alias("_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
                       .withColumn("_key", reversed_key(F.col("host"))), "urls")
    n = base.count()
    ranges = max(1, min(MAX_RANGES, -(-n // RANGE_ROWS)))
    fraction = min(1.0, ranges * SAMPLE_PER_RANGE / max(n, 1))
    sample = base.select("_key", ROW_ID) if fraction == 1.0 else base.select("_key", ROW_ID).sample(fraction, seed=7)
    keys = sorted((r[0], r[1]) for r in sample.toLocalIterator())
    cuts = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []
    held = spark.sparkContext.broadcast(cuts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [bisect.bisect_right(held.value, x) for x in zip(pylist(b, "_key"), pylist(b, ROW_ID))]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), *(b.column(i) for i in range(b.num_columns))],
                                             names=["_range", *b.schema.names])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            out = [{"_range": i, **r} for r in rows
                   for i in range(bisect.bisect_left(held.value, (r["_key"], -1)), bisect.bisect_left(held.value, (r["_key"][:-1] + "/", -1)) + 1)]
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("_range", pa.int32()), *b.schema]))

    placed = base.select("_key", "path", ROW_ID).withColumnRenamed("path", "_path").mapInArrow(
        place, f"_range int, _key string, _path string, {ROW_ID} long")
    own = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        reversed_key(F.lower("host")).alias("_key"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict")).where("_key <> ''").distinct()
    opened = own.mapInArrow(spread, "_range int, _key string, _path string, _verdict string")
    both = (placed.withColumns({"_verdict": F.lit(None).cast("string"), "_is_url": F.lit(True)})
            .unionByName(opened.withColumns({ROW_ID: F.lit(-1).cast("long"), "_is_url": F.lit(False)})))
    swept = (both.repartition("_range").sortWithinPartitions("_range", "_key", "_is_url", "_path", ROW_ID)
             .mapInArrow(_sweep(default), f"{ROW_ID} long, rule string, verdict string"))
    return base.join(swept, ROW_ID).select(F.col("_id").alias(id_col), "host", "path", "rule", "verdict")
