"""Line dedup by site-relative frequency.

Pages are grouped by host. For every line the different page texts of the
host that contain it are counted and divided by the host's number of
different page texts; a line above the boilerplate ratio is dropped from every
page of that host. Copies of a page count once, on both sides of the ratio, so
a page that is repeated as a whole keeps its lines. DataFrame functions only.

Lines are the pieces between line feeds, compared after trimming spaces. A
line counts once per page text. Blank lines are never dropped. A line must be
in at least ``min_pages`` page texts, so a host with one page keeps it whole.
Null text stays null and counts nowhere. A null host is a host of its own.
Repeated rows are copies. An empty table gives an empty table. A very long
text is one row with a digest per line. Columns of the input may have any
names; ``n_lines`` and ``n_dropped`` are replaced.

Only 16-byte digests of texts and lines are shuffled. A line on a third of all
pages is counted per task first. The lines to drop of one host are bounded (a
page has L lines on average: at most L / ratio of them are over the ratio) and
kept as one array per host. Those arrays are broadcast when their measured
bytes are within ``BROADCAST_BYTES``; beyond it they are joined by host,
salted so that a hot host is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import store

BROADCAST_BYTES = 16 << 20
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def boilerplate_lines(pages: DataFrame, host: str = "source", text: str = "text",
                      ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """One row per (host, line digest) to drop, with the host's number of page
    texts that have it (_pages) and of all its page texts (_total)."""
    own = pages.select(F.col(f"`{host}`").alias("_host"), F.col(f"`{text}`").alias("_text")).where("_text IS NOT NULL")
    lines = F.array_distinct(F.transform(F.filter(_lines(F.col("_text")), lambda x: F.trim(x) != ""), _digest))
    texts = store(own.select("_host", F.unhex(F.md5("_text")).alias("_page"), lines.alias("_lines"))
                  .dropDuplicates(["_host", "_page"]).select("_host", "_lines"), "page-lines")
    totals = texts.groupBy("_host").agg(F.count(F.lit(1)).alias("_total"))
    counts = (texts.select("_host", F.explode("_lines").alias("_line")).groupBy("_host", "_line")
              .agg(F.count(F.lit(1)).alias("_pages")).where(F.col("_pages") >= min_pages))
    c, t = counts.alias("c"), totals.alias("t")
    return (c.join(t, F.col("c._host").eqNullSafe(F.col("t._host")))
            .select("c._host", "_line", "_pages", "_total")
            .where(F.col("_pages") > F.col("_total") * F.lit(ratio)))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.05,
                     min_pages: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with ``text`` without its host's boilerplate lines, and
    ``n_lines`` and ``n_dropped`` (0 for null text) added. All rows stay;
    columns of those two names in the input are replaced."""
    bad = store(boilerplate_lines(pages, host, text, ratio, min_pages)
                .groupBy("_host").agg(F.collect_list("_line").alias("_bad")), "boilerplate")
    size = bad.agg(F.sum(F.size("_bad") * 24 + 64).alias("b")).first()["b"] or 0
    # the input's columns travel inside one struct, where no name can clash
    kept = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(f"`{host}`").alias("_of"),
                        F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(SALTS)).alias("_salt"))
    same = F.col("_of").eqNullSafe(F.col("_host"))
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(bad), same, "left")
    else:
        salted = bad.withColumn("_bad_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(salted, same & (F.col("_salt") == F.col("_bad_salt")), "left")
    lines = _lines(F.col(f"_row.`{text}`"))
    left = F.when(F.col("_bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("_bad"), _digest(x)) | (F.trim(x) == "")))
    out = joined.select("_row", lines.alias("_all"), left.alias("_kept"))
    return out.select(
        *[F.array_join("_kept", "\n").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in kept],
        F.greatest(F.size("_all"), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.size("_all") - F.size("_kept"), F.lit(0)).cast("long").alias("n_dropped"))
