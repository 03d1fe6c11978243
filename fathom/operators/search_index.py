"""Substring search by trigrams.

The index of a table is three sorted tables: its rows in the listing's order;
postings (gram, place of the row) with one row per distinct three characters
of a row's searched texts, lower-cased; and the grams with their numbers of
postings. A search

1. looks up the numbers of the needle's grams and takes the rarest grams;
2. keeps the places that have all of them;
3. reads the files of these places and verifies the needle in the texts.

So its rows are those of the scan ``browse.search``, in the listing's order,
and it reads at most ``RAREST * FACTOR`` times the rarest gram's postings. A needle
under three characters, or one whose grams are nearly everywhere (more than
``SCAN_SHARE`` of the rows), is searched by a scan of the stored rows. A blank
needle keeps every row. A gram that is in every row is as many postings, dealt
over several files by the place; nothing is gathered by gram.

Null and empty texts have no grams. Grams never cross from one text to the
next. Texts are indexed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.text import search_any
from fathom.sources import sorted_table
from fathom.sources.sorted_table import RANGE, ROW

GRAM = 3
RAREST = 4
FACTOR = 8      # grams with this many times the postings of the rarest are left to the verification
SCAN_SHARE = 0.25


def grams(text: str) -> list[str]:
    return sorted({text[i:i + GRAM] for i in range(len(text) - GRAM + 1)})


def build(df: DataFrame, root: str, order: list[str], cols: list[str], rows_per_file: int = sorted_table.ROWS_PER_FILE) -> None:
    """The index of ``df`` in the total order ``order`` over its text columns
    ``cols``, below ``root``."""
    spark, root = df.sparkSession, root.rstrip("/")
    sorted_table.write_sorted(df, f"{root}/listing", order, rows_per_file=rows_per_file)
    # every place starts a gram: an empty match that looks three characters ahead
    found = [F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1) for c in cols]
    postings = (sorted_table.located(spark, f"{root}/listing")
                .select(F.explode(F.array_distinct(F.concat(*found))).alias("gram"), F.col(RANGE).alias("at_range"), F.col(ROW).alias("at_row")))
    sorted_table.write_sorted(postings, f"{root}/postings", ["gram", "at_range", "at_row"], ("gram",), 4 * rows_per_file)
    counts = sorted_table.located(spark, f"{root}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    sorted_table.write_sorted(counts, f"{root}/grams", ["gram"], ("gram",), rows_per_file)


def candidates(spark: SparkSession, root: str, needle: str) -> DataFrame | None:
    """Places (_range, _row) of the rows that may hold the needle, from the
    postings of its rarest grams; None where a scan is the better way."""
    root, wanted = root.rstrip("/"), grams(needle.lower())
    if not wanted:
        return None
    n = {r["gram"]: r["n"] for r in sorted_table.rows_with(spark, f"{root}/grams", "gram", wanted).collect()}    # at most the needle's grams
    rarest = sorted(wanted, key=lambda g: (n.get(g, 0), g))[:RAREST]
    rarest = [g for g in rarest if n.get(g, 0) <= FACTOR * n.get(rarest[0], 0)] or rarest[:1]
    total = sorted_table.index_of(spark, f"{root}/listing").agg(F.sum("rows")).first()[0] or 0
    if n.get(rarest[0], 0) > SCAN_SHARE * total:
        return None
    if not all(g in n for g in wanted):
        rarest = []     # a gram that no row has
    hits = sorted_table.rows_with(spark, f"{root}/postings", "gram", rarest)
    return (hits.groupBy(F.col("at_range").alias(RANGE), F.col("at_row").alias(ROW)).agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") == len(rarest)).select(RANGE, ROW))


def search(spark: SparkSession, root: str, needle: str | None, cols: list[str]) -> DataFrame:
    """The indexed rows where a column of ``cols`` (those of ``build``, or
    fewer) holds the needle, with their places ``_range``, ``_row``: ordered by
    these they are in the listing's order."""
    listing = f"{root.rstrip('/')}/listing"
    places = candidates(spark, root, needle) if needle else None
    rows = sorted_table.located(spark, listing).drop("_file") if places is None else sorted_table.rows_at(spark, listing, places)
    return rows.where(search_any(cols, needle))
