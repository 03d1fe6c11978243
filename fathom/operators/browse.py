"""Browse operators: search, filter, sort, count, page, select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.text import search_any
from fathom.operators.joins import broadcast_if_small

PAGE_SIZE = 10


def search(df: DataFrame, needle: str | None, cols: list[str]) -> DataFrame:
    """Literal, case-insensitive substring over ``cols``; blank keeps all."""
    return df.where(search_any(cols, needle))


def newest_first(ts_col: str) -> list[Column]:
    """Raw timestamp text descending, stable (feed order breaks ties)."""
    return [F.col(ts_col).desc(), F.col("ord").asc()]


def name_a_to_z(name_col: str = "name") -> list[Column]:
    """Lower-cased name ascending, stable."""
    return [F.lower(F.col(name_col)).asc(), F.col("ord").asc()]


def page(df: DataFrame, order: list[Column], size: int = PAGE_SIZE, number: int = 1) -> DataFrame:
    """Page ``number`` (1-based) of ``size`` rows under a total order.

    Runs as TakeOrderedAndProject (per-task top-k, then a merge of k rows per
    task): no full sort and no shuffle of the input.
    """
    top = df.orderBy(*order).limit(size * number)
    if number == 1:
        return top
    return top.offset(size * (number - 1))


def page_after(df: DataFrame, key: Column, last_key, last_ord, descending: bool, size: int = PAGE_SIZE, ord_col: str = "ord") -> DataFrame:
    """B11, keyset form for deep pages: the ``size`` rows after the last one
    shown, in the order (key, ord) of B8 (``descending`` key) or B9
    (ascending key); ord always ascends, so rows that tie with the last one
    are not lost. Null keys come last descending and first ascending, as
    Spark sorts them. ``last_ord`` is any value comparable with ``ord_col``."""
    o = last_ord if isinstance(last_ord, Column) else F.lit(last_ord)
    tied = key.eqNullSafe(F.lit(last_key)) & (F.col(ord_col) > o)
    if last_key is None:
        beyond = F.lit(False) if descending else key.isNotNull()
    else:
        beyond = (key < F.lit(last_key)) | key.isNull() if descending else key > F.lit(last_key)
    order = key.desc_nulls_last() if descending else key.asc_nulls_first()
    return df.where(F.coalesce(beyond, F.lit(False)) | tied).orderBy(order, F.col(ord_col).asc()).limit(size)


# Type filter options that keep every row, and the default badge.
ALL_TYPES = ("All Types", "Dataset")
DEFAULT_BADGE = "Dataset"
DESCRIPTION_CUT = 100
DEFAULT_HUB_BASE = "https://hub.example/dataset/"


def any_column_filter(df: DataFrame, needle: str | None, cols: list[str] | None = None) -> DataFrame:
    """Keep rows where any shown column, as text, contains the needle
    (case-insensitive, literal); blank keeps all."""
    if not needle:
        return df
    cols = cols or df.columns
    texts = F.array(*[F.lower(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in cols])
    return df.where(F.exists(texts, lambda t: F.contains(t, F.lit(needle.lower()))))


def badge(additional_type: Column) -> Column:
    """Type badge, ``Dataset`` when no type is set."""
    return F.coalesce(F.when(additional_type != "", additional_type), F.lit(DEFAULT_BADGE))


def type_filter(df: DataFrame, choice: str | None) -> DataFrame:
    """``All Types`` and ``Dataset`` keep all rows; any other value filters on the badge."""
    if not choice or choice in ALL_TYPES:
        return df
    return df.where(badge(F.col("additional_type")) == F.lit(choice))


def count_label(n: Column, noun: str) -> Column:
    """``Showing n <noun>s`` with the plural only when n != 1."""
    return F.concat(F.lit("Showing "), n.cast("string"), F.lit(" " + noun),
                    F.when(n != 1, F.lit("s")).otherwise(F.lit("")))


def facets(df: DataFrame) -> DataFrame:
    """B7 + B10: row count per badge (partial aggregation before the shuffle)."""
    return (df.groupBy(badge(F.col("additional_type")).alias("badge"))
            .agg(F.count(F.lit(1)).alias("n")))


def facets_with_total(df: DataFrame) -> DataFrame:
    """B7 + B10: the facets and their total (badge ``All Types``) in one pass."""
    named = df.select(badge(F.col("additional_type")).alias("_badge"))
    return (named.rollup("_badge").agg(F.count(F.lit(1)).alias("n"), F.grouping("_badge").alias("_all"))
            .select(F.when(F.col("_all") == 1, F.lit(ALL_TYPES[0])).otherwise(F.col("_badge")).alias("badge"), "n"))


def select_rows(df: DataFrame, selected: DataFrame, key: str = "qid") -> DataFrame:
    """Catalogue rows whose key is selected, in catalogue order (semi join:
    duplicates in ``selected`` never multiply rows). The picks are stored and
    measured first: broadcast when small, else joined by key with AQE splitting
    a hot key (many datasets have a blank one)."""
    return df.join(broadcast_if_small(selected.select(key).distinct()), key, "left_semi")


def first_by(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """First row per ``key`` in feed order (partial min_by aggregation)."""
    cols = [c for c in df.columns if c not in (key,)]
    return (df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
            .select(key, "_r.*"))


def short_description(desc: Column, n: int = DESCRIPTION_CUT) -> Column:
    """Description cut for cards."""
    return F.substring(F.coalesce(desc, F.lit("")), 1, n)


def links(datasets: DataFrame, doip_base: str, hub_base: str = DEFAULT_HUB_BASE) -> DataFrame:
    """One row per (dataset, component download) with the dataset's links.
    Datasets without components keep one row with null component fields."""
    base = doip_base.rstrip("/")
    return datasets.select(
        "ord", "qid",
        F.concat(F.lit(hub_base), F.lower("qid")).alias("hub_url"),
        F.when(F.col("qid") != "", F.concat(F.lit(base + "/doip/versions/"), F.col("qid"),
                                            F.lit("?include_sizes=true"))).otherwise(F.lit("")).alias("versions_url"),
        short_description(F.col("description")).alias("short_description"),
        F.posexplode_outer("components").alias("component_pos", "component"),
    ).select("ord", "qid", "hub_url", "versions_url", "short_description", "component_pos",
             F.col("component.name").alias("component_name"), F.col("component.url").alias("download_url"))
