"""Run-result series: numeric tests, gaps, positions, labels and alignment.

Input is a long table of loaded run files, one row per file row:
``(file_id, row_pos, <columns>)`` with ``row_pos`` dense 1..n per file (see
``operators.position``). Each chart series is one (file, column) pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from fathom.functions.text import gap_to_null, is_strict_number, to_number
from fathom.operators.position import dense_position, join_null_safe
from fathom.operators.preview import null_text
from fathom.session import cut_lineage

_TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def numeric_of(df: DataFrame, col: str) -> Column:
    """X12 on a typed column: numbers as doubles; temporal values as epoch
    microseconds (D12: pandas treats them as numbers); text through the
    pandas-like parser, bad values null."""
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, T.DateType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(dt, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dt, T.NumericType):
        return c.cast("double")
    return to_number(c)


def text_of(df: DataFrame, col: str) -> Column:
    """D6 on a typed column: its text, nulls as ``nan`` for numbers, ``NaT``
    for temporal values and ``None`` otherwise."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(null_text(df.schema[col].dataType)))


def column_profile(files: DataFrame, columns: list[str]) -> DataFrame:
    """X10 + X11: one row per (file, column): ``"file: column"`` key, ordinal,
    row count, gap count and the strict numeric test (every value parses).
    Numeric, boolean and temporal columns pass the test by type (D7, D12).

    The columns are unpivoted with ``stack`` and aggregated per key: a partial
    aggregate, so a hot file never gathers in one task.
    """
    typed = {c for c in columns if isinstance(files.schema[c].dataType, (T.NumericType, T.BooleanType, *_TEMPORAL))}
    pairs = ", ".join(f"'{c}', {i}, CAST(`{c}` AS STRING), {'true' if c in typed else 'false'}"
                      for i, c in enumerate(columns))
    long = files.selectExpr("file_id", f"stack({len(columns)}, {pairs}) AS (column, ordinal, value, typed)")
    return (long.groupBy("file_id", "column", "ordinal")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(gap_to_null(F.col("value")).isNull()).alias("n_gaps"),
                 F.bool_and(F.col("typed") | is_strict_number(F.col("value"))).alias("is_numeric"))
            .withColumn("key", F.concat_ws(": ", "file_id", "column")))


def positions_of(v: Column) -> Column:
    """A numeric x (see ``numeric_of``) truncated to an int position;
    null or non-finite values give null (D9)."""
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.when(finite, v.cast("long"))


def numeric_pairs(y_rows: DataFrame, x_rows: DataFrame | None, y_col: str, x_col: str) -> DataFrame:
    """(x, y) pairs by row. x comes from the y file when it has the x
    column, else from the x file by row position; an inner join on position
    cuts to the shorter of the two. Gaps become null."""
    if x_rows is None:
        src = y_rows.select("file_id", "row_pos", numeric_of(y_rows, x_col).alias("x"),
                            gap_to_null(F.col(y_col)).alias("y"))
    else:
        xs = x_rows.select("row_pos", numeric_of(x_rows, x_col).alias("x"))
        src = (y_rows.select("file_id", "row_pos", gap_to_null(F.col(y_col)).alias("y"))
               .join(xs, "row_pos", "inner"))
    return src.select("file_id", "row_pos", "x", "y")


def position_labels(x_rows: DataFrame, x_col: str, label_col: str, label_rows: DataFrame | None = None) -> DataFrame:
    """Position -> label text; the last row with that position wins.
    Labels from another file (``label_rows``) go by row position, cut to the
    shorter file."""
    pos = positions_of(numeric_of(x_rows, x_col)).alias("pos")
    if label_rows is None:
        rows = x_rows.select("row_pos", pos, text_of(x_rows, label_col).alias("label"))
    else:
        rows = x_rows.select("row_pos", pos).join(label_rows.select("row_pos", text_of(label_rows, label_col).alias("label")), "row_pos")
    return rows.where(F.col("pos").isNotNull()).groupBy("pos").agg(F.max_by("label", "row_pos").alias("label"))


def series_points(series_rows: DataFrame, x_col: str, y_col: str) -> DataFrame:
    """Per series: (series, pos, y) with the last row per position winning,
    including a last row whose value is a gap. ``series_rows`` holds
    ``series, row_pos, <x_col>, <y_col>`` with x already taken from the right file."""
    pts = series_rows.select("series", positions_of(numeric_of(series_rows, x_col)).alias("pos"), "row_pos",
                             gap_to_null(F.col(y_col)).cast("string").alias("y"))
    return (pts.where(F.col("pos").isNotNull())
            .groupBy("series", "pos")
            .agg(F.max(F.struct("row_pos", "y")).alias("_last"))
            .select("series", "pos", F.col("_last.y").alias("y")))


def axis(labels: DataFrame, points: DataFrame) -> DataFrame:
    """Every position of the labels and of all series, with its label
    text or the number itself."""
    pos = labels.select("pos").union(points.select("pos")).distinct()
    return (pos.join(labels, "pos", "left")
            .select("pos", F.coalesce(F.col("label"), F.col("pos").cast("string")).alias("category")))


def sparse_align(labels: DataFrame, points: DataFrame, series_names: list[str]) -> DataFrame:
    """Each series on every axis position, null where it has no value.

    Wide form by ``pivot`` over the known series names (no distinct-values
    job, no cross join), then back to a long table with ``unpivot``."""
    ax = axis(labels, points)
    wide = points.groupBy("pos").pivot("series", series_names).agg(F.first("y", ignorenulls=False))
    full = ax.join(wide, "pos", "left")
    return full.unpivot(["pos", "category"], series_names, "series", "y")


def category_zip(x_rows: DataFrame, y_rows: DataFrame, x_col: str, y_col: str) -> DataFrame:
    """Category axis: x text with y by row position, cut to the shorter
    (inner join on position); ``category_axis`` keeps every x."""
    xs = x_rows.select("row_pos", text_of(x_rows, x_col).alias("x"))
    ys = y_rows.select("file_id", "row_pos", gap_to_null(F.col(y_col)).alias("y"))
    return ys.join(xs, "row_pos", "inner").select("file_id", "row_pos", "x", "y")


def category_axis(x_rows: DataFrame, y_rows: DataFrame, x_col: str) -> DataFrame:
    """Every x of the axis, with ``in_range``: the y file has a row there."""
    xs = x_rows.select("row_pos", text_of(x_rows, x_col).alias("x"))
    ys = y_rows.select("row_pos", F.lit(True).alias("_y"))
    return xs.join(ys, "row_pos", "left").select("row_pos", "x", F.coalesce("_y", F.lit(False)).alias("in_range"))


def run_axis(labels: DataFrame, points: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """X16 over all runs: (run_key, pos, place, n_places, category), the
    positions of the run's labels and of all its series numbered 1..n in
    order. ``labels``: (run_key, pos, label), one row per position;
    ``points``: (run_key, series, pos, y). No run's axis is one task."""
    pos = labels.select("run_key", "pos").unionByName(points.select("run_key", "pos")).distinct()
    numbered = dense_position(pos, ["run_key"], ["pos"], out_col="place", total_col="n_places", max_group_rows=max_group_rows)
    named = join_null_safe(numbered, labels.select("run_key", "pos", "label"), ["run_key", "pos"])
    return named.select("run_key", "pos", "place", "n_places", F.coalesce("label", F.col("pos").cast("string")).alias("category"))


def sparse_ranges(labels: DataFrame, points: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """X17 over all runs and any number of series, with gaps as ranges: one
    row per value (from_pos = to_pos) and one per run of axis positions at
    which the series has no value (y null). Together a series' rows cover the
    run's axis once, in n_places positions; ``expand_ranges`` gives the dense
    form, whose size is axis times series.

    A series' values are swept in axis order: each is joined with the one
    before it by its number, and the places between the two are a gap. Joins
    are on (run, position) or (run, series, number), which are unique, so a
    run or series with a third of all rows spreads evenly."""
    ax = cut_lineage(run_axis(labels, points, max_group_rows))
    placed = join_null_safe(points, ax.select("run_key", "pos", "place", "n_places"), ["run_key", "pos"], "inner")
    values = cut_lineage(dense_position(placed.where("y IS NOT NULL").select("run_key", "series", "place", "n_places", "y"), ["run_key", "series"], ["place"],
                                        out_col="k", total_col="n_values", max_group_rows=max_group_rows))
    keys = ["run_key", "series"]
    before = values.select(*keys, (F.col("k") + 1).alias("k"), F.col("place").alias("prev"))
    swept = join_null_safe(values, before, [*keys, "k"]).withColumn("prev", F.coalesce("prev", F.lit(0)))
    gap = F.lit(None).cast("string").alias("y")
    own = swept.select(*keys, F.col("place").alias("from_place"), F.col("place").alias("to_place"), "y")
    between = swept.where("place > prev + 1").select(*keys, (F.col("prev") + 1).alias("from_place"), (F.col("place") - 1).alias("to_place"), gap)
    after = values.where("k = n_values AND place < n_places").select(*keys, (F.col("place") + 1).alias("from_place"), F.col("n_places").alias("to_place"), gap)
    # a series without any value is one gap
    named = placed.groupBy(*keys).agg(F.max("n_places").alias("n_places"), F.count("y").alias("n"))
    empty = named.where("n = 0").select(*keys, F.lit(1).cast("long").alias("from_place"), F.col("n_places").alias("to_place"), gap)
    rows = own.unionByName(between).unionByName(after).unionByName(empty)
    for end in ("from", "to"):
        at = ax.select("run_key", F.col("place").alias(f"{end}_place"), F.col("pos").alias(f"{end}_pos"))
        rows = join_null_safe(rows, at, ["run_key", f"{end}_place"], "inner")
    return rows.select(*keys, "from_pos", "to_pos", (F.col("to_place") - F.col("from_place") + 1).alias("n_positions"), "y")


def expand_ranges(ranges: DataFrame, ax: DataFrame) -> DataFrame:
    """The dense form of ``sparse_ranges``: (run_key, series, pos, category, y)
    for every position of the run's axis (``run_axis``)."""
    start = join_null_safe(ranges, ax.select("run_key", F.col("pos").alias("from_pos"), "place"), ["run_key", "from_pos"], "inner")
    each = start.select("run_key", "series", "y", F.explode(F.sequence("place", F.col("place") + F.col("n_positions") - 1)).alias("place"))
    return join_null_safe(each, ax.select("run_key", "place", "pos", "category"), ["run_key", "place"], "inner").select("run_key", "series", "pos", "category", "y")
