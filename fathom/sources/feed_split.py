"""Large replies read by many tasks.

A JSON document is one task for Spark's JSON reader. Here a reply is read as
text cut behind every ``}``, which Spark's text reader splits by bytes like
lines, and the packages are put together again from the pieces:

- a piece tells, without knowing where it starts, how many unescaped quotes
  it has and how far it goes up or down in nesting if it starts inside or
  outside a string;
- sums over the pieces before (first of whole splits, then inside a split)
  give where every piece starts, so no file's pieces are one window;
- a package ends with a piece that comes back to the depth of the ``results``
  array; its pieces are joined and parsed alone.

What is not in ``results`` is the envelope, which keeps the reply's status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.operators.joins import broadcast_if_small
from fathom.schemas import FEED_ENVELOPE, PACKAGE
from fathom.session import cut_lineage

_OPENS = r'"results"\s*:\s*\['
_LEVEL = 3      # inside {"result": {"results": [


def _sum_before(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the pieces before, per reply."""
    blocks = df.groupBy("src", "block").agg(F.sum(value).alias("_n"))
    earlier = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = blocks.select("src", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("src", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return (df.join(broadcast_if_small(shift), ["src", "block"])
            .withColumn(out, F.col("_shift") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_shift"))


def _steps(parity: int) -> Column:
    """Levels opened minus levels closed (but for the final ``}``) in the
    parts of a piece outside strings, if those are the ones of ``parity``."""
    return F.expr(f"""aggregate(transform(parts, (p, k) -> if(k % 2 = {parity},
        length(translate(p, ']', '')) - length(translate(p, '{{[', '')), 0)), 0, (a, x) -> a + x)""")


def split_pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Stored pieces of every reply: src, block, i, value, and where each
    stands: ``depth`` before it, ``left`` after it, ``inside`` a string."""
    read = spark.read.option("lineSep", "}").text(paths)
    cut = cut_lineage(read.select(F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_block_start").alias("block"),
                                  F.monotonically_increasing_id().alias("i"), "value"))
    # escape pairs hide no quote; a string's text is between an odd and an even quote
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    told = cut.withColumn("parts", parts).select("src", "block", "i", "value", (F.size("parts") - 1).alias("quotes"),
                                                 _steps(0).alias("from_outside"), _steps(1).alias("from_inside"))
    known = _sum_before(told, "quotes", "_before").withColumn("inside", F.col("_before") % 2 == 1)
    step = F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside")) - ((F.col("_before") + F.col("quotes")) % 2 == 0).cast("int")
    deep = _sum_before(known.withColumn("step", step), "step", "depth")
    out = deep.select("src", "block", "i", "value", "depth", (F.col("depth") + F.col("step")).alias("left"), "inside",
                      ((F.col("_before") + F.col("quotes")) % 2 == 1).alias("open_string"))
    return cut_lineage(out)


def read_feed_split(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(envelopes, packages) of replies of any size: the envelopes with src,
    as ``feed.read_feed`` but without results; the packages of successful
    replies in feed order, as ``feed.packages``."""
    pieces = split_pieces(spark, paths)
    at = F.struct("block", "i")
    none = F.regexp_extract("value", rf"(?s)^.*?{_OPENS}(\s*\])?", 1) != ""       # results is an empty list
    first = F.min(F.when((F.col("depth") < _LEVEL) & F.col("value").rlike(_OPENS), F.struct("block", "i", none.alias("none"))))
    starts = pieces.groupBy("src").agg(first.alias("f")).select("src", F.when(~F.col("f.none"), F.struct("f.block", "f.i")).alias("start"))
    marked = pieces.join(broadcast_if_small(starts), "src")
    closing = (at > F.col("start")) & (F.col("depth") == _LEVEL) & ~F.col("inside") & F.col("value").rlike(r"^\s*\]")
    ends = marked.groupBy("src").agg(F.min(F.when(closing, at)).alias("end"))
    placed = marked.join(broadcast_if_small(ends), "src")
    item = F.coalesce((at >= F.col("start")) & (F.col("end").isNull() | (at < F.col("end"))), F.lit(False))
    flagged = placed.withColumn("item", item).withColumn("closes", (F.col("item") & (F.col("left") == _LEVEL) & ~F.col("open_string")).cast("int"))
    numbered = _sum_before(flagged, "closes", "pos")

    def joined(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
        in_order = F.sort_array(F.collect_list(F.struct("block", "i", text.alias("text"))))
        return rows.groupBy(*keys).agg(F.array_join(F.transform(in_order, lambda x: x["text"]), "").alias("text"))
    is_start = at == F.col("start")
    own = F.when(is_start, F.regexp_extract("value", rf"(?s)^.*?{_OPENS}(.*)$", 1)).otherwise(F.col("value"))
    texts = joined(numbered.where("item"), ["src", "pos"], F.concat(own, F.lit("}")))
    parsed = texts.select("src", F.col("pos").cast("long").alias("pos"), F.from_json(F.regexp_replace("text", r"^\s*,", ""), PACKAGE).alias("p"))
    # the envelope: pieces outside results, the head of the first one, nothing behind the document
    head = F.when(is_start, F.regexp_extract("value", rf"(?s)^(.*?{_OPENS})", 1)).otherwise(F.concat("value", F.lit("}")))
    rest = numbered.where((~F.col("item") | is_start) & ((F.col("depth") > 0) | F.col("value").contains("{")))
    slim = T.StructType([f if f.name != "result" else T.StructField("result", T.StructType([x for x in f.dataType if x.name != "results"])) for f in FEED_ENVELOPE])
    envelopes = joined(rest, ["src"], head).select("src", F.from_json("text", slim).alias("e")).select("e.*", "src")
    good = broadcast_if_small(envelopes.where(F.coalesce("success", F.lit(False))).select("src"))
    packages = parsed.join(good, "src", "left_semi").where("p IS NOT NULL").select(F.struct("src", "pos").alias("ord"), "p.*")
    return envelopes, packages
