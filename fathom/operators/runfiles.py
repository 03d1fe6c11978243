"""Run-file discovery and load plan (X1-X8, X22) from run metadata documents.

Run metadata arrives as JSON text (one document per run). ``fdo:hasComponent``
may be one object or a list, and ``prov:used`` entries are strings or
``{"@id", "schema:query"}`` objects, so both are read as VARIANT and
normalised with ``try_variant_get``. Everything per run happens inside the
row or as joins on (run, file name); no run's files pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators.catalog import DEFAULT_DOIP_BASE
from fathom.schemas import RUN_META

# Fixed values.
EXTENSIONS = (".parquet", ".tsv", ".csv")
PREDICTIONS = "predictions"
ANNOTATED = "input_annotated.parquet"
INPUT_PREFIX = "components/input/"
FILTERED_SUFFIX = " (filtered)"

_COMP = "struct<`@id`:string,componentId:string>"


def parse_run_meta(docs: DataFrame, text_col: str = "meta_json") -> DataFrame:
    """Parse run metadata text with the explicit (variant-bearing) schema."""
    return docs.withColumn("meta", F.from_json(F.col(text_col), RUN_META))


def components(meta: Column) -> Column:
    """X1 (part): hasComponent as an array, an object becoming a list of one."""
    v = meta["kernel"]["fdo:hasComponent"]
    as_list = F.try_variant_get(v, "$", f"array<{_COMP}>")
    as_one = F.try_variant_get(v, "$", _COMP)
    return F.coalesce(as_list, F.when(as_one.isNotNull(), F.array(as_one)), F.array().cast(f"array<{_COMP}>"))


def _ext(cid: Column) -> Column:
    low = F.lower(cid)
    out = None
    for e in EXTENSIONS:
        out = F.when(low.endswith(e), F.lit(e)) if out is None else out.when(low.endswith(e), F.lit(e))
    return out


def load_plan(runs: DataFrame, base: str = DEFAULT_DOIP_BASE, candidates: bool = False) -> DataFrame:
    """The ordered files to load per gated run.

    With ``candidates`` every provenance Parquet entry is kept: which of them
    is needed is known only after loading (``resolve_loaded``), and the second
    gate waits for it too.

    stage 0: Parquet inputs under ``components/input/`` (not the annotated
    input); stage 1: provenance Parquet files not loaded yet, first entry per
    file name, labelled `` (filtered)`` when a query is recorded; stage 2:
    every other discovered component. Runs without a ``predictions``
    component, or whose plan would load none, are dropped.

    A run's components and provenance live in its one metadata document, so
    the whole plan is computed inside the row with array functions and then
    exploded: one narrow stage, no shuffle, no join.
    """
    link = base.rstrip("/") + "/doip/retrieve/"
    qid = F.coalesce(F.col("meta.`@id`"), F.col("qid"), F.lit(""))
    comps = F.transform(components(F.col("meta")), lambda c, i: F.struct(
        i.alias("pos"), F.coalesce(c["componentId"], F.lit("")).alias("cid"), c["@id"].alias("at_raw")))
    used = F.coalesce(F.try_variant_get(F.col("meta.provenance.`prov:used`"), "$", "array<variant>"),
                      F.array().cast("array<variant>"))

    def prov_entry(e, i):
        is_obj = F.schema_of_variant(e).startswith("OBJECT")
        url = F.when(is_obj, F.coalesce(F.try_variant_get(e, "$['@id']", "string"), F.lit(""))) \
            .otherwise(F.coalesce(F.try_variant_get(e, "$", "string"), F.lit("")))
        query = F.when(is_obj, F.coalesce(F.try_variant_get(e, "$['schema:query']", "string"), F.lit(""))) \
            .otherwise(F.lit(""))
        fname = F.substring_index(F.regexp_replace(F.substring_index(url, "?", 1), "/+$", ""), "/", -1)
        return F.struct(i.alias("pos"), url.alias("url"), fname.alias("filename"), query.alias("query"))

    # Each intermediate array is its own column, so nested lambdas read a
    # column instead of re-evaluating an array expression per element.
    staged = runs.select("run_key", qid.alias("qid"), comps.alias("_c"), F.transform(used, prov_entry).alias("_p"))

    def is_input(d):
        return F.coalesce(d["at_raw"], F.lit("")).startswith(INPUT_PREFIX)

    def entry(stage, d):
        path = F.regexp_replace(F.coalesce(d["at_raw"], F.concat(F.lit("output/"), d["cid"])), "^components/", "")
        return F.struct(F.lit(stage).alias("stage"), d["pos"].alias("pos"), d["cid"].alias("label"),
                        F.concat(F.lit(link), F.col("qid"), F.lit("/"), path).alias("url"),
                        d["ext"].alias("ext"), F.lit("").alias("query"))

    s1 = staged.withColumn("_d", F.filter(F.transform("_c", lambda d: d.withField("ext", _ext(d["cid"]))),
                                          lambda d: d["ext"].isNotNull()))
    s2 = (s1.withColumn("_in", F.filter("_d", lambda d: (d["cid"] != ANNOTATED) & is_input(d) & (d["ext"] == ".parquet")))
          .withColumn("_out", F.filter("_d", lambda d: (d["cid"] != ANNOTATED) & ~is_input(d))))
    s3 = s2.withColumn("_fresh", F.filter("_p", lambda p: F.lower(p["filename"]).endswith(".parquet")
                                          & (F.lit(candidates) | ~F.exists("_in", lambda x: x["cid"] == p["filename"]))))
    s4 = s3.withColumn("_first", F.filter("_fresh", lambda p: F.lit(candidates) | ~F.exists(
        "_fresh", lambda q: (q["filename"] == p["filename"]) & (q["pos"] < p["pos"]))))
    prov_rows = F.transform("_first", lambda p: F.struct(
        F.lit(1).alias("stage"), p["pos"].alias("pos"),
        F.when(p["query"] != "", F.concat(p["filename"], F.lit(FILTERED_SUFFIX))).otherwise(p["filename"]).alias("label"),
        p["url"].alias("url"), F.lit(".parquet").alias("ext"), p["query"].alias("query")))
    s5 = s4.withColumn("_plan", F.concat(F.transform("_in", lambda d: entry(0, d)), prov_rows,
                                         F.transform("_out", lambda d: entry(2, d))))
    # Gate by emptying the plan, and explode with the outer form: a row filter,
    # or the size(...) > 0 filter Spark infers for a plain explode, would be
    # pushed below the projections with the whole derivation copied into it.
    gate = (F.exists("_d", lambda d: F.contains(F.lower(d["cid"]), F.lit(PREDICTIONS)))
            & (F.lit(candidates) | F.exists("_plan", lambda e: F.contains(F.lower(e["label"]), F.lit(PREDICTIONS)))))
    gated = s5.select("run_key", "qid", F.when(gate, F.col("_plan")).alias("_plan"))
    return (gated.select("run_key", "qid", F.explode_outer("_plan").alias("e"))
            .where(F.col("e").isNotNull()).select("run_key", "qid", "e.*"))


def replay(spark, url: str, query: str | None, limit: int = 500):
    """A recorded transform run again on its source, in a session of its
    own: the total row count (one row) and the first ``limit`` rows. Without
    a query the whole file is counted and the rows come in file order."""
    from fathom.operators import preview
    s = preview.isolated(spark)
    source = preview.register_dataset(s, url)
    if not (query or "").strip():
        return preview.count_and_head(source, limit)[0], preview.file_order_head(source, limit)
    return preview.count_and_head(preview.run_sql(s, query), limit)


def resolve_loaded(candidates: DataFrame, outcome: DataFrame) -> DataFrame:
    """X2 second gate, X5, X22: what became of every candidate file.

    ``candidates`` come from ``load_plan(candidates=True)`` with their path;
    ``outcome`` is (path, query, error), error null for a file that was read
    and whose recorded query ran. Status:
    ``ok``; ``failed`` with the error (a path without an outcome: not found);
    ``skipped`` for a provenance entry whose file name an input or an earlier
    entry has already given. So a later entry of a name is used when the first
    could not be read. Runs that loaded no predictions have ``shown`` false."""
    from pyspark.sql import Window
    c, o = candidates.alias("c"), outcome.select("path", "query", F.lit(True).alias("_seen"), "error").alias("o")
    error = F.when(F.col("_seen").isNull(), F.lit("not found")).otherwise(F.col("error"))
    tried = c.join(o, (F.col("c.path") == F.col("o.path")) & (F.col("c.query") == F.col("o.query")), "left").select("c.*", error.alias("error"))
    name = F.regexp_replace("label", "\\Q" + FILTERED_SUFFIX + "\\E$", "")
    gives = (F.col("stage") <= 1) & F.col("error").isNull()
    # a run's files are one metadata document's entries: a bounded window
    earlier = Window.partitionBy("run_key", "_name").orderBy("stage", "pos").rowsBetween(Window.unboundedPreceding, -1)
    given = F.coalesce(F.max(F.when(gives, 1).otherwise(0)).over(earlier), F.lit(0)) == 1
    status = F.when((F.col("stage") == 1) & F.col("_given"), "skipped").when(F.col("error").isNull(), "ok").otherwise("failed")
    out = tried.withColumn("_name", name).withColumn("_given", given).withColumn("status", status)
    out = out.withColumn("error", F.when(F.col("status") == "failed", F.col("error")))
    shown = F.max((F.col("status") == "ok") & F.contains(F.lower("label"), F.lit(PREDICTIONS))).over(Window.partitionBy("run_key"))
    return out.withColumn("shown", shown).drop("_name", "_given")


def load_report(plan: DataFrame, loaded: DataFrame) -> DataFrame:
    """Per planned file, ``ok`` or the error message; one failure never
    drops the other files. ``loaded`` holds (run_key, stage, pos, error)."""
    return (plan.join(loaded, ["run_key", "stage", "pos"], "left")
            .withColumn("status", F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("failed"))))
