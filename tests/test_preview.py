"""Dataset SQL, previews, text rendering."""

import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from fathom.operators import preview


def test_wrap_and_run(spark):
    preview.register_dataset(spark, "/root/testdata/sf0.001/lineitem.parquet")
    assert preview.wrap_user_sql("  ") == preview.DEFAULT_QUERY
    assert preview.run_sql(spark, "").count() == 500
    cte = "WITH t AS (SELECT l_orderkey FROM df) SELECT count(*) AS n FROM t;"
    assert preview.run_sql(spark, cte).first()["n"] == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    with pytest.raises(ParseException):
        preview.run_sql(spark, "DROP TABLE df")
    with pytest.raises(ParseException):
        preview.run_sql(spark, "SELECT 1; SELECT 2")


def test_csv_tsv_sources(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "event_type", "value")
    df.coalesce(1).write.option("header", True).option("sep", "\t").csv(str(tmp_path / "t"))
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "c"))
    t = preview.register_dataset(spark, str(tmp_path / "t"), "tsv")
    c = preview.register_dataset(spark, str(tmp_path / "c"), "csv")
    assert t.columns == c.columns == ["event_id", "event_type", "value"]
    assert t.count() == c.count() == df.count()
    head = preview.file_order_head(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), 3)
    assert [r["event_id"] for r in head.collect()] == [0, 1, 2]


def test_labels_and_text(spark):
    df = spark.createDataFrame([(1, 2.5, None, None), (None, None, "x", None)],
                               "i long, d double, s string, t timestamp")
    txt = preview.as_text(df).collect()
    assert tuple(txt[0]) == ("1", "2.5", "None", "NaT") and tuple(txt[1]) == ("None", "nan", "x", "NaT")
    lab = spark.createDataFrame([(500, 12345), (20, 20), (7, None)], "shown long, total long")
    got = [r[0] for r in lab.select(preview.shape_label(preview.row_label(F.col("shown"), F.col("total")), 4)).collect()]
    assert got == ["500 of 12,345 rows × 4 columns", "20 rows × 4 columns", "7 rows × 4 columns"]


def test_csv_head_in_file_order(spark, tmp_path):
    import os
    d = tmp_path / "csvs"
    d.mkdir()
    for f in range(3):
        lines = ["k,v"] + [f"{f * 1000 + i},{i}" for i in range(300)]
        (d / f"part{f}.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")   # several splits per file
    try:
        df = preview.register_dataset(spark, str(d), "csv")
        got = [r["k"] for r in preview.file_order_head(df, 500).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f * 1000 + i for f in range(3) for i in range(300)][:500]


def test_isolated_sessions_keep_their_own_df(spark):
    a = preview.query_dataset(spark, "/root/testdata/sf0.001/events.parquet", "SELECT count(*) AS n FROM df")
    b = preview.query_dataset(spark, "/root/testdata/sf0.001/orders.parquet", "SELECT count(*) AS n FROM df")
    assert a.first()["n"] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert b.first()["n"] == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
