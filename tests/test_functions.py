"""Literal fixtures for the scalar rules (strip, search, numbers, dates, JSON)."""

import datetime as dt

from pyspark.sql import functions as F

from fathom.functions import dates, nested, text

AS_OF = "2024-02-01 00:00:00"


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {typ}")


def test_strip_matches_python(spark):
    vals = ["  a b ", "\t\nx\r\n", " y ", "\x1cz\x1f", "", "   "]
    got = [r[0] for r in one_col(spark, vals).select(text.strip_ws(F.col("v"))).collect()]
    assert got == [v.strip() for v in vals]


def test_contains_is_literal_and_case_insensitive(spark):
    df = one_col(spark, ["100% sure", "a_b", "ABC", None, "axb"])
    assert [r[0] for r in df.where(text.search_any(["v"], "%")).collect()] == ["100% sure"]
    assert [r[0] for r in df.where(text.search_any(["v"], "_")).collect()] == ["a_b"]
    assert [r[0] for r in df.where(text.search_any(["v"], "bC")).collect()] == ["ABC"]
    assert df.where(text.search_any(["v"], "")).count() == 5


def test_strict_number_and_coercion(spark):
    # D7 guard: pandas-like parsing; '' passes the strict test as a gap
    cases = {"": (True, None), "nan": (False, None), "None": (False, None), "1d": (False, None),
             "1_000": (False, None), " 1 ": (True, 1.0), "1e3": (True, 1000.0), "1.": (True, 1.0),
             "+5": (True, 5.0), "inf": (True, float("inf")), "-Infinity": (True, float("-inf")),
             ".5": (True, 0.5), "abc": (False, None)}
    df = one_col(spark, list(cases))
    got = df.select("v", text.is_strict_number(F.col("v")).alias("ok"), text.to_number(F.col("v")).alias("n")).collect()
    for r in got:
        assert (r["ok"], r["n"]) == cases[r["v"]], r


def test_gap_to_null(spark):
    # only these spellings of text are gaps; a NaN number is one
    df = one_col(spark, ["nan", "None", "", "0", "x", "NaN", "NAN", "none"])
    assert [r[0] for r in df.select(text.gap_to_null(F.col("v"))).collect()] == [None, None, None, "0", "x", "NaN", "NAN", "none"]
    numbers = spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "v double")
    assert [r[0] for r in numbers.select(text.gap_to_null(F.col("v"))).collect()] == [1.5, None, None]


def test_dataset_dates_keep_date_only(spark):
    vals = ["", "2024-01-05", "2024-01-05T08:30:00", "2024-01-05 08:30:00", "2024-1-5", "2024-01-31T23:59:59Z",
            "2024-02-01", "2024-02-02", "text", "  2024-01-30  "]
    df = one_col(spark, vals)
    disp, rel = dates.fmt_dataset_date(F.col("v"), AS_OF)
    got = df.select(disp, rel).collect()
    assert tuple(got[0]) == ("—", "")
    assert tuple(got[1]) == ("Jan 5, 2024", "27 days ago")
    assert tuple(got[2]) == ("Jan 5, 2024", "27 days ago")   # time of day dropped (D4)
    assert tuple(got[3]) == ("Jan 5, 2024", "27 days ago")
    assert tuple(got[4]) == ("Jan 5, 2024", "27 days ago")
    assert tuple(got[5]) == ("Jan 31, 2024", "1 day ago")
    assert tuple(got[6]) == ("Feb 1, 2024", "Today")
    assert tuple(got[7]) == ("Feb 2, 2024", "-1 days ago")   # future is negative
    assert tuple(got[8]) == ("text", "")
    assert tuple(got[9]) == ("Jan 30, 2024", "2 days ago")


def test_model_dates(spark):
    vals = ["2024-01-05T10:20:30.123456789Z", "2024-01-05T10:20:30Z", "2024-01-05 10:20:30", "2024-01-05",
            "2024-01-05T10:20:30+00:00", "nope", ""]
    disp, rel = dates.fmt_model_date(F.col("v"), AS_OF)
    got = [tuple(r) for r in one_col(spark, vals).select(disp, rel).collect()]
    assert got[:3] == [("Jan 5, 2024", "26 days ago")] * 3   # floor of elapsed days
    assert got[3] == ("Jan 5, 2024", "27 days ago")
    assert got[4] == ("2024-01-05T10:20:30+00:00", "")   # offsets are not a known form
    assert got[5] == ("nope", "")
    assert got[6] == ("—", "")


def test_run_dates_show_time(spark):
    vals = ["2024-01-05T08:03:00", "2024-01-05 08:03:00.5", "2024-01-05", "2024-01-05T25:00:00"]
    disp, rel = dates.fmt_run_date(F.col("v"), AS_OF)
    got = [r[0] for r in one_col(spark, vals).select(disp).collect()]
    assert got == ["Jan 5, 2024  08:03", "Jan 5, 2024  08:03", "Jan 5, 2024  00:00", "Jan 5, 2024  00:00"]


def test_extra_last_wins_and_default(spark):
    df = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3")],), ([],)],
                               "e array<struct<key:string,value:string>>")
    got = df.select(nested.extra("e", "a"), nested.extra("e", "zz")).collect()
    assert [tuple(r) for r in got] == [("3", ""), ("", "")]


def test_lenient_json_list(spark):
    df = one_col(spark, ["", '["Q1","Q2"]', "[oops", '"scalar"', "5", None])
    got = [r[0] for r in df.select(nested.lenient_json_list(F.col("v"))).collect()]
    assert got == [[], ["Q1", "Q2"], [], [], [], []]


def test_config_from_params_first_position_last_value(spark):
    df = one_col(spark, ['[{"name":"h","value":3},{"name":"m","value":"fast"},{"name":"h","value":7}]', "[]"])
    p = F.from_json("v", "array<struct<name:string,value:variant>>")
    got = [r[0] for r in df.select(nested.params_to_config_json(p)).collect()]
    assert got == ['{"h":7,"m":"fast"}', "{}"]


def test_scale_conf_sizes_partitions():
    from fathom.session import scale_conf
    assert scale_conf(1 << 30)["spark.sql.shuffle.partitions"] == "8"
    assert scale_conf(100 * (1 << 40))["spark.sql.shuffle.partitions"] == "200000"
    assert scale_conf(10 * (1 << 40))["spark.sql.shuffle.partitions"] == str(10 * (1 << 40) // (256 << 20))


def test_cut_lineage_uses_the_session_checkpoint_dir(spark):
    from fathom.session import checkpoint_dir, cut_lineage
    d = checkpoint_dir(spark)
    assert d == spark.conf.get("spark.checkpoint.dir")
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 90
    assert "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
