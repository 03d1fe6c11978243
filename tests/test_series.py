"""Dense positions and series alignment."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.operators import position, series


def test_dense_position_equals_row_number(spark):
    random.seed(7)
    data = [(("hot" if random.random() < 0.4 else f"g{random.randint(0, 5)}"), random.randint(0, 50), i)
            for i in range(3000)]
    df = spark.createDataFrame(data, "g string, k long, id long")
    got = position.dense_position(df, ["g"], ["k", "id"], n_buckets=7, max_group_rows=0)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    a = sorted((r["id"], r["row_pos"]) for r in got.collect())
    b = sorted((r["id"], r["rn"]) for r in ref.collect())
    assert a == b
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the rows are windowed per (group, bucket); only the small count table is windowed per group
    assert "SinglePartition" not in plan


def test_dense_position_splits_a_hot_order_value(spark):
    # one leading order value holds 40 % of a hot group that itself holds 60 % of the rows
    data = [("hot", 5 if i % 5 < 2 else i % 97, i) for i in range(4000)] + [("cold", i % 13, i) for i in range(4000, 6000)]
    df = spark.createDataFrame(data, "g string, k long, id long")
    got = position.dense_position(df, ["g"], ["k", "id"], n_buckets=8, max_group_rows=0)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    assert sorted((r["id"], r["row_pos"]) for r in got.collect()) == sorted((r["id"], r["rn"]) for r in ref.collect())
    # the case really is hot: the value 5 repeats among the cut points, so it is split by id
    cuts = df.agg(F.approx_percentile(F.col("k").cast("double"), [i / 8 for i in range(1, 8)], 10000)).first()[0]
    assert cuts.count(5.0) > 1


def test_dense_position_sampled_cuts_nulls_nan_and_cap(spark):
    # 20k rows: cut points come from a sample; null and NaN keys, a value
    # holding a third of the rows, and more buckets asked for than the cap
    random.seed(11)
    data = []
    for i in range(20000):
        r = random.random()
        k = None if r < 0.05 else float("nan") if r < 0.1 else 3.0 if r < 0.43 else float(random.randint(0, 500))
        data.append(("g" if i % 4 else "h", k, i))
    df = spark.createDataFrame(data, "g string, k double, id long")
    got = position.dense_position(df, ["g"], ["k", "id"], n_buckets=position.MAX_BUCKETS + 100, max_group_rows=0)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    assert sorted((r["id"], r["row_pos"]) for r in got.collect()) == sorted((r["id"], r["rn"]) for r in ref.collect())
    got16 = position.dense_position(df, ["g"], ["k", "id"], n_buckets=16, max_group_rows=0)
    assert sorted((r["id"], r["row_pos"]) for r in got16.collect()) == sorted((r["id"], r["rn"]) for r in ref.collect())


def test_dense_position_stable_across_shuffle_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    res = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        res.append(sorted((r["event_id"], r["row_pos"]) for r in
                          position.dense_position(df, ["event_type"], ["ts", "event_id"], max_group_rows=0).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1]
    per = {}
    for r in position.dense_position(df, ["event_type"], ["ts", "event_id"]).collect():
        per.setdefault(r["event_type"], []).append(r["row_pos"])
    for v in per.values():
        assert sorted(v) == list(range(1, len(v) + 1))


def test_file_row_numbers(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(str(tmp_path / f"d/part{i}"))
    df = spark.read.parquet(str(tmp_path / "d/part0"), str(tmp_path / "d/part1"), str(tmp_path / "d/part2"))
    got = sorted((r["id"], r["row_num"]) for r in position.file_row_numbers(df).collect())
    assert got == [(i, i + 1) for i in range(30)]


def _files(spark):
    x = [("x", 1, "0.5", "a"), ("x", 2, "1.7", "b"), ("x", 3, "1.2", "c"), ("x", 4, "nan", "d"), ("x", 5, "4", "e")]
    y = [("y", 1, None, "10"), ("y", 2, None, ""), ("y", 3, None, "30"), ("y", 4, None, "40"),
         ("y", 5, None, "50"), ("y", 6, None, "60")]
    return spark.createDataFrame(x + y, "file_id string, row_pos long, xv string, v string")


def test_labels_points_and_sparse(spark):
    f = _files(spark)
    xr, yr = f.where("file_id = 'x'"), f.where("file_id = 'y'")
    labels = series.position_labels(xr, "xv", "v")
    assert sorted(tuple(r) for r in labels.collect()) == [(0, "a"), (1, "c"), (4, "e")]  # 1.7 -> 1, last wins
    sr = yr.select(F.lit("y: v").alias("series"), "row_pos", "v").join(xr.select("row_pos", "xv"), "row_pos")
    pts = series.series_points(sr, "xv", "v")
    # position 1 gets rows 2 ('' gap) and 3 ('30'): the last row wins
    assert sorted(tuple(r) for r in pts.collect()) == [("y: v", 0, "10"), ("y: v", 1, "30"), ("y: v", 4, "50")]
    out = series.sparse_align(labels, pts, ["y: v"])
    assert sorted((r["pos"], r["category"], r["y"]) for r in out.collect()) == [(0, "a", "10"), (1, "c", "30"), (4, "e", "50")]


def test_pairs_zip_and_profile(spark):
    f = _files(spark)
    xr, yr = f.where("file_id = 'x'"), f.where("file_id = 'y'")
    pairs = series.numeric_pairs(yr, xr, "v", "xv")
    assert pairs.count() == 5                      # cut to the shorter file
    z = series.category_zip(xr, yr, "v", "v")
    assert sorted((r["row_pos"], r["x"], r["y"]) for r in z.collect())[1] == (2, "b", None)
    prof = {r["key"]: r for r in series.column_profile(f, ["xv", "v"]).collect()}
    assert prof["x: xv"]["is_numeric"] is False    # 'nan' text fails the strict test
    assert prof["y: v"]["is_numeric"] is True and prof["y: v"]["n_gaps"] == 1


def test_axis_labels_of_another_file_nulls_and_booleans(spark):
    x = spark.createDataFrame([("x", 1, 0.5, True), ("x", 2, 1.5, None), ("x", 3, 1.9, False), ("x", 4, None, True)], "file_id string, row_pos long, xv double, b boolean")
    y = spark.createDataFrame([("y", 1, 10), ("y", 2, None), ("y", 3, 30)], "file_id string, row_pos long, v long")
    assert sorted(tuple(r) for r in series.category_axis(x, y, "xv").collect()) == [(1, "0.5", True), (2, "1.5", True), (3, "1.9", True), (4, "nan", False)]
    assert sorted(tuple(r) for r in series.position_labels(x, "xv", "v", y).collect()) == [(0, "10"), (1, "30")]
    assert sorted(tuple(r) for r in series.position_labels(x, "xv", "xv").collect()) == [(0, "0.5"), (1, "1.9")]
    prof = {r["column"]: r["is_numeric"] for r in series.column_profile(x, ["xv", "b"]).collect()}
    assert prof == {"xv": True, "b": True}
    assert [r["n"] for r in x.orderBy("row_pos").select(series.numeric_of(x, "b").alias("n")).collect()] == [1.0, None, 0.0, 1.0]


def test_dense_position_text_key_on_both_plans(spark):
    rows = [(("hot" if i % 3 else "g") if i % 50 else None, None if i % 41 == 0 else "a" if i % 4 == 0 else chr(98 + i % 20) * (i % 3 + 1), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k string, id long")
    for desc in (set(), {"k"}):
        o = F.col("k").desc() if desc else F.col("k").asc()
        want = sorted((r["id"], r["rn"]) for r in df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(o, "id"))).collect())
        for limit in (None, 0):
            got = position.dense_position(df, ["g"], ["k", "id"], descending=desc, max_group_rows=limit, total_col="n")
            assert sorted((r["id"], r["row_pos"]) for r in got.collect()) == want


def test_temporal_x_is_numeric(spark):
    import datetime as dt
    rows = [("f", i + 1, dt.datetime(2024, 1, 1, 0, 0, i), str(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "file_id string, row_pos long, t timestamp, v string")
    prof = {r["column"]: r["is_numeric"] for r in series.column_profile(df, ["t", "v"]).collect()}
    assert prof == {"t": True, "v": True}
    pairs = sorted(tuple(r) for r in series.numeric_pairs(df, None, "v", "t").select("row_pos", "x").collect())
    base = 1704067200 * 10 ** 6
    assert pairs == [(1, float(base)), (2, float(base + 10 ** 6)), (3, float(base + 2 * 10 ** 6))]


def test_dense_position_many_hot_values_and_signed_zero(spark):
    # a leading key with few distinct values (all hot for 64 buckets), one of
    # them holding a third of the rows, and -0.0 next to 0.0
    random.seed(21)
    data = []
    for i in range(12000):
        k = 0.0 if i % 3 == 0 else float(random.randint(1, 20))
        if i % 7 == 0:
            k = -0.0
        data.append(("g", k, random.randint(0, 10 ** 6) * 10000 + i))
    df = spark.createDataFrame(data, "g string, k double, id long")
    got = position.dense_position(df, ["g"], ["k", "id"], n_buckets=64, max_group_rows=0)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    assert sorted((r["id"], r["row_pos"]) for r in got.collect()) == sorted((r["id"], r["rn"]) for r in ref.collect())


def test_dense_position_total_on_both_plans(spark):
    df = spark.createDataFrame([(g, float(i % 5), i) for i in range(300) for g in (["a"] if i % 3 else ["b", None])],
                               "g string, k double, id long")
    want = sorted((r["g"] or "", r["n"]) for r in df.groupBy("g").count().withColumnRenamed("count", "n").collect())
    for rows in (None, 0):
        got = position.dense_position(df, ["g"], ["k", "id"], n_buckets=4, total_col="n", max_group_rows=rows)
        assert sorted({((r["g"] or ""), r["n"]) for r in got.collect()}) == want
        assert got.where("row_pos > n").count() == 0


def test_dense_position_buckets_are_balanced(spark, monkeypatch):
    # exact is not enough: a hot group with a hot order value must spread
    # over many window partitions of about even size
    cap = {}
    orig = position.join_null_safe

    def spy(left, right, keys, how="left"):
        if "_b" in keys:
            cap["numbered"] = left
        return orig(left, right, keys, how)
    monkeypatch.setattr(position, "join_null_safe", spy)
    n = 40000
    df = (spark.range(n).withColumn("g", F.when(F.col("id") % 4 != 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")))
          .withColumn("k", F.when((F.col("g") == "hot") & (F.col("id") % 5 < 2), F.lit(7.0))
                      .otherwise((F.col("id") * 7919 % 100003).cast("double"))))
    position.dense_position(df, ["g"], ["k", "id"], n_buckets=16, max_group_rows=0)
    sizes = cap["numbered"].where("g = 'hot'").groupBy("_b", "_sb").count()
    r = sizes.agg(F.count("*").alias("parts"), F.max("count").alias("largest")).first()
    even = 30000 / 16
    assert r["parts"] >= 12 and r["largest"] <= 3 * even, (r["parts"], r["largest"])
