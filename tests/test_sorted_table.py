"""Sorted tables and the trigram index: whole results, few files read."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import browse, search_index
from fathom.sources import bindings, sinks, sorted_table

SF = "/root/testdata/sf0.001"


def test_pages_and_lookups_read_few_files(spark, tmp_path):
    rng = random.Random(3)
    # a third of the rows have one key, a few have none
    rows = [(None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{rng.randrange(200):03d}", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "key string, id long").repartition(7)
    root = str(tmp_path / "t")
    sorted_table.write_sorted(df, root, ["key desc", "id"], ("key",), rows_per_file=100)
    want = sorted(rows, key=lambda r: r[1])
    want = sorted((r for r in want if r[0] is not None), key=lambda r: r[0], reverse=True) + [r for r in want if r[0] is None]
    assert sorted_table.index_of(spark, root).count() > 30
    for number, size in ((1, 10), (77, 10), (250, 20), (251, 20), (3, 1700), (0, 5)):
        got = sorted_table.page_at(spark, root, number, size)
        at = size * (max(1, number) - 1)
        assert [(r["key"], r["id"]) for r in got.orderBy("_position").collect()] == want[at:at + size]
        assert len(got.inputFiles()) <= 2 + size // 50
    found = sorted_table.rows_with(spark, root, "key", ["k007", "k150", "absent", "zzz", None, "k007"])
    assert sorted(map(tuple, found.collect())) == sorted(r for r in rows if r[0] in ("k007", "k150"))
    assert len(found.inputFiles()) <= 7
    hot = sorted_table.rows_with(spark, root, "key", ["hot"])
    assert hot.count() == sum(r[0] == "hot" for r in rows) and len(hot.inputFiles()) > 10     # a hot key spans files
    places = sorted_table.located(spark, root).where("id in (5, 6, 4999)").select("_range", "_row")
    some = sorted_table.rows_at(spark, root, places)
    assert sorted(r["id"] for r in some.collect()) == [5, 6, 4999] and len(some.inputFiles()) <= 3


def test_five_ids_in_one_read(spark, tmp_path):
    sc, root = bindings.sidecars(spark, SF).select("path", "profile"), str(tmp_path / "sidecars")
    sinks.write_sidecar_table(sc, root, rows_per_file=5)
    assert sorted_table.index_of(spark, root).count() > 5
    got = sinks.lookup_sidecars(spark, root, ["q3", "Q12", "Qabc", "", "Q9999999999"])
    assert {r["profile"]["name"].split()[1] for r in got.collect()} == {"3", "12"} and len(got.inputFiles()) <= 5
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_bloom_filters_are_written(spark, tmp_path):
    import pyarrow.parquet as pq
    root = str(tmp_path / "t")
    sorted_table.write_sorted(spark.range(100).selectExpr("cast(id as string) key"), root, ["key"], ("key",))
    meta = pq.ParquetFile(next((tmp_path / "t" / "rows").glob("*.parquet"))).metadata
    assert meta.row_group(0).column(0).statistics is not None
    plain = str(tmp_path / "p")
    sorted_table.write_sorted(spark.range(100).selectExpr("cast(id as string) key"), plain, ["key"])
    size = lambda r: sum(f.stat().st_size for f in (tmp_path / r / "rows").glob("*.parquet"))
    assert size("t") > size("p")


def test_empty_table(spark, tmp_path):
    none, root = spark.createDataFrame([], "key string, id long"), str(tmp_path / "t")
    sorted_table.write_sorted(none, root, ["key", "id"])
    assert sorted_table.page_at(spark, root, 1, 10).collect() == sorted_table.rows_with(spark, root, "key", ["a"]).collect() == []
    index = str(tmp_path / "i")
    search_index.build(none, index, ["key", "id"], ["key"])
    assert [search_index.search(spark, index, n, ["key"]).collect() for n in ("", "ab", "abc")] == [[], [], []]


TEXTS = ["Plate of STEEL", "steel plate", "", None, "ab", "abc", "aBCabc", "100%_done", "line\nbreak steel", "Ölpreis é🙂x y", "st eel", "ste", "eel", "\u0130stanbul", "x" * 5000 + "needle"]
NEEDLES = ["steel", "STEEL", "ab", "abc", "%_d", "\nbr", "é🙂x", "ölp", "zzz", "steel plates", "needle", "xxxxx", "", None, "eelste", "\u0130st", "tee"]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rows = [(i, TEXTS[i % len(TEXTS)], TEXTS[(i // 7) % len(TEXTS)] if i % 2 else f"row {i}") for i in range(120)]
    df, root = spark.createDataFrame(rows, "id long, name string, notes string"), str(tmp_path_factory.mktemp("index"))
    search_index.build(df, root, ["id desc"], ["name", "notes"], rows_per_file=10)
    return df, root


@pytest.mark.parametrize("needle", NEEDLES)
def test_search_like_the_scan(spark, texts, needle):
    df, root = texts
    want = [r["id"] for r in browse.search(df, needle, ["name", "notes"]).orderBy(F.col("id").desc()).collect()]
    got = search_index.search(spark, root, needle, ["name", "notes"])
    assert [r["id"] for r in got.orderBy("_range", "_row").collect()] == want
    few = search_index.search(spark, root, needle, ["notes"])
    assert {r["id"] for r in few.collect()} == {r["id"] for r in browse.search(df, needle, ["notes"]).collect()}


def test_search_reads_what_its_grams_name(spark, texts):
    df, root = texts
    assert search_index.candidates(spark, root, "ab") is None           # too short: a scan
    assert search_index.candidates(spark, root, "row") is None          # nearly everywhere
    one = search_index.search(spark, root, "row 64", ["name", "notes"])
    assert [r["id"] for r in one.collect()] == [64] and len(one.inputFiles()) == 1
    assert search_index.search(spark, root, "qqq", ["name"]).inputFiles() == []
    hits = search_index.candidates(spark, root, "row 64")
    every = sorted_table.index_of(spark, f"{root}/postings").count()
    assert 0 < len(hits.inputFiles()) <= 4 < every
