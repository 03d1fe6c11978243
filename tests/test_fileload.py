"""Loading run files: schemas, parts, recorded queries, bad files, column types."""

import pandas as pd
import pytest

from fathom.operators import fileload


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    pd.DataFrame({"a": [1.0, None, 3.5], "b": ["x", None, ""]}).to_parquet(root / "good.parquet")
    pd.DataFrame({"a": range(10), "x_auto_converted": range(10)}).to_parquet(root / "numbers.parquet")
    pd.DataFrame({"b": ["p", "q"]}).to_parquet(root / "narrow.parquet")
    spark.range(0, 5000, 1, 4).selectExpr("id", "cast(id AS string) AS t").write.parquet(str(root / "parts.parquet"))
    (root / "t.tsv").write_text("k\tv\n1\tx\n2\t\n")
    (root / "types.csv").write_text("i,d,b,s,g,m,_more\n1,1.5,true,x,,1,\n-2,2,False,2,nan,,\n")
    (root / "short.csv").write_text("a,b\n1\n2,3\n")
    (root / "wide.csv").write_text("a,b\n1,2\n1,2,3\n")
    (root / "bad.parquet").write_text("not a table")
    good = (root / "numbers.parquet").read_bytes()
    (root / "torn.parquet").write_bytes(good[:4] + b"\xff" * 60 + good[64:])
    (root / "ignored.csv").write_text("z\n1\n")
    return str(root)


def read(spark, store, *wanted):
    df = spark.createDataFrame([(p, "." + p.rsplit(".", 1)[1], q) for p, q in wanted], "path string, ext string, query string")
    rows, columns, outcome = fileload.read_files(spark, store, df)
    long = sorted((r["path"], r["query"], r["row_pos"], r["ordinal"], r["column"], r["value"]) for r in rows.collect())
    return long, {(r["path"], r["query"]): r["error"] for r in outcome.collect()}, rows, columns


def test_files_of_any_schema_bad_and_missing_ones(spark, store):
    names = ("good.parquet", "narrow.parquet", "t.tsv", "short.csv", "bad.parquet", "none.parquet", "wide.csv", "torn.parquet")
    long, errors, _, _ = read(spark, store, *[(n, "") for n in names])
    assert long == [
        ("good.parquet", "", 1, 0, "a", "1.0"), ("good.parquet", "", 1, 1, "b", "x"), ("good.parquet", "", 2, 0, "a", None), ("good.parquet", "", 2, 1, "b", None),
        ("good.parquet", "", 3, 0, "a", "3.5"), ("good.parquet", "", 3, 1, "b", ""), ("narrow.parquet", "", 1, 0, "b", "p"), ("narrow.parquet", "", 2, 0, "b", "q"),
        ("short.csv", "", 1, 0, "a", "1"), ("short.csv", "", 1, 1, "b", None), ("short.csv", "", 2, 0, "a", "2"), ("short.csv", "", 2, 1, "b", "3"),
        ("t.tsv", "", 1, 0, "k", "1"), ("t.tsv", "", 1, 1, "v", "x"), ("t.tsv", "", 2, 0, "k", "2"), ("t.tsv", "", 2, 1, "v", None)]
    assert [errors[n, ""] for n in ("good.parquet", "narrow.parquet", "t.tsv", "short.csv")] == [None] * 4
    assert errors["none.parquet", ""] == fileload.NOT_FOUND and errors["wide.csv", ""] == fileload.TOO_WIDE
    assert "footer" in errors["bad.parquet", ""].lower() or "READ_FILE" in errors["bad.parquet", ""]
    assert errors["torn.parquet", ""]


def test_parts_are_numbered_on(spark, store):
    _, errors, rows, _ = read(spark, store, ("parts.parquet", ""))
    got = [(r["row_pos"], int(r["value"])) for r in rows.where("column = 'id'").collect()]
    assert errors == {("parts.parquet", ""): None} and sorted(got) == [(i + 1, i) for i in range(5000)]


def test_large_text_file_over_many_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("n,t\n" + "".join(f"{i},text {i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        _, _, rows, _ = read(spark, str(tmp_path), ("big.csv", ""))
        assert sorted((r["row_pos"], int(r["value"])) for r in rows.where("ordinal = 0").collect()) == [(i + 1, i) for i in range(20_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_recorded_queries(spark, store):
    """Each (source, query) once, in the query's order; a bad one fails alone."""
    sorted_q, twice, bad = "SELECT a FROM df WHERE a > 6 ORDER BY a DESC", "SELECT a, a FROM df WHERE a = 1;", "SELECT nothing FROM df"
    long, errors, _, columns = read(spark, store, ("numbers.parquet", sorted_q), ("numbers.parquet", twice), ("numbers.parquet", bad), ("none.parquet", sorted_q), ("numbers.parquet", ""))
    assert [x[2:] for x in long if x[1] == sorted_q] == [(1, 0, "a", "9"), (2, 0, "a", "8"), (3, 0, "a", "7")]
    assert [x[2:] for x in long if x[1] == twice] == [(1, 0, "a", "1"), (1, 1, "a", "1")]
    assert len([x for x in long if x[1] == ""]) == 20
    assert errors["numbers.parquet", sorted_q] is None and "nothing" in errors["numbers.parquet", bad] and errors["none.parquet", sorted_q] == fileload.NOT_FOUND
    assert columns.where("query = ''").count() == 2


def test_filtered_rows_under_the_filtered_label(spark, store):
    plan = [(1, 1, 0, "numbers.parquet (filtered)", "numbers.parquet", "SELECT a, x_auto_converted FROM df WHERE a < 2", ".parquet"),
            (1, 2, 1, "predictions.csv", "short.csv", "", ".csv"), (2, 1, 0, "numbers.parquet (filtered)", "numbers.parquet", "SELECT * FROM nowhere", ".parquet"),
            (2, 1, 1, "numbers.parquet", "numbers.parquet", "", ".parquet"), (2, 2, 1, "predictions.csv", "short.csv", None, ".csv")]
    df = spark.createDataFrame(plan, "run_key long, stage int, pos int, label string, path string, query string, ext string")
    rows, columns, report = fileload.load_files(spark, df, store)
    got = sorted((r["row_pos"], r["column"], r["value"]) for r in rows.where("run_key = 1 AND label LIKE '%(filtered)'").collect())
    assert got == [(1, "a", "0"), (1, "x_auto_converted", "1"), (2, "a", "1"), (2, "x_auto_converted", "2")]
    assert sorted((r["run_key"], r["label"], r["status"]) for r in report.collect()) == [
        (1, "numbers.parquet (filtered)", "ok"), (1, "predictions.csv", "ok"), (2, "numbers.parquet", "ok"), (2, "numbers.parquet (filtered)", "failed"), (2, "predictions.csv", "ok")]
    assert rows.where("run_key = 2 AND label = 'numbers.parquet'").agg({"row_pos": "max"}).first()[0] == 10
    keys = sorted((r["run_key"], r["key"], r["type"], r["n_rows"]) for r in columns.collect())
    assert keys == [(1, "numbers.parquet (filtered): a", "bigint", 2), (1, "numbers.parquet (filtered): x_auto_converted", "bigint", 2),
                    (1, "predictions.csv: a", "bigint", 2), (1, "predictions.csv: b", "double", 2), (2, "numbers.parquet: a", "bigint", 10),
                    (2, "numbers.parquet: x_auto_converted", "bigint", 10), (2, "predictions.csv: a", "bigint", 2), (2, "predictions.csv: b", "double", 2)]


def test_column_types(spark, store):
    _, _, rows, columns = read(spark, store, ("types.csv", ""), ("good.parquet", ""))
    got = {(r["path"], r["column"]): (r["type"], r["n_rows"], r["n_gaps"], r["is_numeric"], r["low"], r["high"]) for r in fileload.file_profile(rows, columns).collect()}
    assert got == {("types.csv", "i"): ("bigint", 2, 0, True, -2.0, 1.0), ("types.csv", "d"): ("double", 2, 0, True, 1.5, 2.0),
                   ("types.csv", "b"): ("boolean", 2, 0, False, None, None), ("types.csv", "s"): ("string", 2, 0, False, 2.0, 2.0),
                   ("types.csv", "g"): ("double", 2, 2, False, got["types.csv", "g"][4], got["types.csv", "g"][5]), ("types.csv", "m"): ("double", 2, 1, True, 1.0, 1.0),
                   ("types.csv", "_more"): ("double", 2, 2, True, None, None),
                   ("good.parquet", "a"): ("double", 3, 1, True, 1.0, 3.5), ("good.parquet", "b"): ("string", 3, 2, False, None, None)}


def test_nothing_asked_for(spark, store):
    long, errors, _, columns = read(spark, store)
    assert (long, errors, columns.collect()) == ([], {}, [])


def test_no_file_content_in_a_row(spark, store):
    _, _, rows, _ = read(spark, store, ("parts.parquet", ""))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "Python" not in plan and "Window" not in plan
