"""Run requests -> validated manifests and payloads."""

import json

from pyspark.sql import functions as F

from fathom.operators import manifest

SCHEMA = ("request_id string, model_image string, model_tag string, config string, "
          "inputs array<struct<data_path:string,target_name:string,sql:string>>")


def _req(spark, rows):
    return manifest.validate(spark.createDataFrame(rows, SCHEMA))


def test_names_sql_and_payload(spark, tmp_path):
    rows = [("r1", "img", None, ' {"b": 1, "a": "x", "c": 3} ',
             [("s3://d/one.parquet", None, "-- only a comment"),
              ("s3://d/two", None, "  -- note\nSELECT * FROM df"),
              ("s3://d/three.csv", " custom.csv ", "")])]
    r = _req(spark, rows).collect()[0]
    assert r["target_names"] == ["input.parquet", "input2", "custom.csv"]
    assert r["effective_sql"] == ["", "  -- note\nSELECT * FROM df", ""]
    assert (r["n_datasets"], r["n_transforms"], r["effective_tag"]) == (3, 1, "latest")
    assert r["config_summary"] == "b: 1, a: x" and r["reasons"] == []
    out = str(tmp_path / "payloads")
    manifest.write_payloads(_req(spark, rows), out)
    got = json.loads(spark.read.json(out).select("payload").first()[0])
    assert got == {"parameters": {
        "input_data_files": [["s3://d/one.parquet", "input.parquet"], ["s3://d/two", "input2"],
                             ["s3://d/three.csv", "custom.csv"]],
        "model_image": "img", "model_tag": "latest", "config_json": '{"b": 1, "a": "x", "c": 3}',
        "data_transformation_sql": ["", "  -- note\nSELECT * FROM df", ""]}}


def test_rejects(spark):
    rows = [("dup", "img", "v1", "{}", [("a/x.parquet", None, ""), ("b/y.parquet", " input.parquet", "")]),
            ("none", None, "v1", "{bad", []),
            ("cfg", "img", "v1", "", [("a", None, "")])]
    got = {r["request_id"]: r for r in _req(spark, rows).collect()}
    assert got["dup"]["reasons"] == [manifest.DUP_NAMES] and got["dup"]["config_summary"] == "Configured"
    assert got["none"]["reasons"] == [manifest.NO_DATASET, manifest.NO_MODEL, manifest.BAD_JSON]
    assert got["cfg"]["reasons"] == [manifest.BAD_JSON] and got["cfg"]["config_summary"] == manifest.NOT_CONFIGURED


def test_has_sql_lines(spark):
    cases = {"": False, "   ": False, "-- a": False, "  -- a\n\t-- b": False, "-- a\nSELECT 1": True, "-x": True, "\n\nselect": True}
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    assert [r[0] for r in df.select(manifest.has_sql(F.col("v"))).collect()] == list(cases.values())


def test_config_summary_cases(spark):
    cases = {'{"a": true, "b": 2.0}': "a: True, b: 2.0", '{"c": null, "d": 1.50}': "c: None, d: 1.5", '{"e": 12, "f": "s", "g": 1}': "e: 12, f: s",
             '{"h": false}': "h: False", "[1, 2]": "Not configured yet", '"text"': "Not configured yet", "{}": "Configured", '  {"x": 1e3}  ': "x: 1000.0"}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert [r[0] for r in df.select(manifest.config_summary(F.col("c"))).collect()] == list(cases.values())


def test_payloads_leave_other_columns_alone(spark, tmp_path):
    # a column that is no part of the payload is not computed for it
    rows = [("r1", "img", "v1", "{}", [("a/x.csv", None, "")]), ("bad", None, "v1", "{}", [("a/x.csv", None, "")])]
    checked = _req(spark, rows).withColumn("config_summary", F.raise_error(F.lit("not asked for")).cast("string"))
    out = str(tmp_path / "payloads")
    manifest.write_payloads(checked, out)
    assert [r[0] for r in spark.read.json(out).select("request_id").collect()] == ["r1"]


def test_config_text_is_read_once(spark):
    # not once more for every use of a value
    df = spark.createDataFrame([('{"a": 1}',)], "c string").select(manifest.config_summary(F.col("c")).alias("s"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert df.first()[0] == "a: 1"


def test_reasons_over_nulls(spark):
    rows = [("null", None, None, None, None), ("twice", "img", "v1", "{}", [("a", "x", ""), ("b", "x ", None)]),
            ("gap", "img", "v1", "{}", [(None, None, None), ("b.csv", None, "-- c")])]
    got = {r["request_id"]: (r["reasons"], r["target_names"], r["effective_sql"]) for r in _req(spark, rows).collect()}
    assert got == {"null": ([manifest.NO_MODEL, manifest.BAD_JSON], None, None),
                   "twice": ([manifest.DUP_NAMES], ["x", "x"], ["", ""]), "gap": ([], ["input", "input2.csv"], ["", ""])}


def test_requests_from_tables(spark, tmp_path):
    from fathom.sources import bindings
    li = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
          "l_extendedprice double, l_returnflag string")
    spark.createDataFrame([(1, 5), (1, 5), (2, 6), (None, 7)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 9, 1, 3, 1.0, 2.0, "R"), (1, 8, 1, 1, 1.0, 2.0, "N"), (1, 7, 1, 1, None, 2.0, "A"), (1, 8, 1, 1, 1.0, 2.0, "N"),
                           (None, 4, 1, 1, 1.0, 2.0, "N")], li).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(((r["o_orderkey"], [(i["data_path"].rsplit("/", 1)[1], i["target_name"]) for i in r["inputs"]])
                  for r in bindings.requests(spark, str(tmp_path)).collect()), key=str)
    one = (1, [("part7.parquet", None), ("part8", None), ("part8", None), ("part9.parquet", " input.parquet ")])
    assert got == [one, one, (2, []), (None, [])]
