"""Run metadata: component discovery, provenance fallback, load order."""

import json

from fathom.operators import runfiles


def _runs(spark, docs):
    rows = [(i, f"Q{i}", json.dumps(d)) for i, d in enumerate(docs)]
    return runfiles.parse_run_meta(spark.createDataFrame(rows, "run_key long, qid string, meta_json string"))


def test_object_or_list_and_extensions(spark):
    docs = [
        {"@id": "QA", "kernel": {"fdo:hasComponent": {"@id": "components/output/Predictions.CSV", "componentId": "Predictions.CSV"}}},
        {"kernel": {"fdo:hasComponent": [{"componentId": "x.TSV"}, {"componentId": "y.json"},
                                         {"@id": "components/output/predictions.parquet", "componentId": "predictions.parquet"}]}},
    ]
    d = runfiles.load_plan(_runs(spark, docs)).orderBy("run_key", "pos").collect()
    assert [(r["qid"], r["label"], r["ext"]) for r in d] == [
        ("QA", "Predictions.CSV", ".csv"), ("Q1", "x.TSV", ".tsv"), ("Q1", "predictions.parquet", ".parquet")]
    assert d[1]["url"].endswith("/doip/retrieve/Q1/output/x.TSV")        # default @id
    assert d[0]["url"].endswith("/doip/retrieve/QA/output/Predictions.CSV")


def test_load_plan_order_and_provenance(spark):
    doc = {"@id": "QR", "kernel": {"fdo:hasComponent": [
        {"@id": "components/output/predictions.parquet", "componentId": "predictions.parquet"},
        {"@id": "components/input/in.parquet", "componentId": "in.parquet"},
        {"@id": "components/input/in.csv", "componentId": "in.csv"},
        {"@id": "components/input/input_annotated.parquet", "componentId": "input_annotated.parquet"}]},
        "provenance": {"prov:used": [
            "https://h/in.parquet",                                   # already loaded as an input
            {"@id": "https://h/src.parquet?x=1", "schema:query": "SELECT 1"},
            "https://h/src.parquet",                                  # same file again: skipped
            "https://h/notes.csv",                                    # not Parquet
            {"@id": "https://h/plain.PARQUET/"}]}}
    plan = runfiles.load_plan(_runs(spark, [doc])).orderBy("stage", "pos").collect()
    assert [(r["stage"], r["label"]) for r in plan] == [
        (0, "in.parquet"), (1, "src.parquet (filtered)"), (1, "plain.PARQUET"), (2, "predictions.parquet")]
    assert plan[1]["url"] == "https://h/src.parquet?x=1" and plan[1]["query"] == "SELECT 1"


def test_gates(spark):
    no_pred = {"kernel": {"fdo:hasComponent": [{"@id": "components/output/a.csv", "componentId": "a.csv"}]}}
    pred_input_csv = {"kernel": {"fdo:hasComponent": [
        {"@id": "components/input/predictions.csv", "componentId": "predictions.csv"}]}}
    assert runfiles.load_plan(_runs(spark, [no_pred, pred_input_csv])).count() == 0


def test_replay_and_staging(spark, tmp_path):
    from fathom.operators import manifest
    src = "/root/testdata/sf0.001/lineitem.parquet"
    total, head = runfiles.replay(spark, src, "SELECT l_orderkey FROM df WHERE l_quantity > 40", 7)
    n = spark.read.parquet(src).where("l_quantity > 40").count()
    assert total.first()["total_rows"] == n and head.count() == min(7, n)
    manifest.stage_inputs(spark, [(src, "input.parquet", "SELECT l_orderkey FROM df WHERE l_quantity > 40"),
                                  (src, "input2.parquet", "")], str(tmp_path / "stage"))
    assert spark.read.parquet(str(tmp_path / "stage/input.parquet")).count() == n
    assert spark.read.parquet(str(tmp_path / "stage/input2.parquet")).count() == spark.read.parquet(src).count()
    total, head = runfiles.replay(spark, src, "")       # without a query: the whole file, its first rows in order
    assert total.first()["total_rows"] == spark.read.parquet(src).count() and head.count() == 500


def test_a_later_source_of_a_name_is_tried(spark):
    rows = [(1, 0, 0, "in.parquet", "a"), (1, 1, 0, "in.parquet", "b"), (1, 1, 1, "in.parquet (filtered)", "c"), (1, 1, 2, "in.parquet", "d"), (1, 2, 1, "predictions.csv", "p"),
            (2, 0, 0, "in.parquet", "a"), (2, 2, 1, "predictions.csv", "gone")]
    plan = spark.createDataFrame([(*r, "q" if r[4] == "c" else "") for r in rows], "run_key long, stage int, pos int, label string, path string, query string")
    outcome = spark.createDataFrame([("b", "", "broken"), ("c", "", "not asked for"), ("c", "q", None), ("d", "", None), ("p", "", None)],
                                    "path string, query string, error string")
    got = {(r["run_key"], r["path"]): (r["status"], r["error"], r["shown"]) for r in runfiles.resolve_loaded(plan, outcome).collect()}
    assert got == {(1, "a"): ("failed", "not found", True), (1, "b"): ("failed", "broken", True), (1, "c"): ("ok", None, True), (1, "d"): ("skipped", None, True),
                   (1, "p"): ("ok", None, True), (2, "a"): ("failed", "not found", False), (2, "gone"): ("failed", "not found", False)}


def test_load_report_keeps_other_files(spark):
    doc = {"@id": "QR", "kernel": {"fdo:hasComponent": [
        {"@id": "components/input/in.parquet", "componentId": "in.parquet"},
        {"@id": "components/output/predictions.csv", "componentId": "predictions.csv"}]}}
    plan = runfiles.load_plan(_runs(spark, [doc]))
    loaded = spark.createDataFrame([(0, 0, 0, "HTTP 404")], "run_key long, stage int, pos int, error string")
    rep = {r["label"]: r["status"] for r in runfiles.load_report(plan, loaded).collect()}
    assert rep == {"in.parquet": "failed", "predictions.csv": "ok"}
