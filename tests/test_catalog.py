"""Package feed and catalogue projections on literal replies (FIXTURES §2)."""

import json

import pytest
from pyspark.sql import functions as F

from fathom.operators import browse, catalog, runs
from fathom.sources import feed, sinks


def pkg(title="t", notes="n", url="", groups=("type-raw-data",), extras=(), resources=()):
    return {"title": title, "notes": notes, "url": url, "metadata_created": "2024-01-05T08:30:00",
            "groups": [{"name": g} for g in groups],
            "extras": [{"key": k, "value": v} for k, v in extras],
            "resources": [dict(zip(("name", "url", "format", "description", "size"), r)) for r in resources]}


def write_replies(tmp_path, replies):
    d = tmp_path / "feed"
    d.mkdir()
    for i, r in enumerate(replies):
        (d / f"reply{i:03d}.json").write_text(json.dumps(r, indent=2))
    return str(d)


@pytest.fixture()
def pkgs(spark, tmp_path):
    replies = [
        {"success": True, "result": {"results": [
            pkg("A", extras=[("qid", "Q1"), ("status", "x"), ("status", "y")],
                resources=[("a.csv", "u0", "CSV", "Input file", 5), ("a.parquet", "u1", "parquet", "Output file", 10),
                           ("b.parquet", "u2", "PARQUET", "Output file", 20)]),
            pkg("B", extras=[], resources=[]),
            pkg("C", extras=[("qid", "Q3")], resources=[("c.csv", "u3", "CSV", "x", 1)]),
            pkg("D", extras=[("qid", "Q4")], resources=[("d", "u4", None, "x", 1)]),
        ]}},
        {"success": False, "error": "boom"},
        {"success": True, "result": {"results": []}},
        {"success": True, "result": {"results": [
            pkg("M1", url="https://git/x", groups=("type-model",), extras=[("docker_image", "ghcr.io/a/b")]),
            pkg("M2", groups=("type-model",), extras=[("docker_image", "ghcr.io/a/b"), ("model_qid", "Q9"),
                                                       ("model_parameters", '[{"name":"k","value":1}]')]),
            pkg("M3", groups=("type-model",), extras=[("docker_image", "docker.io/x"), ("model_parameters", "[oops")]),
            pkg("R1", groups=("type-model-run",), extras=[("qid", "Q7"), ("input_dataset_qids", '["Q1","Q404","Q3","Q1"]')],
                resources=[("o", "s3://x/run.log", "TXT", "Output file", 1)]),
            pkg("R2", groups=("type-model-run",), extras=[("qid", "q7"), ("input_dataset_qids", "[bad")]),
        ]}},
    ]
    env = feed.read_feed(spark, write_replies(tmp_path, replies))
    return env, feed.packages(env)


def test_feed_rejects_and_order(pkgs):
    env, p = pkgs
    assert [r["error"] for r in feed.feed_rejects(env).collect()] == ["boom"]
    titles = [r["title"] for r in p.orderBy("ord").collect()]
    assert titles == ["A", "B", "C", "D", "M1", "M2", "M3", "R1", "R2"]
    with pytest.raises(RuntimeError, match="boom"):
        feed.strict_packages(env)


def test_processed_and_raw(pkgs):
    _, p = pkgs
    ds = {r["name"]: r for r in catalog.processed_datasets(p).collect()}
    assert ds["A"]["data_path"] == "u1" and [c["name"] for c in ds["A"]["components"]] == ["a.parquet", "b.parquet"]
    assert ds["A"]["doip_url"].endswith("/doip/retrieve/Q1")
    assert ds["B"]["data_path"] == "" and ds["B"]["doip_url"] == "" and ds["B"]["qid"] == ""
    assert ds["C"]["components"] == []
    assert ds["D"]["reasons"] == ["resource format is null"]
    raw = {r["path"]: r for r in catalog.raw_datasets(p).collect()}
    assert raw["A"]["size_bytes"] == 10 and raw["A"]["reasons"] == []
    assert raw["B"]["size_bytes"] is None and raw["B"]["reasons"] == ["size_bytes is null"]
    ok, bad = catalog.split_rejects(catalog.raw_datasets(p))
    assert ok.count() + bad.count() == 4
    assert catalog.publish(ok, "raw_datasets").columns == ["path", "last_modified", "size_bytes"]


def test_models_git_repo_and_params(pkgs):
    _, p = pkgs
    m = {r["name"]: r for r in catalog.models(p).collect()}
    assert m["M1"]["git_repo"] == "https://git/x"
    assert m["M2"]["git_repo"] == "https://github.com/a/b" and m["M2"]["doip_url"].endswith("/Q9")
    assert m["M3"]["git_repo"] == "" and m["M3"]["reasons"] == ["model_parameters is not a JSON list"]
    assert len(m["M2"]["additional_properties"]) == 1 and m["M1"]["additional_properties"] == []
    with pytest.raises(ValueError):
        catalog.strict(catalog.models(p))


def test_runs_lists_lookup_and_enrichment(spark, pkgs):
    _, p = pkgs
    r = catalog.model_runs(p)
    got = {x["model_name"] + x["qid"]: x for x in r.collect()}
    assert got["Q7"]["output_files"] == ["s3://x/run.log"] and got["Q7"]["input_dataset_qids"] == ["Q1", "Q404", "Q3", "Q1"]
    assert got["q7"]["input_dataset_qids"] == []
    ids = spark.createDataFrame([("Q7",), ("nope",)], "run_id string")
    look = {x["run_id"]: x for x in catalog.lookup_runs(r, ids).collect()}
    assert look["Q7"]["found"] and look["Q7"]["run"]["qid"] == "Q7"   # first of the two case-variants in feed order
    assert not look["nope"]["found"]
    e = {x["qid"]: x for x in runs.enrich_runs(r, catalog.processed_datasets(p)).collect()}
    assert e["Q7"]["input_names"] == ["A", "Q404", "C", "A"]          # order and duplicates kept
    assert e["Q7"]["status"] == "completed" and e["Q7"]["log_url"] == "s3://x/run.log"
    assert e["q7"]["status"] == "" and e["q7"]["log_url"].endswith("/doip/retrieve/q7/output/run.log")
    assert e["Q7"]["status_cls"] == "bg-green-100 text-green-700"


def test_browse_paging_and_selection(spark, pkgs):
    _, p = pkgs
    ds = catalog.processed_datasets(p)
    first = [r["name"] for r in browse.page(ds, browse.name_a_to_z(), size=2).collect()]
    second = [r["name"] for r in browse.page(ds, browse.name_a_to_z(), size=2, number=2).collect()]
    assert first == ["A", "B"] and second == ["C", "D"]
    sel = spark.createDataFrame([("Q3",), ("Q3",), ("Q1",)], "qid string")
    assert sorted(r["name"] for r in browse.select_rows(ds, sel).collect()) == ["A", "C"]
    assert browse.type_filter(ds, "Dataset").count() == 4


def test_publish_catalogue_counts(spark, pkgs, tmp_path):
    _, p = pkgs
    out = str(tmp_path / "pub")
    sinks.publish_catalogue(p, out)
    for kind, total in (("raw_datasets", 4), ("processed_datasets", 4), ("models", 3), ("model_runs", 2)):
        ok = spark.read.parquet(f"{out}/{kind}").count()
        bad = spark.read.parquet(f"{out}/rejects").where(F.col("kind") == kind)
        assert ok + bad.select("ord").distinct().count() == total, kind   # one row per reason


def test_reject_reasons_match_table_rejects(pkgs):
    _, p = pkgs
    one_pass = sorted((r["kind"], r["reason"]) for r in catalog.reject_reasons(p).collect())
    per_table = []
    for kind, rows in (("raw_datasets", catalog.raw_datasets(p)), ("processed_datasets", catalog.processed_datasets(p)),
                       ("models", catalog.models(p)), ("model_runs", catalog.model_runs(p))):
        _, bad = catalog.split_rejects(rows)
        per_table += [(kind, reason) for r in bad.collect() for reason in r["reasons"]]
    assert one_pass == sorted(per_table)


def test_any_column_filter(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 12, "x%y"), ("c", 3, "Z")], "s string, n long, t string")
    assert [r["s"] for r in browse.any_column_filter(df, "12").collect()] == ["b"]
    assert [r["s"] for r in browse.any_column_filter(df, "%").collect()] == ["b"]
    assert [r["s"] for r in browse.any_column_filter(df, "z").collect()] == ["c"]
    assert browse.any_column_filter(df, "").count() == 3


def test_group_cap_is_ordered_top_k(pkgs):
    _, p = pkgs
    assert catalog.in_group(p, catalog.GROUP_DATASETS).count() == 4
    capped = catalog.in_group(p, catalog.GROUP_DATASETS, max_rows=2)
    assert [r["title"] for r in capped.collect()] == ["A", "B"]


@pytest.mark.parametrize("descending", [True, False])
def test_keyset_paging_walks_every_row_once(spark, descending):
    # 15 of 25 rows tie, two keys are null
    rows = [(i, None if i in (3, 9) else 7 if i % 5 < 3 else i) for i in range(25)]
    df = spark.createDataFrame(rows, "ord long, k long")
    order = [F.col("k").desc_nulls_last() if descending else F.col("k").asc_nulls_first(), F.col("ord")]
    want = [r["ord"] for r in df.orderBy(*order).collect()]
    got = [r for r in browse.page(df, order, size=4).collect()]
    while True:
        more = browse.page_after(df, F.col("k"), got[-1]["k"], got[-1]["ord"], descending, size=4).collect()
        got += more
        if len(more) < 4:
            break
    assert [r["ord"] for r in got] == want


def test_republish_replaces_old_rejects(pkgs, spark, tmp_path):
    from fathom.sources import sinks
    _, p = pkgs
    out = str(tmp_path / "pub")
    sinks.publish_catalogue(p, out)
    assert spark.read.parquet(f"{out}/rejects").count() > 0
    sinks.publish_catalogue(p.limit(0), out)
    assert list((tmp_path / "pub/rejects").rglob("*.parquet")) == []
    assert spark.read.parquet(f"{out}/raw_datasets").count() == 0
