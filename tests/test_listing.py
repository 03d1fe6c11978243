"""Listings, sidecars, shard paths."""

import json
import os

from pyspark.sql import functions as F

from fathom.operators import listing
from fathom.sources import listing as src
from fathom.sources import sinks


def test_shard_and_tag(spark):
    df = spark.createDataFrame([("Q7",), ("q12",), ("QQ12",), ("Q1234567",)], "q string")
    assert [r[0] for r in df.select(listing.shard_path(F.col("q"))).collect()] == [
        "00/00/07/Q7", "00/00/12/Q12", "00/00/12/QQ12", "12/34/56/Q1234567"]
    t = spark.createDataFrame([("img",), ("img:v1",), ("img:v1:2",), (None,)], "a string")
    assert [r[0] for r in t.select(listing.tag_after_colon(F.col("a"))).collect()] == ["", "v1", "2", ""]
    p = spark.createDataFrame([("a/b/Q5.fdo.json",), ("Q6.fdo.json",), ("a/x.parquet",)], "path string")
    assert [r[0] for r in p.select(listing.qid_from_path(F.col("path"))).collect()] == ["Q5", "Q6", "x.parquet"]


def _write_store(root):
    docs = {
        "00/00/05/Q5/Q5.fdo.json": {"@id": "Q5", "profile": {"name": "run five", "description": "d", "url": "img",
                                                              "softwareVersion": "1.0"},
                                    "kernel": {"modified": "2024-01-02T00:00:00", "fdo:hasComponent": [
                                        {"@id": "components/input/a.parquet", "componentId": "a.parquet"},
                                        {"@id": "components/output/predictions.csv", "componentId": "predictions.csv"},
                                        {"@id": "", "componentId": "skip.me"},
                                        {"@id": "other/c.txt", "componentId": "c.txt"}]},
                                    "provenance": {"prov:wasAttributedTo": "ghcr.io/x/y:v3",
                                                   "prov:used": ["s3://a.parquet", {"@id": "s3://b.parquet"}]}},
        "00/00/06/Q6/Q6.fdo.json": {"@id": "", "profile": {"name": "six"}, "kernel": {}},
    }
    for rel, doc in docs.items():
        path = os.path.join(root, rel)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as fh:
            json.dump(doc, fh, indent=2)
    with open(os.path.join(root, "00/00/05/Q5/Q5.parquet"), "wb") as fh:
        fh.write(b"x" * 10)


def test_listing_and_sidecars_from_files(spark, tmp_path):
    root = str(tmp_path / "store")
    _write_store(root)
    objs = src.list_objects(spark, root)
    raw = listing.raw_objects(objs).collect()
    assert [(r["path"], r["size_bytes"]) for r in raw] == [("00/00/05/Q5/Q5.parquet", 10)]
    sc = src.read_sidecars(spark, root)
    assert sc.count() == 2
    ds = {r["name"]: r for r in listing.datasets_from_sidecars(sc).collect()}
    five = ds["run five"]
    assert [c["name"] for c in five["components"]] == ["a.parquet", "predictions.csv", "c.txt"]
    assert five["data_path"] == "store://data/main/00/00/05/Q5/components/input/a.parquet"
    assert ds["six"]["doip_url"] == "" and ds["six"]["components"] == []
    run = {r["run_id"]: r for r in listing.runs_from_sidecars(sc).collect()}
    assert run["Q5"]["docker_tag"] == "v3"
    assert run["Q5"]["input_files"] == ["components/input/a.parquet"]
    assert run["Q5"]["output_files"] == ["components/output/predictions.csv"]
    models = {r["qid"]: r for r in listing.models_from_sidecars(sc).collect()}
    assert models["Q5"]["docker_image"] == "img" and models["Q5"]["docker_tag"] == "1.0"


def test_shard_lookup(spark, tmp_path):
    root = str(tmp_path / "store")
    _write_store(root)
    sc = src.read_sidecars(spark, root)
    ids = spark.createDataFrame([("q5",), ("Q404",)], "run_id string")
    got = {r["run_id"]: r for r in listing.lookup_sidecar_runs(sc, ids).collect()}
    assert got["q5"]["found"] and got["q5"]["model_name"] == "run five" and not got["Q404"]["found"]
    table = str(tmp_path / "sidecars")
    sinks.write_sidecar_table(sc.drop("provenance"), table)
    assert [r["profile"]["name"] for r in sinks.lookup_sidecars(spark, table, ["q5", "Q404", "", "no id"]).collect()] == ["run five"]
    assert sinks.lookup_sidecars(spark, table, []).collect() == []
