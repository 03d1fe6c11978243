"""Incremental catalogue ingest gives the batch result."""

import json

from fathom.operators import catalog
from fathom.sources import feed
from fathom.streaming import catalogue_stream


def test_stream_equals_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    for i in range(3):
        reply = {"success": True, "result": {"results": [
            {"title": f"d{i}{j}", "notes": "n", "url": "", "metadata_created": "2024-01-01",
             "groups": [{"name": "type-raw-data"}], "extras": [{"key": "qid", "value": f"Q{i}{j}"}],
             "resources": [{"name": "x.parquet", "url": f"u{i}{j}", "format": "PARQUET", "description": "", "size": 1}]}
            for j in range(4)]}}
        (landing / f"r{i}.json").write_text(json.dumps(reply))
    (landing / "bad.json").write_text(json.dumps({"success": False, "error": "x"}))
    out = str(tmp_path / "out")
    q = catalogue_stream.start_publish(spark, str(landing), out, "processed_datasets",
                                       checkpoint=str(tmp_path / "ck"), trigger_once=True)
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{out}/processed_datasets").drop("batch_id").collect())
    batch_pk = feed.packages(feed.read_feed(spark, str(landing)))
    ok, _ = catalog.split_rejects(catalog.processed_datasets(batch_pk))
    want = sorted(tuple(r) for r in catalog.publish(ok, "processed_datasets").collect())
    assert got == want and len(got) == 12
    # the failed reply is kept, not lost
    bad = spark.read.parquet(f"{out}/feed_rejects").collect()
    assert [(r["src"].rsplit("/", 1)[1], r["error"]) for r in bad] == [("bad.json", "x")]


def test_stream_of_one_table_keeps_its_rejects(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    package = {"title": "d", "notes": "n", "url": "", "metadata_created": "2024-01-01", "groups": [{"name": "type-raw-data"}],
               "extras": [{"key": "qid", "value": "Q1"}], "resources": [{"name": "x.parquet", "url": "u", "format": None, "description": "", "size": 1}]}
    (landing / "r.json").write_text(json.dumps({"success": True, "result": {"results": [package]}}))
    out = str(tmp_path / "out")
    q = catalogue_stream.start_publish(spark, str(landing), out, "processed_datasets", checkpoint=str(tmp_path / "ck"), trigger_once=True)
    q.awaitTermination(120)
    assert list((tmp_path / "out/processed_datasets").rglob("*.parquet")) == []
    assert {r["kind"] for r in spark.read.parquet(f"{out}/rejects").collect()} == {"processed_datasets"}


def test_stream_all_tables_one_read(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    reply = {"success": True, "result": {"results": [
        {"title": f"d{j}", "notes": "n", "url": "", "metadata_created": "2024-01-01",
         "groups": [{"name": "type-raw-data"}], "extras": [{"key": "qid", "value": f"Q{j}"}],
         "resources": [{"name": "x.parquet", "url": f"u{j}", "format": "PARQUET" if j else None,
                        "description": "", "size": 1}]}
        for j in range(4)]}}
    (landing / "r.json").write_text(json.dumps(reply))
    out = str(tmp_path / "out")
    q = catalogue_stream.start_publish_all(spark, str(landing), out, checkpoint=str(tmp_path / "ck"),
                                           trigger_once=True)
    q.awaitTermination(120)
    assert q.exception() is None
    ok = spark.read.parquet(f"{out}/processed_datasets")
    bad = spark.read.parquet(f"{out}/rejects").where("kind = 'processed_datasets'")
    assert ok.count() + bad.count() == 4 and bad.count() == 1
    assert "batch_id" in ok.columns


def test_replayed_batch_replaces_its_partition(spark, tmp_path):
    # a micro-batch written twice (a retry after a failure) leaves one copy;
    # another batch id is added next to it
    from fathom.sources import sinks
    landing = tmp_path / "landing"
    landing.mkdir()
    reply = {"success": True, "result": {"results": [
        {"title": f"d{j}", "notes": "n", "url": "", "metadata_created": "2024-01-01",
         "groups": [{"name": "type-raw-data"}], "extras": [{"key": "qid", "value": f"Q{j}"}],
         "resources": [{"name": "x.parquet", "url": f"u{j}", "format": "PARQUET", "description": "", "size": 1}]}
        for j in range(3)]}}
    (landing / "r.json").write_text(json.dumps(reply))
    pk = feed.packages(feed.read_feed(spark, str(landing)))
    out = str(tmp_path / "out")
    sinks.publish_catalogue(pk, out, partition={"batch_id": 0})
    sinks.publish_catalogue(pk, out, partition={"batch_id": 0})      # replay
    assert spark.read.parquet(f"{out}/processed_datasets").count() == 3
    sinks.publish_catalogue(pk, out, partition={"batch_id": 1})
    got = spark.read.parquet(f"{out}/processed_datasets")
    assert sorted((r["batch_id"], r["n"]) for r in got.groupBy("batch_id").count().withColumnRenamed("count", "n")
                  .collect()) == [(0, 3), (1, 3)]
