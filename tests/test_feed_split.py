"""Replies split over tasks against the reader that takes a document whole."""

import json
import random

import pytest

from fathom.sources import feed, feed_split


def reply(rng, n, indent=None, **more):
    text = lambda: "".join(rng.choice('ab "\\{}[],:é\n') for _ in range(rng.randrange(12)))
    items = [{"title": f"{i} {text()}", "notes": text(), "extras": [{"key": text(), "value": text()} for _ in range(rng.randrange(3))],
              "groups": [], "resources": [{"name": "results", "url": text()}] * rng.randrange(3)} for i in range(n)]
    return json.dumps({"help": "see {\"results\": [", "success": True, "result": {"count": n, "facets": {}, "results": items, "tags": [{"results": [{"title": "no"}]}]}, **more},
                      indent=indent, ensure_ascii=rng.random() < 0.5)


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def rows(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: json.dumps(r, sort_keys=True))


def test_like_the_whole_document_reader(spark, tmp_path, small_splits):
    rng = random.Random(6)
    for k in range(4):
        (tmp_path / f"r{k}.json").write_text(reply(rng, 30 + k, indent=[None, 2][k % 2]) + "\n" * (k % 3))
    (tmp_path / "empty.json").write_text(reply(rng, 0))
    (tmp_path / "bad.json").write_text(json.dumps({"success": False, "error": 'x "results": [ {'}))
    (tmp_path / "none.json").write_text(json.dumps({"success": True, "result": None}))
    whole = feed.read_feed(spark, str(tmp_path))
    env, pkgs = feed_split.read_feed_split(spark, str(tmp_path))
    assert rows(pkgs) == rows(feed.packages(whole))
    assert rows(feed.feed_rejects(env)) == rows(feed.feed_rejects(whole))
    assert rows(env.select("src", "success", "error", "result.count")) == rows(whole.select("src", "success", "error", "result.count"))


def test_a_reply_is_read_by_many_tasks_in_order(spark, tmp_path, small_splits):
    (tmp_path / "big.json").write_text(json.dumps({"success": True, "result": {"results": [{"title": str(i)} for i in range(3000)]}}))
    pieces = feed_split.split_pieces(spark, str(tmp_path))
    assert pieces.select("block").distinct().count() > 20
    _, pkgs = feed_split.read_feed_split(spark, str(tmp_path))
    assert sorted((r["ord"]["pos"], r["title"]) for r in pkgs.collect()) == [(i, str(i)) for i in range(3000)]
