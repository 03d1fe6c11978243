"""Incremental upkeep: a package sent twice shows once, names update."""

import json

from fathom.operators import runs
from fathom.streaming import upkeep


def package(title, group, key, value, **extras):
    return {"title": title, "notes": "n", "url": "", "metadata_created": "2024-01-01", "groups": [{"name": group}],
            "extras": [{"key": k, "value": v} for k, v in {key: value, **extras}.items()],
            "resources": [{"name": "x.parquet", "url": "u", "format": "PARQUET", "description": "", "size": 1}]}


def land(folder, name, *packages):
    (folder / name).write_text(json.dumps({"success": True, "result": {"results": list(packages)}}))


def shown(spark, root, kind="processed_datasets"):
    return sorted((r["qid"], r["name"], r["batch_id"]) for r in upkeep.current(spark, root, kind).collect())


def test_stream_keeps_the_last_version(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "tables")
    landing.mkdir()
    data = lambda title, qid: package(title, "type-raw-data", "qid", qid)

    def run():
        q = upkeep.start_upkeep(spark, str(landing), root, ("processed_datasets",), str(tmp_path / "ck"), trigger_once=True, compact_every=2)
        q.awaitTermination(120)
        assert q.exception() is None
    land(landing, "a.json", data("one", "Q1"), data("two", "Q2"), data("one again", "Q1"), data("no id", ""), data("no id", ""))
    run()
    first = [("", "no id", 0), ("", "no id", 0), ("Q1", "one again", 0), ("Q2", "two", 0)]
    assert shown(spark, root) == first
    land(landing, "b.json", data("two, new", "Q2"), data("three", "Q3"))
    run()
    second = [("", "no id", 0), ("", "no id", 0), ("Q1", "one again", 0), ("Q2", "two, new", 1), ("Q3", "three", 1)]
    assert shown(spark, root) == second
    land(landing, "c.json", data("one, new", "Q1"))
    run()   # the third batch makes a base of the first two
    at = tmp_path / "tables" / "processed_datasets"
    assert sorted(p.name for p in (at / "changes").iterdir()) == ["batch_id=2"] and len(list((at / "bases").iterdir())) == 1
    assert shown(spark, root) == [x for x in second if x[0] != "Q1"][:2] + [("Q1", "one, new", 2)] + second[3:]


def test_replayed_batch_and_dead_compaction(spark, tmp_path):
    from fathom.sources import bindings
    pk, root = bindings.packages(spark, "/root/testdata/sf0.001"), str(tmp_path / "t")
    upkeep.merge_batch(pk, root, 0)
    want = shown(spark, root)
    upkeep.merge_batch(pk.limit(3), root, 1)
    upkeep.merge_batch(pk, root, 1)         # run again: replaces the first attempt
    assert [(q, n) for q, n, _ in shown(spark, root)] == [(q, n) for q, n, _ in want]
    assert {b for *_, b in shown(spark, root)} == {1}
    upkeep._versions(spark, f"{root}/processed_datasets", 0).write.parquet(f"{root}/processed_datasets/bases/lost")   # no pointer
    assert [(q, n) for q, n, _ in shown(spark, root)] == [(q, n) for q, n, _ in want]
    assert upkeep.compact(spark, root, "processed_datasets") and upkeep.compact(spark, root, "processed_datasets") is None
    assert [(q, n) for q, n, _ in shown(spark, root)] == [(q, n) for q, n, _ in want]


def test_names_follow(spark, tmp_path):
    from fathom.sources import bindings
    from pyspark.sql import functions as F
    pk, root = bindings.packages(spark, "/root/testdata/sf0.001"), str(tmp_path / "t")
    upkeep.merge_batch(pk, root, 0)
    upkeep.merge_batch(pk.withColumn("title", F.concat(F.coalesce("title", F.lit("")), F.lit(" v2"))), root, 1, ("processed_datasets",))
    both = [upkeep.current(spark, root, k).drop("batch_id") for k in ("model_runs", "processed_datasets")]
    names = {r["qid"]: r["name"] for r in both[1].collect()}
    seen = 0
    for r in runs.enrich_runs(*both).collect():
        for q, n in zip(r["input_dataset_qids"], r["input_names"]):
            assert n == names.get(q, q)
            seen += n.endswith(" v2")
    assert seen > 0


def test_nothing_arrived(spark, tmp_path):
    from fathom.sources import bindings
    root = str(tmp_path / "t")
    upkeep.merge_batch(bindings.packages(spark, "/root/testdata/sf0.001").where("false"), root, 0, ("models",))
    assert upkeep.current(spark, root, "models").collect() == [] and upkeep.compact(spark, root, "models") is None
