"""Atomic publication: readers see whole snapshots only."""

import pytest

from fathom.sources import bindings, sinks, snapshots

SF = "/root/testdata/sf0.001"


def test_readers_stay_on_the_old_tables(spark, tmp_path, monkeypatch):
    root, pk = str(tmp_path / "cat"), bindings.packages(spark, SF)
    with pytest.raises(LookupError):
        snapshots.read_snapshot(spark, root, "models")
    first = snapshots.publish_snapshot(pk.limit(40), root)
    n = snapshots.read_snapshot(spark, root, "model_runs").count()
    real = sinks.publish_catalogue

    def killed(pkgs, at, base, mode):
        real(pkgs, at, base, mode=mode, kinds=["models"])       # some tables are written
        raise RuntimeError("the writer is lost")
    monkeypatch.setattr(sinks, "publish_catalogue", killed)
    with pytest.raises(RuntimeError):
        snapshots.publish_snapshot(pk, root)
    monkeypatch.setattr(sinks, "publish_catalogue", real)
    assert snapshots.versions(spark, root) == [first]
    assert snapshots.read_snapshot(spark, root, "model_runs").count() == n
    # a reader's plan made before the next publication still reads its snapshot
    held = snapshots.read_snapshot(spark, root, "raw_datasets")
    before = held.count()
    second = snapshots.publish_snapshot(pk, root)
    assert snapshots.versions(spark, root) == [first, second] and held.count() == before
    assert snapshots.read_snapshot(spark, root, "raw_datasets").count() > before
    assert snapshots.read_snapshot(spark, root, "raw_datasets", first).count() == before
    # the dead writer's folder goes once it is old, the published ones stay
    assert len(snapshots.retire(spark, root, keep=2, dead_after=-1)) == 1
    assert snapshots.versions(spark, root) == [first, second]


def test_retention(spark, tmp_path):
    root, pk = str(tmp_path / "cat"), bindings.packages(spark, SF).limit(5)
    names = [snapshots.publish_snapshot(pk, root, keep=2) for _ in range(3)]
    assert snapshots.versions(spark, root) == names[1:]
    with pytest.raises(LookupError):
        snapshots.read_snapshot(spark, root, "models", names[0])
