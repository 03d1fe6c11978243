"""Alignment of all runs: ranges against plain Python, on both numberings."""

import random

import pytest

from fathom.operators import series

POINTS, LABELS = "run_key long, series string, pos long, y string", "run_key long, pos long, label string"


def made():
    rng = random.Random(2)
    points = {(r, s, p): rng.choice([None, "1", "2"]) for r in (1, 2, None) for s in ("a", "b", "c") for p in rng.sample(range(-20, 60), 25)}
    points |= {(1, "hot", p): str(p) for p in range(0, 600, 2)}
    points |= {(3, "empty", p): None for p in (4, 5)} | {(3, "one", 9): "x"}
    labels = {(r, p): f"L{p}" for r in (1, 2, 4) for p in range(-30, 30, 7)}
    return points, labels


def brute(points, labels):
    axis = {}
    for r, _, p in points:
        axis.setdefault(r, set()).add(p)
    for r, p in labels:
        axis.setdefault(r, set()).add(p)
    ranges, dense = set(), set()
    for r, s in {(r, s) for r, s, _ in points}:
        run, gap = sorted(axis[r]), []
        for p in [*run, None]:
            y = points.get((r, s, p))
            if p is not None:
                dense.add((r, s, p, labels.get((r, p), str(p)), y))
            if p is not None and y is None:
                gap.append(p)
                continue
            if gap:
                ranges.add((r, s, gap[0], gap[-1], len(gap), None))
            gap = []
            if p is not None:
                ranges.add((r, s, p, p, 1, y))
    return ranges, dense


@pytest.mark.parametrize("rows", [None, 20])
def test_ranges_and_dense_form(spark, rows):
    points, labels = made()
    p = spark.createDataFrame([(*k, y) for k, y in points.items()], POINTS).repartition(5)
    lab = spark.createDataFrame([(*k, v) for k, v in labels.items()], LABELS)
    ranges, dense = brute(points, labels)
    got = series.sparse_ranges(lab, p, max_group_rows=rows)
    assert got.columns == ["run_key", "series", "from_pos", "to_pos", "n_positions", "y"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(ranges) and set(found) == ranges
    full = [tuple(r) for r in series.expand_ranges(got, series.run_axis(lab, p)).collect()]
    assert len(full) == len(dense) and set(full) == dense


def test_like_the_pivot_of_one_run(spark):
    points, labels = made()
    own = spark.createDataFrame([(s, pos, y) for (r, s, pos), y in points.items() if r == 1], "series string, pos long, y string")
    lab = spark.createDataFrame([(pos, v) for (r, pos), v in labels.items() if r == 1], "pos long, label string")
    from pyspark.sql import functions as F
    one, many = F.lit(1).cast("long").alias("run_key"), ["a", "b", "c", "hot"]
    wide = {tuple(r) for r in series.sparse_align(lab, own, many).select("series", "pos", "category", "y").collect()}
    ax = series.run_axis(lab.select(one, "*"), own.select(one, "*"))
    full = series.expand_ranges(series.sparse_ranges(lab.select(one, "*"), own.select(one, "*")), ax)
    assert {tuple(r) for r in full.select("series", "pos", "category", "y").collect()} == wide


def test_nothing(spark):
    assert series.sparse_ranges(spark.createDataFrame([(1, 2, "x")], LABELS), spark.createDataFrame([], POINTS)).collect() == []
