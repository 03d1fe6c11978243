"""M-tree search against all pairs."""

import math

import numpy as np
import pytest

from fathom.llm import mtree as T


def brute(rows, k, is_query):
    ok = []
    for i, (id_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, id_, [math.floor(1024 * x) for x in v]))
    out = []
    for i, id_, q in ok:
        if id_ is not None and is_query(id_):
            s = sorted(((-sum(a * b for a, b in zip(q, v)), j_id is None, j_id or 0) for j, j_id, v in ok if j != i and len(v) == len(q)))[:k]
            out += [(id_, n + 1, None if none else x, -score) for n, (score, none, x) in enumerate(s)]
    return sorted(out, key=repr)


def run(spark, rows, k=10, **options):
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    return sorted((tuple(r) for r in T.top_k(df.select("vec_id", "embedding"), "vec_id % 10 = 0", k, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"block_queries": 3}])
def test_like_all_pairs(spark, options):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)]             # a hot vector: ties
    rows += [(7, rows[7][1]), (0, [0.25] * 8), (None, [3.0] * 8), (50, None), (60, []), (70, [1.0, None]), (80, [float("nan")] * 8), (90, [float("inf")] * 8)]
    rows += [(2000, [1.0, 2.0]), (2001, [1.0, 2.0]), (2010, [1.0, 2.0, 3.0])]
    assert run(spark, rows, **options) == brute(rows, 10, lambda i: i % 10 == 0)


def test_pruning_skips_distances_and_keeps_results():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (40, 6))
    v = (centres[rng.integers(0, 40, 4000)] + rng.integers(-5, 6, (4000, 6))).astype(np.int64)
    v = (v * 1000 / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    tree = T.MTree(v, np.arange(4000), np.arange(4000), int((v * v).sum(axis=1).max()))
    for q in range(0, 4000, 500):
        want = sorted((-int(s), i) for i, s in enumerate(v @ v[q]) if i != q)[:10]
        assert [(-s, i) for s, i, _ in tree.search(v[q], q, 10)] == want
    assert tree.computed < 0.5 * 8 * 4000


def test_wide_vectors_are_searched_exactly(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100, [200000.0, 1.0, 0.0, 0.0]), (101, [3e5, 0.0, 0.0, 0.0]), (110, [1e6, -2.0, 0.0, 1.0]), (None, [-4e5, 1.0, 1.0, 1.0])]
    rows += [(200 + i, [90000.0 + i] * 1024) for i in range(12)] + [(240, [1.0] * 1024)]
    assert run(spark, rows, 3, block_queries=4) == brute(rows, 3, lambda i: i % 10 == 0)


def test_a_score_above_a_long_is_an_error(spark):
    for rows in ([(0, [3e38, 1.0]), (1, [3e38, 1.0]), (2, [0.0, 1.0])], [(i, [131000.0] * 1024) for i in range(4)]):
        with pytest.raises(Exception, match="fit a long"):
            run(spark, rows)
    below = [(0, [3e38, 1.0]), (1, [-3e38, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])]
    assert run(spark, below, 2) == brute(below, 2, lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="fit a long"):
        run(spark, below, 3)


def test_equal_vectors_and_empty_table(spark):
    rows = [(i, [1.0, 1.0]) for i in range(300)]
    assert run(spark, rows, 5) == brute(rows, 5, lambda i: i % 10 == 0)
    assert run(spark, [], 5) == []
    assert run(spark, [(1, [1.0])], 5) == []
