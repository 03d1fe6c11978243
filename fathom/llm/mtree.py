"""Exact top-k inner products by best-first search in M-trees.

Vectors become integers, floor(scale * x). The largest inner product is a
nearest neighbour in a metric space: with R the largest length of a vector,
y gets one more component sqrt(R^2 - |y|^2) and a query gets 0, and then
d(q, y)^2 = |q|^2 + R^2 - 2 q.y.

The vectors are cut into shards of at most ``SHARD_ROWS`` rows; each shard's
M-tree is built by assigning vectors to routing objects, level by level. A
node is a page: of its entries it holds the routing object, the covering
radius and the distance to the page's own routing object (a leaf: of its
vectors that distance). A query visits pages best-first, by the least
distance anything under them can have, and stops when that exceeds the k-th
best. Entries and vectors whose stored parent distance already rules them out
by the triangle inequality are skipped without computing their distance.
Bounds are floats with a slack; scores are exact integers.

Queries are read in blocks of at most ``BLOCK_QUERIES``, each broadcast and
searched in all shards; a query's k best of every shard are then merged. So
memory does not grow with the queries or the vectors.

Vectors that are null or empty or hold null or non-finite components take no
part. Vectors of different lengths are never compared. A query skips its own
row only: rows that repeat its id are candidates. Ties go to the smaller id,
then to the smaller row number; null ids come last. Fewer than k candidates
give fewer rows, an empty table gives none. Only the two named columns are
read.

Trees compute in 64-bit integers, which is exact for vectors of a square up
to ``LARGEST_SQUARE``. Wider vectors are kept beside the trees as arbitrary
integers: every query is compared with all of them, and a wide query with all
vectors, block by block. A score among a query's k best that does not fit a
long is an error.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm.common import ROW_ID, new_path, pylist, store, with_row_id

PAGE = 256          # entries of a page
SHARD_ROWS = 8192
BLOCK_QUERIES = 8192
LARGEST_SQUARE = 1 << 60
FLOAT_SQUARE = 1 << 52      # up to here doubles hold every product and sum of an inner product exactly
LONG = 1 << 63
SLACK = 1e-7        # of the space's size: above any rounding of a distance
NO_ID = np.iinfo(np.int64).max
FOUND_NAMES = ["query_id", "_query", "score", "_id", "_row", "_below"]


@dataclass
class Page:
    """Entries of one node. ``children`` is empty for a leaf; ``rows`` are the
    entries' routing objects, or a leaf's vectors."""

    rows: np.ndarray
    parent: np.ndarray      # distance to the page's routing object
    radius: np.ndarray      # covering radii of the entries; zeros in a leaf
    children: list[int]


class MTree:
    """An M-tree over integer vectors of one length."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, row_ids: np.ndarray, largest: int) -> None:
        self.ids, self.row_ids, self.largest = ids, row_ids, largest
        self.extra = np.sqrt(np.maximum(0, largest - (vectors * vectors).sum(axis=1)).astype(np.float64))
        self.vectors = vectors.astype(np.float64) if largest <= FLOAT_SQUARE else vectors
        self.pages: list[Page] = []
        self.computed = 0
        rows = np.arange(len(vectors))
        self.root, self.root_row, _ = self._build(rows, 0)

    def _distances(self, row: int, rows: np.ndarray) -> np.ndarray:
        d = self.vectors[rows] - self.vectors[row]
        return np.sqrt((d * d).sum(axis=1) + (self.extra[rows] - self.extra[row]) ** 2)

    def _build(self, rows: np.ndarray, own: int) -> tuple[int, int, float]:
        """(page, routing row, radius) of a subtree over ``rows`` whose
        routing object is row ``own``."""
        to_own = self._distances(own, rows)
        if len(rows) <= PAGE:
            self.pages.append(Page(rows, to_own, np.zeros(len(rows)), []))
            return len(self.pages) - 1, own, float(to_own.max(initial=0.0))
        n = min(PAGE, -(-2 * len(rows) // PAGE))
        pivots = rows[np.linspace(0, len(rows) - 1, n).astype(int)]
        near, best = np.zeros(len(rows), int), np.full(len(rows), np.inf)
        for i, p in enumerate(pivots):
            d = self._distances(p, rows)
            near, best = np.where(d < best, i, near), np.minimum(best, d)
        groups = [(int(p), rows[near == i]) for i, p in enumerate(pivots) if (near == i).any()]
        if max(len(g) for _, g in groups) == len(rows):     # equal vectors: deal them out evenly
            groups = [(int(g[0]), g) for g in np.array_split(rows, n)]
        entries = [(p, *self._build(g, p)[::2]) for p, g in groups]
        routing = np.array([e[0] for e in entries])
        self.pages.append(Page(routing, self._distances(own, routing), np.array([e[2] for e in entries]), [e[1] for e in entries]))
        return len(self.pages) - 1, own, float(to_own.max())

    def search(self, query: np.ndarray, row_id: int, k: int) -> list[tuple[int, int, int]]:
        """The k best (score, id, row number), best first."""
        square = int((query * query).sum())
        slack = SLACK * (np.sqrt(float(self.largest)) + np.sqrt(float(square)) + 1)
        scores, ids, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        bound = np.inf      # distance of the k-th best, with slack
        own_type = query.astype(self.vectors.dtype)

        def distances(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            self.computed += len(at)
            product = (self.vectors[at] @ own_type).astype(np.int64)
            return product, np.sqrt(np.maximum(0, square + self.largest - 2 * product).astype(np.float64))

        heap = [(0.0, self.root, float(distances(np.array([self.root_row]))[1][0]))]
        while heap and heap[0][0] <= bound:
            _, number, to_parent = heapq.heappop(heap)
            page = self.pages[number]
            at = np.flatnonzero(np.abs(to_parent - page.parent) - page.radius <= bound)
            if not len(at):
                continue
            product, d = distances(page.rows[at])
            if page.children:
                least = np.maximum(0.0, d - page.radius[at])
                for i in np.flatnonzero(least <= bound):
                    heapq.heappush(heap, (float(least[i]), page.children[at[i]], float(d[i])))
                continue
            own = page.rows[at]
            ok = self.row_ids[own] != row_id
            if len(scores) >= k:
                ok &= product >= scores[-1]
            if not ok.any():
                continue
            scores, ids, rows = (np.concatenate(x) for x in ((scores, product[ok]), (ids, self.ids[own[ok]]), (rows, self.row_ids[own[ok]])))
            keep = np.lexsort((rows, ids, -scores))[:k]
            scores, ids, rows = scores[keep], ids[keep], rows[keep]
            if len(scores) >= k:
                bound = float(np.sqrt(max(0, square + self.largest - 2 * int(scores[-1])))) + slack
        return list(zip(scores.tolist(), ids.tolist(), rows.tolist()))


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Stored (_row_id, id, dims, vector, square, wide) of the vectors that
    take part: a vector is 64-bit bytes, a wide one pickled integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for id_, v in zip(pylist(b, "id"), pylist(b, "v")):
                if not v or any(x is None for x in v):
                    continue
                f = np.array(v, np.float64)
                if not np.isfinite(f).all():
                    continue
                if wide := float(np.abs(f).max()) * scale * np.sqrt(len(f)) >= 1 << 29:     # else the square is below the bound
                    x = [math.floor(Fraction(a) * scale) for a in v]
                    wide = sum(a * a for a in x) > LARGEST_SQUARE
                if wide:
                    row = id_, len(x), pickle.dumps(x), 0, True
                else:
                    x = np.floor(scale * f).astype("<i8")
                    row = id_, len(x), x.tobytes(), int((x * x).sum()), False
                for col, y in zip(out, row):
                    col.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()))],
                                             names=["id", "dims", "vector", "square", "wide"])
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return with_row_id(rows.mapInArrow(run, "id long, dims int, vector binary, square long, wide boolean"), "vectors")


def _integers(vector: bytes, wide: bool) -> list[int]:
    return pickle.loads(vector) if wide else np.frombuffer(vector, "<i8").tolist()


def _compare_all(held, k: int):
    """The k best of each held query among the batches' vectors, by plain
    integer arithmetic. A score above a long is an error at once; one below is
    marked, as it matters only if it stays among the k best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [(id_, row, dims, _integers(v, wide)) for dims, got in held.value.items() for id_, row, v, wide in got]
        best: list[list] = [[] for _ in queries]
        for b in batches:
            for id_, row, dims, v, wide in zip(*(pylist(b, c) for c in ("id", ROW_ID, "dims", "vector", "wide"))):
                own = _integers(v, wide)
                for i, (_, q_row, q_dims, q) in enumerate(queries):
                    if q_dims == dims and q_row != row:
                        score = sum(x * y for x, y in zip(q, own))
                        item = (score, -(NO_ID if id_ is None else id_), -row)
                        heapq.heappush(best[i], item) if len(best[i]) < k else heapq.heappushpop(best[i], item)
        out = []
        for (id_, row, _, _), found in zip(queries, best):
            for score, minus_id, minus_row in found:
                if score >= LONG:
                    raise OverflowError(f"the score of query {id_} and {-minus_id} does not fit a long")
                out.append((id_, row, max(score, -LONG), -minus_id, -minus_row, score < -LONG))
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.bool_())], names=FOUND_NAMES)
    return run


def build_trees(vectors: DataFrame, largest: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Stored (dims, tree): pickled M-trees of at most ``shard_rows`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def tree(dims: int) -> pa.RecordBatch:
            got = held.pop(dims)
            t = MTree(np.frombuffer(b"".join(x[2] for x in got), "<i8").reshape(-1, dims).astype(np.int64),
                      np.array([NO_ID if x[0] is None else x[0] for x in got], np.int64), np.array([x[1] for x in got], np.int64), largest)
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([pickle.dumps(t)], pa.binary())], names=["dims", "tree"])

        for b in batches:
            for id_, row, dims, v in zip(*(pylist(b, c) for c in ("id", ROW_ID, "dims", "vector"))):
                own = held.setdefault(dims, [])
                own.append((id_, row, v))
                if len(own) >= shard_rows:
                    yield tree(dims)
        for dims in list(held):
            yield tree(dims)
    return store(vectors.mapInArrow(run, "dims int, tree binary"), "m-trees")


def top_k(table: DataFrame, queries: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024,
          block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, ``id_col``, score): the ``k`` largest inner products of
    every query (the rows where the SQL condition ``queries`` holds for
    ``id_col``) with all other rows."""
    spark = table.sparkSession
    vectors = integer_vectors(table, id_col, vector_col, scale)
    seen = vectors.agg(F.max("square").alias("largest"), F.count_if("wide").alias("wide")).first()
    largest = int(seen["largest"] or 0)
    trees = build_trees(vectors.where("NOT wide"), largest)

    def block_search(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for dims, blob in zip(pylist(b, "dims"), pylist(b, "tree")):
                    tree: MTree = pickle.loads(blob)
                    out: list[tuple] = []
                    for id_, row, v, _ in held.value.get(dims, ()):
                        out += [(id_, row, *x) for x in tree.search(np.frombuffer(v, "<i8").astype(np.int64), row, k)]
                    cols = list(zip(*out)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([False] * len(out), pa.bool_())], names=FOUND_NAMES)
        return run

    def blocks(wide: bool) -> Iterator[dict[int, list]]:
        held, n = {}, 0
        own = vectors.where(F.col("wide") == wide).withColumnRenamed("id", id_col)
        for r in own.where(queries).select(id_col, ROW_ID, "dims", "vector").toLocalIterator():
            held.setdefault(r["dims"], []).append((r[0], r[1], bytes(r[3]), wide))
            n += 1
            if n == block_queries:
                yield held
                held, n = {}, 0
        if n:
            yield held

    schema, path = "query_id long, _query long, score long, _id long, _row long, _below boolean", new_path(spark, "found")
    spark.createDataFrame([], schema).write.parquet(path)
    for block in blocks(False):      # all blocks' results in one folder: the plan does not grow with them
        held = spark.sparkContext.broadcast(block)
        trees.mapInArrow(block_search(held), schema).write.mode("append").parquet(path)
        if seen["wide"]:
            vectors.where("wide").mapInArrow(_compare_all(held, k), schema).write.mode("append").parquet(path)
    for block in blocks(True) if seen["wide"] else ():
        vectors.mapInArrow(_compare_all(spark.sparkContext.broadcast(block), k), schema).write.mode("append").parquet(path)
    found = spark.read.schema(schema).parquet(path)
    best = Window.partitionBy("_query").orderBy(F.desc("score"), "_id", "_row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.when(F.col("_id") != NO_ID, F.col("_id")).alias(id_col),
        F.when(F.col("_below"), F.raise_error(F.lit("a score does not fit a long")).cast("long")).otherwise(F.col("score")).alias("score"))
