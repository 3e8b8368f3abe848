"""Approximate nearest neighbours by a few stable projections, a kd-tree and a chi-square stopping test.

Vectors of unit length are projected on ``PROJECTIONS`` Gaussian directions. The squared distance of two projections,
over the squared distance of the vectors, is chi-square with that many degrees of freedom. A kd-tree over the
projections yields neighbours in order of projected distance; each is verified on the original vectors. The search of a
query ends when a vector as near as the worst of the best so far would have come by now with probability ``sure``.

Rows are dealt into slices, one tree each, so the test holds in every slice (a slice's best are no nearer than the
table's, which makes it stop later, not earlier). Of equal vectors one point is indexed, with the least ids.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import query_grid

NEIGHBOURS = 5
PROJECTIONS = 16
SURE = 0.95
SEED = 271828
#: Points of a leaf, also how many are verified at a time, and leaves that are opened before what they hold is verified.
LEAF = 128
STEP = 12


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part, one per ``vec_id`` (the one with the least vector)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).dropna()
    return query_grid.one_per_id(rows.filter(finite & F.exists("embedding", lambda x: x != 0)), "vec_id")


def points(rows: DataFrame, ids: int) -> DataFrame:
    """``ids, embedding`` of each distinct vector; ``ids`` are its least ones, no more than can be asked for.

    Only the least ids of each task are shuffled, so a vector that many rows share costs no more than any other.
    """
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= ids)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def chi_square(x: float, degrees: int) -> float:
    """Probability that a chi-square variable of an even number of ``degrees`` is at most ``x``."""
    term = total = math.exp(-x / 2)
    for j in range(1, degrees // 2):
        term *= x / 2 / j
        total += term
    return 1 - total


def stop_at(sure: float, degrees: int) -> float:
    """The value that a chi-square variable keeps to with probability ``sure``."""
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < sure:
        high *= 2
    for _ in range(80):
        low, high = ((low + high) / 2, high) if chi_square((low + high) / 2, degrees) < sure else (low, (low + high) / 2)
    return high


def dense(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows; shorter vectors end in zeros. Each row is scaled by a power of two to about one, which
    changes no cosine and keeps squares from overflow."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    _, exponent = np.frexp(np.abs(out).max(axis=1, initial=0))
    return np.ldexp(out, -exponent[:, None])


class Tree:
    """A kd-tree: points are reordered so that a node is a run of them; children of node i are 2i + 1 and 2i + 2."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.axis: dict[int, int] = {}
        self.cut: dict[int, float] = {}
        self.leaf: dict[int, tuple[int, int]] = {}
        todo = [(0, 0, len(points))]
        while todo:
            node, a, b = todo.pop()
            own = points[self.order[a:b]]
            if b - a <= LEAF:
                self.leaf[node] = (a, b)
                continue
            spread = own.max(axis=0) - own.min(axis=0)
            axis = int(np.argmax(spread))
            middle = (b - a) // 2
            turn = np.argpartition(own[:, axis], middle)
            self.order[a:b] = self.order[a:b][turn]
            self.axis[node], self.cut[node] = axis, float(own[turn[middle], axis])
            todo += [(2 * node + 1, a, a + middle), (2 * node + 2, a + middle, b)]
        self.points = np.ascontiguousarray(points[self.order])
        self.square = np.einsum("ij,ij->i", self.points, self.points)

    def nearest_first(self, query: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """Leaves (least squared distance of their box, first point, end) by that distance."""
        q = query.tolist()
        heap = [(0.0, 0, [0.0] * len(q))]
        while heap:
            near, node, off = heapq.heappop(heap)
            while node in self.axis:  # down to the query's side; the other one waits at its distance
                axis = self.axis[node]
                apart = q[axis] - self.cut[node]
                mine, other = (2 * node + 1, 2 * node + 2) if apart < 0 else (2 * node + 2, 2 * node + 1)
                moved = off.copy()
                moved[axis] = apart
                heapq.heappush(heap, (near - off[axis] ** 2 + apart**2, other, moved))
                node = mine
            yield near, *self.leaf[node]


class Index:
    """The points of a slice with their tree."""

    def __init__(self, x: np.ndarray, ids: list[list[int]], directions: np.ndarray, sure: float):
        self.length = np.sqrt(np.einsum("ij,ij->i", x, x))
        self.directions, self.stop = directions, stop_at(sure, directions.shape[1])
        self.tree = Tree((x / self.length[:, None]) @ directions)
        order = self.tree.order
        self.x, self.length, self.ids = x[order], self.length[order], [ids[i] for i in order.tolist()]

    def search(self, x: np.ndarray, own: int, k: int) -> list[tuple[float, int]]:
        """Up to ``k`` (cosine, vec_id) found, nearest first, ties by smaller id."""
        length = math.sqrt(np.einsum("i,i->", x, x))
        projected = (x / length) @ self.directions
        best: list[tuple[float, int]] = []
        worst = math.inf  # squared distance of the k-th best
        wait_at, wait_d = np.zeros(0, np.int64), np.zeros(0)
        runs, leaves = [], self.tree.nearest_first(projected)
        while True:
            near = math.inf
            for near, a, b in leaves:
                runs.append((a, b))
                if len(runs) > STEP:
                    break
            else:
                near = math.inf
            # All but the leaf just reached are opened; what lies nearer than it comes next for certain.
            opened, runs = (runs[:-1], runs[-1:]) if near < math.inf else (runs, [])
            new = np.concatenate([np.arange(a, b) for a, b in opened] or [wait_at[:0]])
            apart = self.tree.square[new] - 2 * (self.tree.points[new] @ projected) + projected @ projected
            at, far = np.concatenate([wait_at, new]), np.concatenate([wait_d, apart])
            now = far <= near
            wait_at, wait_d = at[~now], far[~now]
            at, far = at[now], far[now]
            order = np.argsort(far, kind="stable")
            at, far = at[order], far[order]
            for chunk in range(0, len(at), LEAF):
                some = at[chunk:chunk + LEAF]
                if far[chunk] > self.stop * worst:
                    return best
                cosine = np.einsum("ij,j->i", self.x[some], x) / (self.length[some] * length)
                floor = best[k - 1][0] if len(best) >= k else -math.inf
                fresh = [(float(cosine[n]), i) for n in np.flatnonzero(cosine >= floor) for i in self.ids[some[n]] if i != own]
                if fresh:
                    best = sorted(best + fresh, key=lambda t: (-t[0], t[1]))[:k]
                    if len(best) == k:
                        worst = max(0.0, 2 - 2 * best[-1][0])
            if near == math.inf or near > self.stop * worst:
                return best


def nearest(rows: DataFrame, queries: Column, k: int = NEIGHBOURS, projections: int = PROJECTIONS, sure: float = SURE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows found with the largest cosine to each query, other than its own.

    ``queries`` is a condition on ``vec_id, embedding``. A row takes no part if its id or vector is null, its vector is
    zero or empty or has a null or non-finite component; of rows that repeat a ``vec_id`` the one with the least vector
    does; shorter vectors end in zeros; ties go to smaller ids; fewer than ``k`` other rows are all found; an empty table
    gives no rows. Every row is indexed. A neighbour is missed with probability ``1 - sure`` at most, over the
    choice of the directions, which ``SEED`` fixes. ``projections`` is even.
    """
    spark = rows.sparkSession
    rows = usable(rows)
    n, asked, width = rows.agg(F.count("*"), F.count_if(queries), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    grid = query_grid.plan(spark, n, asked)
    directions = np.random.default_rng(SEED).normal(size=(width, projections))
    indexed = points(rows, k + 1).select(F.col("ids")[0].alias("vec_id"), "ids", "embedding")
    asking = rows.filter(queries).select("vec_id", F.array("vec_id").alias("ids"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, index = [], [], None
        for batch in batches:
            asks = batch.column("is_query").to_numpy(zero_copy_only=False)
            own = batch.filter(pa.array(~asks))
            if own.num_rows:
                held.append(dense(own.column("embedding"), width))
                ids += own.column("ids").to_pylist()
            batch = batch.filter(pa.array(asks))
            if not batch.num_rows or not held:
                continue
            index = index or Index(np.concatenate(held), ids, directions, sure)
            for_query = [index.search(x, q, k) for q, x in zip(batch.column("vec_id").to_pylist(), dense(batch.column("embedding"), width), strict=True)]
            asked = np.repeat(batch.column("vec_id").to_numpy(), [len(f) for f in for_query])
            flat = [t for f in for_query for t in f]
            yield pa.RecordBatch.from_arrays(
                [pa.array(asked), pa.array([t[1] for t in flat], pa.int64()), pa.array([t[0] for t in flat], pa.float64())], ["query_id", "vec_id", "score"]
            )

    cells = query_grid.cells(indexed, asking, grid, "vec_id", "vec_id", False)
    found = cells.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
