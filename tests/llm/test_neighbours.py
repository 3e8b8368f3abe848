from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.llm import neighbours as nb
from blockweave.llm import query_grid

SCHEMA = "vec_id bigint, embedding array<float>, label int, ids string, score double, cell int, is_query boolean"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([r + (1, "x", 0.5, 3, True) for r in rows], SCHEMA).repartition(parts)


def vectors(n: int, dim: int, seed: int, clusters: int = 8, spread: float = 1.0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return [(2 * i, [float(v) for v in (centres[i % clusters] + spread * rng.normal(size=dim)).astype(np.float32)]) for i in range(n)]


def brute(rows, asks, k=5) -> dict[int, list[tuple[int, float]]]:
    one = {}
    for i, x in rows:
        if i is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x):
            one[i] = min(one.get(i, x), x)
    ids, width = sorted(one), max(map(len, one.values()), default=0)
    x = np.array([one[i] + [0.0] * (width - len(one[i])) for i in ids])
    x /= np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for at, i in enumerate(ids):
        if asks(i):
            cosine = np.round(x @ x[at], 12)
            order = [j for j in np.lexsort((ids, -cosine)) if j != at][:k]
            out[i] = [(ids[j], float(cosine[j])) for j in order]
    return out


def found(df) -> dict[int, list[tuple[int, float]]]:
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, true) -> float:
    assert got.keys() <= true.keys()
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in best}) for q, best in true.items())
    return hits / sum(map(len, true.values()))


@pytest.mark.parametrize("spread", [0.2, 1.0, 5.0])
def test_recall_scores_and_order(spark, spread):
    rows = vectors(1500, 48, 1, spread=spread)
    got, true = found(nb.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0)), brute(rows, lambda i: i % 50 == 0)
    assert recall(got, true) >= 0.9
    scores = {q: dict(best) for q, best in brute(rows, lambda i: i % 50 == 0, len(rows)).items()}
    for q, best in got.items():
        assert len(best) == 5 and len({i for i, _ in best}) == 5
        assert best == sorted(best, key=lambda t: (-t[1], t[0]))
        assert all(abs(s - scores[q][i]) < 1e-9 for i, s in best)


def test_small_tables_nulls_and_ragged_vectors(spark):
    rows = vectors(6, 5, 2) + [(100, [1.0]), (101, []), (102, None), (103, [0.0] * 5), (104, [1.0, None]), (105, [math.nan] * 5)]
    rows += [(106, [math.inf] * 5), (None, [1.0] * 5), (200, [3e38] * 5), (201, [1e-38] * 5), *vectors(6, 5, 2)[:2], (0, [-9.0] * 5)]
    true = brute(rows, lambda i: i % 2 == 0)
    got = found(nb.nearest(frame(spark, rows), F.col("vec_id") % 2 == 0))
    assert {q: [i for i, _ in b] for q, b in got.items()} == {q: [i for i, _ in b] for q, b in true.items()}
    assert nb.nearest(frame(spark, rows[:3]), F.col("vec_id") == 0).count() == 2
    assert nb.nearest(frame(spark, rows).limit(0), F.col("vec_id") == 0).count() == 0


def test_copies_are_found_by_least_id(spark):
    one = vectors(300, 16, 3)
    rows = one + [(1000 + i, one[7][1]) for i in range(200)]
    got = found(nb.nearest(frame(spark, rows, 5), (F.col("vec_id") % 50 == 0) | (F.col("vec_id") == 14)))
    assert [i for i, _ in got[14]] == [1000, 1001, 1002, 1003, 1004]
    assert [i for i, _ in got[1000]] == [14, 1001, 1002, 1003, 1004]
    assert [i for i, _ in got[1150]] == [14, 1000, 1001, 1002, 1003]


def test_many_cells(spark, monkeypatch):
    monkeypatch.setattr(query_grid, "SLICE_ROWS", 60)
    monkeypatch.setattr(query_grid, "BLOCK_QUERIES", 7)
    rows = vectors(500, 24, 4)
    assert recall(found(nb.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0)), brute(rows, lambda i: i % 50 == 0)) >= 0.9


def test_tree_yields_all_points_in_order():
    points = np.random.default_rng(0).normal(size=(1000, 6))
    points[:300] = points[0]
    tree, query = nb.Tree(points), np.ones(6)
    runs = list(tree.nearest_first(query))
    assert sorted(p for _, a, b in runs for p in tree.order[a:b].tolist()) == list(range(1000))
    nears = [near for near, _, _ in runs]
    assert nears == sorted(nears)
    for near, a, b in runs:
        assert near <= ((tree.points[a:b] - query) ** 2).sum(axis=1).min() + 1e-9


def test_the_test_stops_early():
    """Of clustered points only a part is verified."""
    x = np.array([v for _, v in vectors(4000, 32, 5, clusters=40, spread=0.1)])
    index = nb.Index(x, [[i] for i in range(len(x))], np.random.default_rng(1).normal(size=(32, 16)), nb.SURE)
    opened, first = [], index.tree.nearest_first
    index.tree.nearest_first = lambda q: (opened.append(run) or run for run in first(q))
    index.search(x[0], 0, 5)
    assert len(opened) < len(index.tree.leaf) / 2


@pytest.mark.parametrize(("x", "p"), [(26.296, 0.95), (15.338, 0.5)])
def test_chi_square(x, p):
    assert abs(nb.chi_square(x, 16) - p) < 1e-3 and abs(nb.stop_at(p, 16) - x) < 2e-2
