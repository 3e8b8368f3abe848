from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.llm import hard_negatives as hn
from blockweave.llm import query_grid

SCHEMA = "vec_id bigint, label int, embedding array<float>, cell bigint, is_query boolean, rest string, score int"


def vectors(n: int, dim: int, seed: int, clusters: int = 4) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    rows = []
    for i in range(n):
        c = int(rng.integers(clusters))
        x = (centres[c] + 0.7 * rng.normal(size=dim)).astype(np.float32)
        rows.append((3 * i, int(rng.integers(3)), [float(v) for v in x / np.linalg.norm(x)]))
    return rows


def brute(rows: list[tuple], anchor, positives=5, negatives=10) -> set[tuple]:
    best = {}
    for vec_id, label, x in rows:
        if None in (vec_id, label, x) or any(v is None or not math.isfinite(v) for v in x):
            continue
        best[vec_id] = min(best.get(vec_id, (label, x)), (label, x))
    ints = {i: (label, [math.floor(256 * v) for v in x]) for i, (label, x) in best.items()}
    out = set()
    for a, (label, x) in ints.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), i, other) for i, (other, y) in ints.items() if i != a)
        for s, pos, _ in [t for t in scored if t[2] == label][:positives]:
            fit = [(i, -n) for n, i, other in scored if other != label and -30 * s <= -100 * n <= -90 * s]
            out |= {(a, pos, k + 1, i, -s, n) for k, (i, n) in enumerate(fit[:negatives])}
    return out


def found(df) -> list[tuple]:
    return [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([r + (1, True, "r", 2) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize(("n", "dim"), [(300, 8), (200, 64), (120, 100)])
def test_equals_brute_force(spark, n, dim):
    rows = vectors(n, dim, n)
    got = found(hn.mine(frame(spark, rows), F.col("vec_id") % 15 == 0))
    assert got and len(got) == len(set(got)) and set(got) == brute(rows, lambda i: i % 15 == 0)


def test_nulls_ties_repeats_and_ragged_vectors(spark):
    rows = vectors(60, 6, 1)
    rows += [(3000 + i, i % 3, rows[0][2]) for i in range(40)] + [(r[0], (r[1] + 1) % 3, r[2]) for r in rows[:10]] + rows[20:25]
    rows += [(None, 1, rows[0][2]), (9001, None, rows[0][2]), (9002, 1, None), (9003, 1, [1.0, None]), (9004, 1, [math.nan] * 6)]
    rows += [(9005, 1, [math.inf] * 6), (9006, 1, []), (9007, 2, [0.5, 0.5]), (9008, 1, [0.0] * 6), (9015, 2, [-0.1] * 6)]
    got = found(hn.mine(frame(spark, rows), F.col("vec_id") % 15 == 0))
    assert len(got) == len(set(got)) and set(got) == brute(rows, lambda i: i % 15 == 0)


def test_many_cells_give_the_same(spark, monkeypatch):
    rows = vectors(400, 16, 5)
    monkeypatch.setattr(query_grid, "SLICE_ROWS", 50)
    monkeypatch.setattr(query_grid, "BLOCK_QUERIES", 9)
    monkeypatch.setattr(hn, "TILE_PAIRS", 64)
    grid = query_grid.plan(spark, 400, 80)
    assert grid.slices >= 8 and grid.blocks >= 9
    assert set(found(hn.mine(frame(spark, rows, 7), F.col("vec_id") % 15 == 0))) == brute(rows, lambda i: i % 15 == 0)


def test_nothing(spark):
    assert found(hn.mine(frame(spark, vectors(5, 4, 1)).limit(0), F.col("vec_id") % 15 == 0)) == []
    assert found(hn.mine(frame(spark, vectors(30, 4, 1)), F.lit(False))) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(500, 64)) / 8)
    q = np.floor(256 * rng.normal(size=(40, 64)) / 8)
    codes, aligned, rest = hn.encode(x)
    least, most = hn.Anchors(q).bounds(np.arange(40), codes, aligned, rest)
    true = q @ x.T
    assert (least <= true).all() and (true <= most).all()
    assert np.mean(most < np.quantile(true, 0.99, axis=1)[:, None]) > 0.5, "the intervals filter"


def test_big_numbers_are_exact_or_refused(spark):
    big = random.Random(1)
    rows = [(i, i % 2, [float(big.randrange(1 << 22)), 1.0]) for i in range(30)]
    assert set(found(hn.mine(frame(spark, rows), F.col("vec_id") % 3 == 0))) == brute(rows, lambda i: i % 3 == 0)
    with pytest.raises(Exception, match="64 bits"):
        hn.mine(frame(spark, [(0, 1, [1e30, 1.0]), (1, 1, [1.0, 1.0])]), F.col("vec_id") == 0).collect()
