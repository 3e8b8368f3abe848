from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from matrix_data import from_blocks, integers, to_blocks

import blockweave as bw
from blockweave.functions import kernels
from blockweave.functions.kernels import strassen_add
from blockweave.operators.product import TASK_BYTES, choose_tiling, panel_depth


@pytest.mark.parametrize("shape", [(64, 64, 64), (96, 32, 160), (48, 80, 36), (63, 64, 64), (130, 130, 130)])
@pytest.mark.parametrize("leaf", [4, 8, 64])
def test_strassen_adds_to_what_is_there(shape, leaf):
    m, k, n = shape
    a, b, c = integers(1, m, k), integers(2, k, n), integers(3, m, n)
    expected = c + a @ b
    strassen_add(c, a, b, leaf)
    assert np.array_equal(c, expected)


def test_rounding_stays_near_the_dot_product():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(512, 512)), rng.normal(size=(512, 512))
    c = np.zeros((512, 512))
    strassen_add(c, a, b, 32)
    assert np.abs(c - a @ b).max() < 1e-12 * np.abs(a @ b).max() * 10


def test_scratch_space_is_as_the_depth_assumes():
    a, b, c = np.ones((1024, 1024)), np.ones((1024, 1024)), np.zeros((1024, 1024))
    tracemalloc.start()
    strassen_add(c, a, b, 64)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak <= 4 / 3 * (1 / 4 + 1 / 4 + 2 / 4) * a.nbytes * 1.1


@pytest.mark.parametrize("shape", [(8, 8, 8), (5, 3, 7), (40, 33, 21)])
@pytest.mark.parametrize("task_bytes", [1, 6000, 1 << 28])
@pytest.mark.parametrize("min_flops", [0.0, 2e8])
def test_product(spark, shape, task_bytes, min_flops):
    m, k, n = shape
    a, b = integers(1, m, k), integers(2, k, n)
    got = bw.multiply_in_tiles(to_blocks(spark, a, 2), to_blocks(spark, b, 2), leaf=2, task_bytes=task_bytes, min_flops=min_flops)
    assert np.array_equal(from_blocks(got), a @ b)


def test_absent_blocks(spark):
    a, b = integers(1, 24, 24), integers(2, 24, 24)
    a[4:8, :] = 0
    a[:, 12:16] = 0
    b[:, 8:12] = 0
    b[0:4, 0:4] = 0
    got = bw.multiply_in_tiles(to_blocks(spark, a, 4), to_blocks(spark, b, 4), leaf=4)
    assert np.array_equal(from_blocks(got), a @ b)
    plain = bw.multiply_blocks(to_blocks(spark, a, 4), to_blocks(spark, b, 4))
    assert {(r.br, r.bc) for r in got.df.collect()} == {(r.br, r.bc) for r in plain.df.collect()}
    empty = bw.multiply_in_tiles(to_blocks(spark, a * 0, 4), to_blocks(spark, b, 4))
    assert empty.df.count() == 0


def test_values_that_are_not_finite_reach_only_their_rows(spark):
    a, b = integers(1, 16, 16), integers(2, 16, 16)
    a[3, 5] = np.nan
    b[2, 7] = np.inf
    got = from_blocks(bw.multiply_in_tiles(to_blocks(spark, a, 4), to_blocks(spark, b, 4), leaf=4))
    with np.errstate(invalid="ignore"):
        np.testing.assert_array_equal(got, a @ b)


def test_full_panels_go_through_strassen_and_others_do_not(monkeypatch):
    calls = []
    monkeypatch.setattr(kernels, "strassen_add", lambda c, a, b, leaf: calls.append(a.shape))
    import pyarrow as pa

    def rows(stored):
        data = [(0, 0, m, r, c, [1.0] * 4) for c, m, r in stored]
        columns = list(zip(*[(p, b, m, *((r, c) if m == "A" else (c, r)), d) for p, b, m, r, c, d in data]))
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns[:5]), pa.array(columns[5], kernels.BLOCK_TYPE)], ["path", "base", "mat", "br", "bc", "data"])

    kernel = kernels.panel_product_kernel(2, (4, 8, 4), (1, 1, 1), 2, 1, False)
    every = [(c, m, r) for c in range(8) for m in "AB" for r in range(4)]
    list(kernel(iter([rows(every)])))
    assert calls == [(8, 4)] * 4, "eight contracted indexes, two at a time"
    calls.clear()
    list(kernel(iter([rows([x for x in every if x[2] != x[0] % 4])])))
    assert not calls


@pytest.mark.parametrize("grid", [(8, 8, 8), (64, 64, 64), (4000, 4000, 4000), (1, 100000, 1)])
def test_panels_fit_into_a_task(grid):
    bs = 256
    t = choose_tiling(*grid, bs, 1, 64, TASK_BYTES // 3)
    depth = panel_depth(t.tr, t.tk, bs, t.tc, TASK_BYTES)
    held = t.tr * t.tk * 5 / 3 + depth * (t.tr + t.tk) * 4 / 3
    assert depth == 1 or held * 8 * bs * bs <= TASK_BYTES
