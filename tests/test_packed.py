"""Entries in packed form, and the products and listings that travel in it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from matrix_data import from_blocks, from_coo, integers, to_coo
from test_compressed import exchanged

import blockweave as bw
from blockweave.functions import csr_kernels, packed
from blockweave.operators import product
from blockweave.operators.layout import list_in_full

INTS = [
    [], [0], [5, 5, 5], [3, 1, 2], [0, 255], [0, 256, 7], [-4, 70_000, 12], [2**33, 0, -1], [-(2**63), 2**63 - 1, 0], list(range(5000)), [0, 1] * 300,
]
REALS = [
    [], [0.0], [1.0, 2.0, 50.0], [-3.0, 2.0**52], [0.5, 1e300], [float("nan"), 1.0], [float("inf"), -float("inf")], [-0.0, 1.0], [2.0**53, 2.0**60], [0.1] * 400,
]


@pytest.mark.parametrize("close", [False, True])
def test_packed_columns_come_back_bit_for_bit(close):
    for x in INTS:
        [got] = packed.unpack(packed.pack((np.array(x, np.int64), close)))
        assert got.dtype == np.int64 and got.tolist() == x
    for x in REALS:
        [got] = packed.unpack(packed.pack((np.array(x, np.float64), close)))
        assert got.dtype == np.float64 and got.tobytes() == np.array(x, np.float64).tobytes()
    columns = [np.array(x, np.int64) for x in INTS] + [np.array(x, np.float64) for x in REALS] + [np.array([True, False, True])]
    got = packed.unpack(packed.pack(*((x, close) for x in columns)))
    assert [x.tobytes() for x in got[:-1]] == [x.tobytes() for x in columns[:-1]] and got[-1].tolist() == [1, 0, 1]


def _batch(rows):
    types = (pa.bool_(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["is_left", "k", "pos", "v"])


@pytest.mark.parametrize("rows", [3, 50, 1 << 20])
def test_equal_cells_are_added_up_in_chunks_and_in_buckets(monkeypatch, rows):
    monkeypatch.setattr(packed, "PACK_ROWS", rows)
    monkeypatch.setattr(packed, "HELD_ROWS", rows)
    rng = np.random.default_rng(1)
    cells = [(True, int(k), int(p), float(v)) for k, p, v in zip(rng.integers(-5, 5, 900), rng.integers(0, 9, 900), rng.integers(1, 9, 900))]
    cells += [(True, 3, 77, None), (True, 3, 77, None), (True, 4, 77, None), (True, 4, 77, 2.0)]
    out = pa.Table.from_batches(packed.pack_kernel(7)(_batch(cells[n:n + 40]) for n in range(0, len(cells), 40))).sort_by("bucket")
    found = [x for part in packed.by_bucket(out.to_batches()) for x in zip(*(c.tolist() for c in part))]
    want: dict = {}
    for _, k, p, v in cells:
        old = want.get((k, p))
        want[k, p] = v if old is None else old if v is None else old + v
    assert {(k, p): None if null else v for k, p, v, null in found} == want and len(found) == len(want)
    blobs = [len(packed.unpack(x.as_py())[0]) for x in out.column("packed")]
    assert sum(blobs) <= len(want) * (-(-len(cells) // rows) + 1), "a cell leaves a task once for each chunk"
    with pytest.raises(ValueError, match="without an index"):
        list(packed.pack_kernel(7)(iter([_batch([(True, None, 1, 1.0)])])))


def test_entry_product_shuffles_a_few_bytes_an_entry(spark, monkeypatch):
    """by rows of numbers an entry took some 40 bytes in each of four shuffles, and a cell of the result as many."""
    monkeypatch.setattr(product, "RESULT_CELLS", 4000)
    monkeypatch.setattr(product, "LEAST_CELLS", 4000)
    x = np.kron(np.eye(6), integers(3, 50, 60, 0.5))
    coo, turned = (bw.stage(to_coo(spark, m), "packed") for m in (x, x.T))
    got = bw.multiply_coo(coo, turned, dims=(300, 300))
    assert np.array_equal(from_coo(got, (300, 300)), x @ x.T)
    assert 0 < exchanged(got) < 40 * 2 * np.count_nonzero(x)


def test_only_tiles_in_pieces_are_shuffled_once_more(spark, monkeypatch):
    """A tile of rows with most of the entries is cut and added up; both ways out start from one shuffle."""
    monkeypatch.setattr(product, "RESULT_CELLS", 100)
    monkeypatch.setattr(product, "LEAST_CELLS", 100)
    a, b = integers(5, 60, 80, 0.05), integers(6, 80, 50, 0.3)
    a[3:9] = 2.0
    got = bw.multiply_coo(to_coo(spark, a), to_coo(spark, b), dims=(60, 50), share=0.1)
    cells = got.collect()
    out = np.zeros((60, 50))
    for r in cells:
        out[r.i, r.j] += r.v
    assert np.array_equal(out, a @ b) and len({(r.i, r.j) for r in cells}) == len(cells)
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


def test_compressed_product_shuffles_a_few_bytes_an_entry(spark):
    """entries went through two shuffles as rows of numbers, and blocks through two as arrays of 12 bytes a cell."""
    x = np.kron(np.eye(6), integers(8, 64, 96, 0.2))
    coo = [bw.stage(to_coo(spark, m), "packed") for m in (x, x.T)]
    left, right = (bw.coo_to_csr(c, 16, shape) for c, shape in zip(coo, (x.shape, x.shape[::-1])))
    stored = tuple(product.entry_positions(c, 16) for c in coo)
    got = bw.multiply_csr(left, right, fill=0.03, task_bytes=1 << 18, positions=stored)
    assert np.array_equal(from_blocks(got), x @ x.T)
    got.df.collect()
    assert 0 < exchanged(got.df) < 45 * 2 * np.count_nonzero(x)


def test_packed_blocks_keep_every_value(spark):
    """Duplicates that cancel or add up, missing values, values that are not whole or finite, dense blocks of any kind."""
    rows = [(0, 0, 1.5), (0, 0, 1.5), (0, 1, float("inf")), (3, 3, 2.0), (3, 3, -2.0), (5, 2, -0.25), (5, 6, None), (5, 6, 4.0), (6, 6, 1e300)]
    coo = spark.createDataFrame(rows, bw.COO_SCHEMA)
    m = bw.coo_to_csr(coo, 4, (7, 7))
    assert sorted(tuple(r) for r in bw.csr_to_coo(m).collect()) == [(0, 0, 3.0), (0, 1, float("inf")), (5, 2, -0.25), (5, 6, 4.0), (6, 6, 1e300)]
    x = np.random.default_rng(1).normal(size=(8, 8))
    blocks = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([2, 3]), pa.array([[*x.reshape(-1)], [0.0] * 64], csr_kernels.BLOCK_TYPE)], ["br", "bc", "data"])
    [out] = csr_kernels.pack_blocks_kernel(8)(iter([blocks]))
    assert [b.tolist() for b in csr_kernels._operand_blocks(out, 8)] == [x.tolist(), np.zeros((8, 8)).tolist()]


def test_full_listing_shuffles_a_few_bytes_an_entry(spark):
    """every entry of the product was shuffled as a row of three numbers to find the one that follows."""
    x = integers(9, 120, 120, 0.7)
    listed = list_in_full(bw.stage(to_coo(spark, x), "listed"), 120, 120)
    out = np.full(x.shape, np.nan)
    for r in listed.collect():
        assert np.isnan(out[r.i, r.j:r.j + r.times]).all(), "a cell is listed twice"
        out[r.i, r.j:r.j + r.times] = r.v
    assert np.array_equal(out, x)
    assert 0 < exchanged(listed) < 15 * np.count_nonzero(x)


def test_full_listing_keeps_repeats_and_missing_values(spark):
    """A cell listed twice stays twice, so that the count gives it away; a missing value is listed as zero."""
    coo = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 1, None)], bw.COO_SCHEMA)
    listed = list_in_full(coo, 2, 2)
    assert sorted(tuple(r) for r in listed.collect()) == [(0, 0, 1.0, 1), (0, 0, 2.0, 1), (0, 1, 0.0, 1), (1, 0, 0.0, 1), (1, 1, 0.0, 1)]
    with pytest.raises(Exception, match="do not list"):
        bw.infer_square_dim(listed, times="times").collect()


def _spread(spark, name):
    """Groups of rows that share indexes, with their keys interleaved, each cell listed three times."""
    a, b = (np.kron(m, np.eye(5)) for m in (integers(11, 40, 60, 0.5), integers(12, 60, 8, 0.7)))
    frames = []
    for side, x in (("a", a), ("b", b)):
        coo = bw.stage(to_coo(spark, x), f"{name}-{side}")
        frames.append(coo.unionByName(coo).unionByName(coo).coalesce(2))
    return frames, (a.shape[0], b.shape[1]), 9 * (a @ b), np.count_nonzero(a) + np.count_nonzero(b)


def test_rows_spread_over_all_tiles_shuffle_a_few_bytes_a_copy(spark, monkeypatch):
    """each copy of an entry took a row of its own, beside the shuffles by cell and by index."""
    monkeypatch.setattr(product, "RESULT_CELLS", 1000)
    monkeypatch.setattr(product, "LEAST_CELLS", 1000)
    (a, b), dims, want, entries = _spread(spark, "spread")
    got = bw.multiply_coo(a, b, dims=dims)
    assert np.array_equal(from_coo(got, dims), want)
    assert 0 < exchanged(got) < 120 * entries


def test_sketched_product_shuffles_a_few_bytes_a_copy(spark, monkeypatch):
    """the same where a sketch finds the heavy tiles."""
    monkeypatch.setattr(product, "RESULT_CELLS", 1000)
    monkeypatch.setattr(product, "LEAST_CELLS", 1000)
    (a, b), dims, want, entries = _spread(spark, "sketched")
    got = bw.multiply_coo(a, b, dims=dims, search="sketch")
    assert np.array_equal(from_coo(got, dims), want)
    assert 0 < exchanged(got) < 120 * entries
    assert "approx_top_k" in got._jdf.queryExecution().executedPlan().toString()
