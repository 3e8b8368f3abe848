from __future__ import annotations

import numpy as np
import pytest
from matrix_data import from_blocks, from_coo, integers, to_blocks, to_coo
from pyspark.sql import functions as F

import blockweave as bw
from blockweave.functions import csr_kernels


def to_csr(spark, x, bs):
    return bw.coo_to_csr(to_coo(spark, x), bs, x.shape)


@pytest.mark.parametrize("shape", [(8, 8), (5, 7), (1, 9), (12, 4)])
@pytest.mark.parametrize("density", [0.05, 0.4, 1.0])
def test_round_trips(spark, shape, density):
    x = integers(1, *shape, density)
    m = to_csr(spark, x, 3)
    assert np.array_equal(from_coo(bw.csr_to_coo(m), shape), x)
    assert np.array_equal(from_blocks(bw.csr_to_blocks(m)), x)
    assert np.array_equal(from_coo(bw.csr_to_coo(bw.blocks_to_csr(to_blocks(spark, x, 3))), shape), x)


def test_pointers_columns_and_values(spark):
    x = np.array([[0, 5, 0, 0], [0, 0, 0, 0], [7, 0, 8, 0], [0, 0, 0, 9]], dtype=float)
    rows = {(r.br, r.bc): (r.starts, r.cols, r.vals) for r in to_csr(spark, x, 2).df.collect()}
    assert rows == {
        (0, 0): ([0, 1, 1], [1], [5.0]),
        (1, 0): ([0, 1, 1], [0], [7.0]),
        (1, 1): ([0, 1, 2], [0, 1], [8.0, 9.0]),
    }


def test_duplicates_zeros_and_bounds(spark):
    coo = spark.createDataFrame([(0, 0, 2.0), (0, 0, -2.0), (1, 1, 3.0), (1, 1, 4.0), (2, 2, 0.0)], bw.COO_SCHEMA)
    m = bw.coo_to_csr(coo, 2, (4, 4))
    assert [tuple(r) for r in bw.csr_to_coo(m).collect()] == [(1, 1, 7.0)]
    assert m.df.count() == 1, "a block of zeros is not stored"
    with pytest.raises(Exception, match="duplicate"):
        bw.coo_to_csr(coo, 2, (4, 4), on_duplicate="error").df.collect()
    with pytest.raises(Exception, match="outside"):
        bw.coo_to_csr(coo, 2, (2, 2)).df.collect()
    assert bw.csr_to_coo(bw.coo_to_csr(coo.limit(0), 2, (4, 4))).count() == 0


@pytest.mark.parametrize("shape", [(8, 8, 8), (5, 3, 7), (33, 40, 21)])
@pytest.mark.parametrize("forms", ["cc", "cd", "dc"])
@pytest.mark.parametrize("task_bytes", [1, 1 << 28])
def test_product(spark, shape, forms, task_bytes):
    m, k, n = shape
    a, b = integers(1, m, k, 0.2), integers(2, k, n, 0.2)
    left, right = ((to_csr if form == "c" else to_blocks)(spark, x, 4) for form, x in zip(forms, (a, b)))
    assert np.array_equal(from_blocks(bw.multiply_csr(left, right, task_bytes=task_bytes)), a @ b)


@pytest.mark.parametrize(("sparse", "dense"), [(0.0, 1.0), (1.0, 0.0)])
def test_both_ways_of_multiplying_agree(spark, monkeypatch, sparse, dense):
    monkeypatch.setattr(csr_kernels, "SPARSE_NS", sparse)
    monkeypatch.setattr(csr_kernels, "DENSE_NS", dense)
    monkeypatch.setattr(csr_kernels, "PAIRS", 7)
    a, b = integers(3, 20, 24, 0.4), integers(4, 24, 16, 0.4)
    for parts in ((to_csr, to_csr), (to_csr, to_blocks), (to_blocks, to_csr)):
        left, right = (f(spark, x, 4) for f, x in zip(parts, (a, b)))
        kernel = csr_kernels.csr_product_kernel(4, (5, 6, 4), (1, 1, 1), False)
        rows = bw.operators.compressed._tagged(left, "A").unionByName(bw.operators.compressed._tagged(right, "B"))
        rows = rows.withColumns({"path": F.lit(0).cast("bigint"), "base": F.lit(0).cast("bigint"), "c": F.expr("if(mat = 'A', bc, br)")}).orderBy("c")
        out = np.zeros((20, 16))
        for batch in kernel(iter(rows.toArrow().to_batches())):  # here, so that the changed costs hold
            for br, bc, data in zip(*(batch.column(n).to_pylist() for n in ("br", "bc", "data"))):
                out[br * 4:br * 4 + 4, bc * 4:bc * 4 + 4] = np.reshape(data, (4, 4))
        assert np.array_equal(out, a @ b)


def test_cells_that_are_not_stored_take_no_part(spark):
    a, b = integers(5, 8, 8, 0.3), integers(6, 8, 8, 0.3)
    b[3, 2], a[1, 6] = np.inf, np.nan
    got = from_blocks(bw.multiply_csr(to_csr(spark, a, 4), to_csr(spark, b, 4)))
    by_entry = from_coo(bw.multiply_coo(to_coo(spark, a), to_coo(spark, b)), (8, 8))
    np.testing.assert_array_equal(got, by_entry)


def exchanged(df) -> int:
    """Bytes of rows that went through shuffles, once ``df`` has run."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                total += node.metrics().apply("dataSize").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return total


def test_compressed_gram_product_moves_a_fraction_of_the_dense_one(spark):
    x = integers(7, 256, 512, 0.03)
    coo = {side: bw.stage(to_coo(spark, m), "gram") for side, m in (("left", x), ("right", x.T))}
    moved = {}
    for form, build, multiply in (("csr", bw.coo_to_csr, bw.multiply_csr), ("dense", bw.coo_to_blocks, bw.multiply_blocks)):
        left, right = (build(coo[side], 64, shape, unique=True) for side, shape in (("left", x.shape), ("right", x.shape[::-1])))
        left, right = (type(m)(bw.stage(m.df, "operand"), m.n_rows, m.n_cols, m.bs) for m in (left, right))
        df = multiply(left, right).df
        df.collect()
        moved[form] = exchanged(df)
    assert 0 < 5 * moved["csr"] < moved["dense"]


def test_shape_mismatch(spark):
    with pytest.raises(ValueError):
        bw.multiply_csr(to_csr(spark, np.ones((4, 4)), 2), to_csr(spark, np.ones((6, 4)), 2))


@pytest.mark.parametrize("task_bytes", [8, 1 << 28])
@pytest.mark.parametrize("nnz", [0.05, 0.5])
def test_blocks_go_only_to_tiles_where_they_meet(spark, task_bytes, nnz):
    a, b = integers(7, 33, 40, nnz), integers(8, 40, 21, nnz)
    a[8:16, :20] = 0
    stored = tuple(bw.operators.product.entry_positions(to_coo(spark, x), 4) for x in (a, b))
    got = bw.multiply_csr(to_csr(spark, a, 4), to_csr(spark, b, 4), task_bytes=task_bytes, positions=stored)
    assert np.array_equal(from_blocks(got), a @ b)


def test_blocks_along_the_diagonal_are_not_copied(spark):
    """Eight times the data along the diagonal: eight times the blocks placed, and not sixty-four."""
    from blockweave.operators import product

    counts = []
    for n in (2, 16):
        x = np.kron(np.eye(n), np.ones((4, 4)))
        m, at = to_csr(spark, x, 2), product.entry_positions(to_coo(spark, x), 2)
        rows = bw.operators.compressed._tagged(m, "A").unionByName(bw.operators.compressed._tagged(m, "B"))
        t = product.Tiling(2, 2 * n, 2, n, 1, n)
        placed, tiles, _ = product.place_where_met(product.tag_path(rows), (at, at), t, 2, 4)
        assert tiles == n * n
        counts.append(placed.count())
    assert counts == [2 * 8, 16 * 8]


def test_compressed_blocks_need_no_group_each(spark):
    text = to_csr(spark, integers(9, 8, 8, 0.5), 2).df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "FlatMapGroupsInArrow" not in text


def test_runs_of_blocks_across_batches():
    import pyarrow as pa

    br, bc = np.repeat(np.arange(5), 6), np.tile(np.repeat(np.arange(2), 3), 5)
    pos, v = np.tile(np.array([2, 0, 3]), 10), np.arange(30.0)
    table = pa.RecordBatch.from_arrays([pa.array(x) for x in (br, bc, pos, v)], ["br", "bc", "pos", "v"])
    whole = pa.Table.from_batches(csr_kernels.compress_runs_kernel(2)(iter([table])))
    for size in (1, 2, 4, 7):
        cut = (table.slice(k, size) for k in range(0, 30, size))
        assert pa.Table.from_batches(csr_kernels.compress_runs_kernel(2)(cut)).to_pylist() == whole.to_pylist()
    assert whole.num_rows == 10
    assert whole.to_pylist()[1] == {"br": 0, "bc": 1, "starts": [0, 1, 3], "cols": [0, 0, 1], "vals": [4.0, 3.0, 5.0]}
