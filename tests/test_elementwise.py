from __future__ import annotations

import numpy as np
import pytest
from matrix_data import from_blocks, from_coo, integers, to_blocks, to_coo
from pyspark.sql import functions as F

import blockweave as bw

A = integers(1, 5, 7, 0.4)
B = integers(2, 5, 7, 0.4)


def test_entries(spark):
    a, b = to_coo(spark, A), to_coo(spark, B)
    assert np.array_equal(from_coo(bw.add_coo(a, b), A.shape), A + B)
    assert np.array_equal(from_coo(bw.subtract_coo(a, b), A.shape), A - B)
    assert np.array_equal(from_coo(bw.scale_coo(a, -3), A.shape), -3 * A)


def test_stamp(spark):
    a, b = to_coo(spark, A), to_coo(spark, B)
    stamped = bw.add_coo(a, b, stamp=(2, 3))
    assert stamped.columns == ["br", "bc", "i", "j", "v"]
    assert stamped.select("br", "bc").distinct().collect() == [(2, 3)]


def test_more_than_two_values_per_cell(spark):
    a = to_coo(spark, A)
    assert np.array_equal(from_coo(bw.add_coo(a.union(a), a), A.shape), 3 * A)


@pytest.mark.parametrize("bs", [1, 2, 4, 16])
def test_blocks(spark, bs):
    a, b = to_blocks(spark, A, bs), to_blocks(spark, B, bs)
    assert np.array_equal(from_blocks(bw.add_blocks(a, b)), A + B)
    assert np.array_equal(from_blocks(bw.subtract_blocks(a, b)), A - B)
    assert np.array_equal(from_blocks(bw.scalar_multiply(a, 2.5)), 2.5 * A)


def test_block_missing_on_either_side(spark):
    x, y = np.kron(np.diag([1.0, 0.0]), np.ones((2, 2))), np.kron(np.diag([0.0, 1.0]), np.ones((2, 2)))
    a, b = to_blocks(spark, x, 2), to_blocks(spark, y, 2)
    assert np.array_equal(from_blocks(bw.subtract_blocks(a, b)), x - y)
    assert np.array_equal(from_blocks(bw.add_blocks(a, b)), x + y)


def test_identities(spark):
    a, b = to_blocks(spark, A, 2), to_blocks(spark, B, 2)
    assert np.array_equal(from_blocks(bw.subtract_blocks(bw.add_blocks(a, b), b)), A)
    left = bw.scalar_multiply(bw.add_blocks(a, b), 3)
    right = bw.add_blocks(bw.scalar_multiply(a, 3), bw.scalar_multiply(b, 3))
    assert np.array_equal(from_blocks(left), from_blocks(right))
    assert bw.blocks_to_coo(bw.subtract_blocks(a, a)).count() == 0


def test_no_negative_zero(spark):
    a = to_coo(spark, A)
    texts = bw.subtract_coo(a, a).select(F.col("v").cast("string").alias("t")).distinct().collect()
    assert [r.t for r in texts] == ["0.0"]
    scaled = bw.scalar_multiply(to_blocks(spark, A, 4), -0.0).df.select(F.explode("data").alias("v"))
    assert [r.t for r in scaled.select(F.col("v").cast("string").alias("t")).distinct().collect()] == ["0.0"]


def test_signed_sum(spark):
    rows = [
        ("A", 1, 1.0, [1.0, 2.0, 3.0, 4.0]),
        ("A", 1, -1.0, [1.0, 1.0, 1.0, 1.0]),
        ("B", 1, 2.0, [1.0, 0.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "mat string, path long, s double, data array<double>")
    got = {r.mat: list(r.data) for r in bw.signed_sum(df, ["mat", "path"], 2).collect()}
    assert got == {"A": [0, 1, 2, 3], "B": [2, 0, 0, 0]}


def test_shapes_must_agree(spark):
    with pytest.raises(ValueError):
        bw.add_blocks(to_blocks(spark, A, 2), to_blocks(spark, B.T, 2))
