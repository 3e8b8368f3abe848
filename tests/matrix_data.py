"""Matrices to and from frames, for the tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from blockweave import COO_SCHEMA, BlockMatrix, coo_to_blocks


def to_coo(spark: SparkSession, x: np.ndarray, zeros: bool = False) -> DataFrame:
    rows = [(int(i), int(j), float(x[i, j])) for i, j in np.ndindex(*x.shape) if zeros or x[i, j] != 0]
    return spark.createDataFrame(rows, COO_SCHEMA)


def to_blocks(spark: SparkSession, x: np.ndarray, bs: int) -> BlockMatrix:
    return coo_to_blocks(to_coo(spark, x), bs, x.shape)


def from_coo(df: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    seen = set()
    for r in df.collect():
        assert (r.i, r.j) not in seen, "cell appears twice"
        seen.add((r.i, r.j))
        out[r.i, r.j] = r.v
    return out


def from_blocks(m: BlockMatrix) -> np.ndarray:
    """The true matrix; also checks that stored padding is zero and blocks are distinct."""
    full = np.zeros((m.grid_rows * m.bs, m.grid_cols * m.bs))
    seen = set()
    for r in m.df.collect():
        assert (r.br, r.bc) not in seen, "block appears twice"
        seen.add((r.br, r.bc))
        full[r.br * m.bs:(r.br + 1) * m.bs, r.bc * m.bs:(r.bc + 1) * m.bs] = np.reshape(r.data, (m.bs, m.bs))
    assert not full[m.n_rows:].any() and not full[:, m.n_cols:].any()
    return full[: m.n_rows, : m.n_cols]


def integers(seed: int, rows: int, cols: int, density: float = 1.0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.integers(-9, 10, (rows, cols)).astype(float)
    return np.where(rng.random((rows, cols)) < density, x, 0.0)
