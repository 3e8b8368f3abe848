"""Frame schemas and the block-matrix value type.

Two representations are used throughout:

* **coo** - a bare DataFrame ``i BIGINT, j BIGINT, v DOUBLE``, one row per stored entry; an absent entry is zero.
* **blocks** - a :class:`BlockMatrix`: ``br BIGINT, bc BIGINT, data ARRAY<DOUBLE>``, one row per stored ``bs x bs``
  block, row-major; an absent block is zero.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COO_SCHEMA = T.StructType(
    [
        T.StructField("i", T.LongType()),
        T.StructField("j", T.LongType()),
        T.StructField("v", T.DoubleType()),
    ]
)

TAGGED_COO_SCHEMA = T.StructType([T.StructField("mat", T.StringType()), *COO_SCHEMA.fields])

BLOCK_DATA = T.ArrayType(T.DoubleType(), containsNull=False)

BLOCKS_SCHEMA = T.StructType(
    [
        T.StructField("br", T.LongType()),
        T.StructField("bc", T.LongType()),
        T.StructField("data", BLOCK_DATA),
    ]
)


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


@dataclass(frozen=True)
class BlockMatrix:
    """A distributed dense matrix: a blocks frame plus its true dimensions and block side."""

    df: DataFrame
    n_rows: int
    n_cols: int
    bs: int

    @property
    def grid_rows(self) -> int:
        return ceil_div(self.n_rows, self.bs)

    @property
    def grid_cols(self) -> int:
        return ceil_div(self.n_cols, self.bs)

    def with_df(self, df: DataFrame) -> BlockMatrix:
        return replace(self, df=df)

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> BlockMatrix:
        """Keep the blocks for reuse; the lineage stays, so a lost executor only costs recomputation."""
        return self.with_df(self.df.persist(level))

    def unpersist(self) -> BlockMatrix:
        return self.with_df(self.df.unpersist())

    def count_blocks(self) -> DataFrame:
        """One row ``n_blocks BIGINT``: the number of stored blocks."""
        return self.df.agg(F.count("*").alias("n_blocks"))


def check_same_shape(a: BlockMatrix, b: BlockMatrix) -> None:
    if (a.n_rows, a.n_cols, a.bs) != (b.n_rows, b.n_cols, b.bs):
        raise ValueError(
            f"shapes differ: {a.n_rows}x{a.n_cols} (bs {a.bs}) and {b.n_rows}x{b.n_cols} (bs {b.bs})"
        )


def check_product_shape(a: BlockMatrix, b: BlockMatrix) -> None:
    if a.bs != b.bs or a.n_cols != b.n_rows:
        raise ValueError(
            f"cannot multiply {a.n_rows}x{a.n_cols} (bs {a.bs}) by {b.n_rows}x{b.n_cols} (bs {b.bs})"
        )
