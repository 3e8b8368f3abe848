"""Element-wise arithmetic on coo frames and block matrices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact_sum, kernels
from ..matrix import BLOCK_DATA, BlockMatrix, check_same_shape
from .layout import trim


def sum_coo(coo: DataFrame) -> DataFrame:
    """Repeated entries added up to the same bits, whatever their order and partitions; reads ``coo`` twice."""
    top = coo.select(exact_sum.top_of(exact_sum.largest(F.col("v"))).alias("top")).scalar()
    return exact_sum.exact_sum(coo, ["i", "j"], F.col("v"), top)


def add_coo(a: DataFrame, b: DataFrame, stamp: tuple[int, int] | None = None, reproducible: bool = False) -> DataFrame:
    """A + B by entry; ``stamp`` puts a given block coordinate (``br``, ``bc``) on every row of the result.

    One shuffle with map-side sums: an entry may repeat, in either operand, any number of times. Sums of real numbers
    depend on their order in the last bits unless ``reproducible``.
    """
    total = a.select("i", "j", "v").unionByName(b.select("i", "j", "v"))
    total = sum_coo(total) if reproducible else total.groupBy("i", "j").agg((F.sum("v") + F.lit(0.0)).alias("v"))
    if stamp is None:
        return total
    return total.select(
        F.lit(stamp[0]).cast("bigint").alias("br"), F.lit(stamp[1]).cast("bigint").alias("bc"), "i", "j", "v"
    )


def subtract_coo(a: DataFrame, b: DataFrame) -> DataFrame:
    """A - B by entry, on the union of both supports; cells that cancel are kept as explicit zeros."""
    return add_coo(a, scale_coo(b, -1.0))


def scale_coo(a: DataFrame, factor: float) -> DataFrame:
    return a.select("i", "j", (F.col("v") * F.lit(float(factor)) + F.lit(0.0)).alias("v"))


def _zip_blocks(a: BlockMatrix, b: BlockMatrix, sign: float) -> BlockMatrix:
    """A + sign * B. Block coordinates are unique, so this is an even, one-to-one join; an absent block is zero."""
    check_same_shape(a, b)
    right = b.df.select("br", "bc", F.col("data").alias("other"))

    def signed(x: Column) -> Column:
        return x if sign == 1.0 else F.lit(0.0) - x

    data = (
        F.when(F.col("other").isNull(), F.col("data"))
        .when(F.col("data").isNull(), F.transform("other", signed))
        .otherwise(F.zip_with("data", "other", lambda x, y: x + y if sign == 1.0 else x - y))
    )
    return a.with_df(a.df.join(right, ["br", "bc"], "full_outer").select("br", "bc", data.alias("data")))


def add_blocks(a: BlockMatrix, b: BlockMatrix) -> BlockMatrix:
    return _zip_blocks(a, b, 1.0)


def subtract_blocks(a: BlockMatrix, b: BlockMatrix) -> BlockMatrix:
    return _zip_blocks(a, b, -1.0)


def scalar_multiply(m: BlockMatrix, factor: float) -> BlockMatrix:
    """``factor`` times every cell of the matrix; a factor that is not finite makes no cells of the padding."""
    data = F.transform("data", lambda x: x * F.lit(float(factor)) + F.lit(0.0))
    product = m.with_df(m.df.select("br", "bc", data.alias("data")))
    return product if math.isfinite(factor) else trim(product.df, m.n_rows, m.n_cols, m.bs)


def signed_sum(
    df: DataFrame, keys: list[str], bs: int, binary: bool = False, dims: tuple[int, int] | None = None
) -> DataFrame:
    """Per key, the sum of ``s * data`` over its rows; blocks stream through one accumulator per group.

    Keys keep their types (``mat`` is a string, all others are numbers). With ``dims``, the true dimensions of a matrix
    keyed by ``br, bc``, the padding of edge blocks is cleared.
    """
    fields = [T.StructField(k, T.StringType() if k == "mat" else T.LongType()) for k in keys]
    schema = T.StructType([*fields, T.StructField("data", T.BinaryType() if binary else BLOCK_DATA)])
    rows = df.select(*keys, F.col("s").cast("double").alias("s"), "data")
    return rows.groupBy(*keys).applyInArrow(kernels.signed_sum_kernel(keys, bs, binary, dims), schema)
