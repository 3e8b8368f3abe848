"""Sums of doubles that do not depend on the order or the partitioning of the terms.

Each term is cut into whole numbers of ``BITS`` bits, counted down from a power of two above all terms. Cutting is
exact, and sums of whole numbers are the same in any order, so they are formed like any other sum: inside the JVM,
combined map-side. Only then are a group's few sums put together again, always in the same way. Nothing is lost above
``BITS * BINS`` bits below the largest term of all groups, so sums that cancel come out right where plain ones leave noise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 130 bits in all; a sum of 2 ** 37 terms fits into 64 bits, more of them in one group fail.
BITS = 26
BINS = 5
_BASE = float(1 << BITS)


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def largest(x: Column) -> Column:
    """Aggregate: the largest magnitude of the finite values, 0 if there are none."""
    return F.coalesce(F.max(F.when(_finite(x), F.abs(x))), F.lit(0.0))


def top_of(magnitude: Column) -> Column:
    """An exponent whose power of two lies above ``magnitude``."""
    return F.when(magnitude > 0, F.floor(F.log2(magnitude)) + 2).otherwise(0).cast("int")


def _scaled(x: Column, power: Column) -> Column:
    """``x * 2 ** power``, in two steps, as a single factor might leave the range of doubles."""
    half = F.shiftright(power, 1)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)


def exact_sum(df: DataFrame, keys: list[str], term: Column, top: Column) -> DataFrame:
    """``keys..., v``: the sum of ``term`` per key, the same bits whatever the order; one shuffle with map-side sums.

    All finite terms are below ``2 ** top``, an int column that is the same in all rows. A NaN, or infinities of both
    signs, give NaN; infinities of one sign that infinity. Null terms are left out; a key with nothing else has null.
    """
    rows = df.select(*keys, term.alias("x"), top.alias("top"))
    rows = rows.select(*keys, "x", "top", F.when(_finite(F.col("x")), _scaled(F.col("x"), -F.col("top"))).otherwise(0.0).alias("rest"))
    for n in range(BINS):  # one select a bin, so that each step is computed once
        rows = rows.withColumn("scaled", F.col("rest") * _BASE).withColumn(f"q{n}", F.col("scaled").cast("bigint"))
        rows = rows.withColumn("rest", F.col("scaled") - F.col(f"q{n}").cast("double"))
    x = F.col("x")
    sums = rows.groupBy(*keys).agg(
        F.max("top").alias("top"),
        F.count("x").alias("terms"),
        F.max(F.isnan(x)).alias("nan"),
        F.max((x == float("inf"))).alias("plus"),
        F.max((x == float("-inf"))).alias("minus"),
        *[F.sum(F.when(x.isNotNull(), F.col(f"q{n}"))).alias(f"q{n}") for n in range(BINS)],
    )
    for n in range(BINS - 1, 0, -1):  # carries: all but the first become digits 0 .. 2 ** BITS - 1
        carry = F.shiftright(F.col(f"q{n}"), BITS)
        sums = sums.withColumns({f"q{n - 1}": F.col(f"q{n - 1}") + carry, f"q{n}": F.col(f"q{n}").bitwiseAND(F.lit((1 << BITS) - 1))})
    negative = F.col("q0") < 0

    def digit(n: int) -> Column:
        """Of the magnitude, so that putting the digits together cancels nothing."""
        q = F.col(f"q{n}")
        if n == 0:
            return F.when(negative, -(q + 1)).otherwise(q).cast("double")
        return F.when(negative, (1 << BITS) - (n < BINS - 1) - q).otherwise(q).cast("double")

    total = digit(BINS - 1)
    for n in range(BINS - 2, -1, -1):
        total = digit(n) + total / _BASE
    total = _scaled(total / _BASE, F.col("top"))
    total = F.when(negative, -total).otherwise(total) + F.lit(0.0)
    v = (
        F.when(F.col("terms") == 0, F.lit(None).cast("double"))
        .when(F.col("nan") | (F.col("plus") & F.col("minus")), F.lit(float("nan")))
        .when(F.col("plus"), F.lit(float("inf")))
        .when(F.col("minus"), F.lit(float("-inf")))
        .otherwise(total)
    )
    return sums.select(*keys, v.alias("v"))
