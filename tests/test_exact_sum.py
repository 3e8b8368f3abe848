from __future__ import annotations

import math
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import blockweave as bw
from blockweave.functions.exact_sum import exact_sum, largest, top_of


def bits(x: float | None):
    return None if x is None else struct.pack("<d", x)


def summed(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "k int, x double").repartition(parts)
    top = df.agg(largest(F.col("x")).alias("m")).select(top_of(F.col("m"))).scalar()
    return {r.k: r.v for r in exact_sum(df, ["k"], F.col("x"), top).collect()}


def terms(seed: int) -> list[tuple[int, float]]:
    """Groups of terms over many magnitudes, most of which cancel."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(20):
        x = rng.normal(size=200) * 10.0 ** rng.integers(-9, 9, 200)
        rows += [(k, float(v)) for v in x] + [(k, float(-v)) for v in x[: 200 - k]] + [(k, float(rng.normal()) * 1e-9)]
    rng.shuffle(rows)
    return [(int(k), float(v)) for k, v in rows]


def test_sums_are_those_of_exact_arithmetic(spark):
    rows = terms(1)
    got = summed(spark, rows)
    for k in range(20):
        true = math.fsum(v for n, v in rows if n == k)
        assert abs(got[k] - true) <= 2 * math.ulp(true)


@pytest.mark.parametrize("seed", [2, 3])
def test_same_bits_for_any_partitions(spark, seed):
    rows = terms(seed)
    found = [{k: bits(v) for k, v in summed(spark, order, parts).items()} for parts, order in ((1, rows), (3, rows[::-1]), (50, sorted(rows)))]
    assert found[0] == found[1] == found[2]
    plain = [{r.k: bits(r.v) for r in spark.createDataFrame(o, "k int, x double").coalesce(1).groupBy("k").agg(F.sum("x").alias("v")).collect()} for o in (rows, rows[::-1])]
    assert plain[0] != plain[1], "the plain sum depends on the order of these terms"


def test_special_values(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, None), (1, 1.0), (1, None), (2, inf), (2, 3.0), (3, -inf), (4, inf), (4, -inf), (5, nan), (6, 0.0), (6, -0.0), (8, -1.5)]
    got = summed(spark, rows)
    assert got[0] is None and got[1] == 1.0 and got[2] == inf and got[3] == -inf and math.isnan(got[4]) and math.isnan(got[5])
    assert bits(got[6]) == bits(0.0) and got[8] == -1.5
    assert summed(spark, [(0, 1e308), (0, -1e308), (0, 0.5), (1, 1e308)]) == {0: 0.0, 1: 1e308}, "130 bits below the largest term nothing is kept"
    assert summed(spark, [(0, 0.0), (1, -0.0)]) == {0: 0.0, 1: 0.0}
    assert summed(spark, [(0, 5e-324), (0, 5e-324), (1, -5e-324)]) == {0: 1e-323, 1: -5e-324}
    assert summed(spark, [(0, -1.0), (0, 2.0**-60), (1, 1.0), (1, -(2.0**-53)), (2, -1.0), (2, 1.0 - 2.0**-53)]) == {0: -1.0, 1: 1 - 2.0**-53, 2: -(2.0**-53)}
    assert summed(spark, [(0, None)]) == {0: None}


def reals(spark, seed, rows, cols):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, cols)) * 10.0 ** rng.integers(-6, 6, (rows, cols))
    return spark.createDataFrame([(i, j, float(x[i, j])) for i, j in np.ndindex(rows, cols)], bw.COO_SCHEMA)


def result(df):
    return {(r.i, r.j): bits(r.v) for r in df.collect()}


def test_product_and_sum_have_the_same_bits_for_3_and_200_partitions(spark):
    a, b = reals(spark, 1, 12, 60), reals(spark, 2, 60, 10)
    twice = a.unionByName(reals(spark, 3, 12, 60))
    found = []
    for parts in (3, 200):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        left, right, both = (x.repartition(parts) for x in (a, b, twice))
        found.append((result(bw.multiply_coo(left, right, reproducible=True)), result(bw.multiply_coo(both, right, reproducible=True, split_heavy=False)), result(bw.add_coo(both, left, reproducible=True))))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert found[0] == found[1]
    assert len(found[0][0]) == 120 and len(found[0][2]) == 720


def test_one_map_side_sum_before_the_shuffle(spark):
    df = exact_sum(reals(spark, 4, 5, 5), ["i"], F.col("v"), F.lit(40))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in text and len(re.findall(r"Exchange hashpartitioning", text)) == 1
