"""Matrices read off the star-schema tables, as triplets.

Every function reads its whole tables with only the columns it needs and returns one row per source row: repeated
(i, j) are for the consuming operator to sum. Values are whole numbers, so sums are exact in any order.

========== ============================== =======================================
name       rows x columns                 value
========== ============================== =======================================
shipped    supplier x ship day of year    quantity
ordered    supplier x order day of year   quantity
transit    ship day x order day           quantity
supplied   supplier x part                quantity
calendar   part x ship day of year        quantity
features   vector x position              embedding, in whole thousandths
========== ============================== =======================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAYS = 366
POSITIONS = 64


# The columns in use; stating their types saves a job that reads a file footer for each scan.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_orderdate timestamp_ntz",
    "supplier": "s_suppkey bigint",
    "part": "p_partkey bigint",
    "embeddings": "vec_id bigint, embedding array<float>",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _day(column: str) -> Column:
    return (F.dayofyear(column) - 1).cast("bigint")


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order's date. ``orders`` has one row per key; a key with very many lines is split by AQE."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("i"), _day("l_shipdate").alias("j"), F.col("l_quantity").alias("v")
    )


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_lines(spark, sf_dir).select(
        F.col("l_suppkey").alias("i"), _day("o_orderdate").alias("j"), F.col("l_quantity").alias("v")
    )


def transit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_lines(spark, sf_dir).select(
        _day("l_shipdate").alias("i"), _day("o_orderdate").alias("j"), F.col("l_quantity").alias("v")
    )


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v")
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("i"), _day("l_shipdate").alias("j"), F.col("l_quantity").alias("v")
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "x"))
    return cells.select(
        F.col("vec_id").alias("i"),
        F.col("j").cast("bigint").alias("j"),
        F.floor(F.col("x").cast("double") * 1000).cast("double").alias("v"),
    )


def raw_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`features`, but with the real numbers as they are."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "x"))
    return cells.select(F.col("vec_id").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("x").cast("double").alias("v"))


def transpose(coo: DataFrame) -> DataFrame:
    return coo.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def _side(df: DataFrame, key: str) -> int:
    """One more than the largest key: a one-row aggregate over one column of a dimension table.

    Building blocks fails if a fact row has a key beyond it.
    """
    largest = df.agg(F.max(key)).first()[0]
    return 0 if largest is None else largest + 1


def suppliers(spark: SparkSession, sf_dir: str) -> int:
    return _side(table(spark, sf_dir, "supplier"), "s_suppkey")


def parts(spark: SparkSession, sf_dir: str) -> int:
    return _side(table(spark, sf_dir, "part"), "p_partkey")


def vectors(spark: SparkSession, sf_dir: str) -> int:
    return _side(table(spark, sf_dir, "embeddings"), "vec_id")


def entries(coo: DataFrame) -> int:
    """Listed entries: a one-row aggregate."""
    return coo.count()
