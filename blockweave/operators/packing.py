"""Shuffles of entries in packed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import packed

PACKED_SCHEMA = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("is_left", T.BooleanType()), T.StructField("packed", T.BinaryType())])
#: Buckets of packed entries for each task worth having; one bucket is held at a time.
BUCKETS = 4


def wanted_tasks(spark: SparkSession) -> int:
    """Tasks worth having: the shuffle partitions that the session asks for, or twice its cores if those are more."""
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(asked, 2 * spark.sparkContext.defaultParallelism)


def grouped_by_bucket(entries: DataFrame, sums: bool = True) -> DataFrame:
    """Entries ``is_left, k, pos, v`` as packed rows ``part, bucket, is_left, packed``, in the order of the bucket.

    One exchange, after which all entries with the same ``k`` are in one bucket and partition; with ``sums`` equal cells are
    added up on the way, as far as they meet.
    """
    parts = wanted_tasks(entries.sparkSession)
    buckets = min(BUCKETS * parts, 1 << 15)
    parts = min(parts, buckets)
    rows = entries.select("is_left", "k", "pos", "v").mapInArrow(packed.pack_kernel(buckets, sums), PACKED_SCHEMA)
    dealt = rows.withColumn("part", F.expr(f"int(bucket * {parts}L div {buckets}L)")).repartitionById(parts, "part")
    return dealt.sortWithinPartitions("part", "bucket")
