"""Sharding by sampled splitters.

A size-weighted sample of keys gives quantile boundaries; records are dealt to the ranges between them; a range that
holds more than its share of bytes is subdivided by further splitters inside it, and a key that is too heavy alone (a
third of all rows, say) gets a range of its own, dealt by row. The ranges then lie end to end on a line of bytes that is
cut into equal shards, so the law is ``bytes``. Only per-range totals and the samples, all bounded by parameters, reach
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage

#: Ranges that the splitters cut for each shard, and keys drawn for each range.
RANGES_PER_SHARD = 64
SAMPLE_PER_RANGE = 32
#: A group of equal keys stays together up to this share of a shard's bytes.
GROUP_SHARE = 0.002


def sample_keys(rows: DataFrame, total: int, size: int) -> np.ndarray:
    """Sorted keys; each row is drawn with a chance in proportion to its size, about ``size`` of them.

    The draw depends on a hash of the row's number, so a task that runs again draws the same keys. A row heavier than
    a whole step is drawn once: it makes one boundary, however heavy it is.
    """
    u = (F.xxhash64(F.col("rid"), F.lit(7)).cast("double") / F.lit(float(1 << 64))) + 0.5
    drawn = rows.filter(u * F.lit(float(total)) < F.col("size") * F.lit(float(size))).select("key")
    return np.sort(drawn.toPandas()["key"].to_numpy(dtype=np.int64))


def splitters(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Quantile boundaries of the sampled keys, without repeats."""
    if not len(keys):
        return keys
    at = (np.arange(1, ranges) * len(keys)) // ranges
    return np.unique(keys[at])


def inner_splitters(rows: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Boundaries inside overfull ranges, whose ``rows`` (key, size) these are; about three for each fair range of bytes.

    Keys are summed first and drawn with a chance in proportion to their bytes, so keys of more than a step are all
    there with their bytes and others stand for a step. A key heavier than a fair range gets boundaries on both sides.
    """
    fair, step = total / ranges, total / (ranges * SAMPLE_PER_RANGE)
    keys = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    u = (F.xxhash64(F.col("key"), F.lit(17)).cast("double") / F.lit(float(1 << 64))) + 0.5
    drawn = keys.filter(u * F.lit(step) < F.col("bytes")).orderBy("key").toPandas()
    out, filled = [], 0.0
    for key, weight in zip(drawn["key"].tolist(), np.maximum(drawn["bytes"].to_numpy(dtype=float), step).tolist(), strict=True):
        if weight > fair:
            out += [key, key + 1] if key < np.iinfo(np.int64).max else [key]
            filled = 0.0
            continue
        if filled + weight > fair:
            out.append(key)
            filled = 0.0
        filled += weight
    return np.array(out, dtype=np.int64)


def range_of(key: Column, bounds: np.ndarray) -> Column:
    """Number of the range that a key lies in (keys equal to a boundary lie above it)."""

    @F.pandas_udf("int")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.searchsorted(bounds, batch.to_numpy(), side="right").astype(np.int32))

    return search(key)


def shard_by_bytes(
    docs: DataFrame, shards: int, ranges_per_shard: int = RANGES_PER_SHARD, group_share: float = GROUP_SHARE
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row of ``docs``.

    size: UTF-8 bytes of the text (null: none) plus 1. Rows are laid out by a hash of their text, so equal texts are
    neighbours; a group of them that is no larger than ``group_share`` of a shard stays in one. Shards differ in bytes by
    little more than the groups or rows at their borders. Null texts count as empty; null ids are kept; repeated rows
    are laid out side by side, each with a slot of its own; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = stage(slim, "shard-keys")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    ranges = shards * ranges_per_shard
    bounds = splitters(sample_keys(rows, total, ranges * SAMPLE_PER_RANGE), ranges)
    ranged = rows.withColumn("range", range_of(F.col("key"), bounds))

    # Subdivide overfull ranges; a fair range holds total / ranges bytes, and cells hold about four of those at most.
    most = 4.0 * total / ranges
    overfull = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > most).select("range")
    numbers = [r["range"] for r in overfull.collect()]  # at most ranges / 4
    if numbers:
        inner = inner_splitters(ranged.filter(F.col("range").isin(numbers)), total, ranges)
        bounds = np.union1d(bounds, inner)
        ranged = rows.withColumn("range", range_of(F.col("key"), bounds))
    # Only rows of a single key are dealt by row, and none of a group that is to stay whole.
    fill = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), (F.min("key") == F.max("key")).alias("single"))
    heavy = F.col("single") & (F.col("bytes") > F.lit(group_share * total / shards))
    parts = fill.select("range", F.when(heavy, F.ceil(F.col("bytes") / F.lit(most))).otherwise(1).cast("int").alias("parts"))
    dealt = ranged.join(F.broadcast(parts), "range").withColumn("cell", F.pmod(F.xxhash64("rid"), F.col("parts")))
    dealt = stage(dealt.select("doc_id", "size", "text_crc32", "key", "rid", "range", "cell"), "shard-cells")

    # At most one row per range and per part of one: about 4 * ranges + ranges / 4 cells.
    cells = dealt.groupBy("range", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).toPandas()
    cells = cells.sort_values(["range", "cell"])
    cells["byte0"] = cells["bytes"].cumsum() - cells["bytes"]
    cells["row0"] = cells["n"].cumsum() - cells["n"]
    starts = docs.sparkSession.createDataFrame(
        cells[["range", "cell", "byte0", "row0"]], "range int, cell bigint, byte0 bigint, row0 bigint"
    )

    in_cell = Window.partitionBy("range", "cell").orderBy("key", "doc_id", "rid")
    before = in_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("range", "cell", "key")
    placed = (
        dealt.join(F.broadcast(starts), ["range", "cell"])
        .withColumn("upto", F.sum("size").over(before))
        .withColumn("row", F.col("row0") + F.row_number().over(in_cell) - 1)
        .withColumn("group_bytes", F.sum("size").over(group))
        .withColumn("group_upto", F.max("upto").over(group))
    )
    whole = F.col("group_bytes") <= F.lit(group_share * total / shards)
    middle = F.when(whole, F.col("group_upto") - F.col("group_bytes") / 2).otherwise(F.col("upto") - F.col("size") / 2)
    shard = F.floor((F.col("byte0") + middle) * F.lit(shards / total)).cast("int")
    placed = placed.select("doc_id", "size", "text_crc32", F.least(shard, F.lit(shards - 1)).alias("shard"), "row")
    placed = stage(placed, "shard-rows")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")
    )
