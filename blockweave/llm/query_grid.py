"""A stated query set against all rows, in blocks: a grid of cells, each a slice of the rows and a block of the queries.

Rows are dealt into slices and queries into blocks by a hash of their id, so no key is hot. Each cell is one partition,
and a task reads the block first or the slice first, as the caller says, and streams the other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that a cell compares, and rows and queries that it may hold in memory.
CELL_PAIRS = 1 << 32
SLICE_ROWS = 1 << 18
BLOCK_QUERIES = 1 << 15
#: Rows of a slice that are not split further just to occupy more cores.
LEAST_ROWS = 1 << 12


@dataclass(frozen=True)
class Grid:
    slices: int
    blocks: int


def plan(spark, rows: int, queries: int) -> Grid:
    """Enough cells for the work, the memory and the cores; as square in bytes as these allow, which copies the least.

    A row is copied ``blocks`` times and a query ``slices`` times.
    """
    cells = max(rows * queries / CELL_PAIRS, min(2 * spark.sparkContext.defaultParallelism, rows / LEAST_ROWS), 1)
    least_slices, least_blocks = math.ceil(rows / SLICE_ROWS), math.ceil(queries / BLOCK_QUERIES)
    slices = max(1, least_slices, round(math.sqrt(cells * rows / max(queries, 1)) if least_blocks > 1 else cells))
    return Grid(slices, max(1, least_blocks, math.ceil(cells / slices)))


def cells(rows: DataFrame, queries: DataFrame, grid: Grid, row_key: str, query_key: str, queries_first: bool) -> DataFrame:
    """The columns of ``rows`` and ``queries`` (the same ones) with ``cell`` and ``is_query``, one partition a cell."""
    own = F.pmod(F.xxhash64(row_key, F.lit(11)), F.lit(grid.slices)).cast("int")
    of = F.pmod(F.xxhash64(query_key, F.lit(12)), F.lit(grid.blocks)).cast("int")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(grid.blocks - 1)))
    every_slice = F.explode(F.sequence(F.lit(0), F.lit(grid.slices - 1)))
    dealt = rows.select("*", F.lit(False).alias("is_query"), own.alias("slice"), every_block.alias("block"))
    asked = queries.select("*", F.lit(True).alias("is_query"), every_slice.alias("slice"), of.alias("block"))
    both = dealt.unionByName(asked).withColumn("cell", F.col("slice") * grid.blocks + F.col("block")).drop("slice", "block")
    first = F.col("is_query").desc() if queries_first else F.col("is_query")
    return both.repartitionById(grid.slices * grid.blocks, "cell").sortWithinPartitions(first)


def one_per_id(rows: DataFrame, key: str) -> DataFrame:
    """One row of each ``key``, the least by the other columns; moves rows only where a key repeats."""
    from ..sources.staging import stage

    repeated = stage(rows.groupBy(key).count().filter("count > 1").select(key), "repeated-ids")
    if repeated.isEmpty():
        return rows
    rest = [c for c in rows.columns if c != key]
    again = rows.join(repeated, key, "left_semi").groupBy(key).agg(F.min(F.struct(*rest)).alias("one")).select(key, "one.*")
    return rows.join(repeated, key, "left_anti").unionByName(again)
