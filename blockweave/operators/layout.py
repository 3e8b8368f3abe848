"""Changes of representation: tags, block coordinates, coo <-> blocks, operands and quadrants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels, packed
from ..matrix import BLOCKS_SCHEMA, COO_SCHEMA, BlockMatrix, ceil_div
from .packing import grouped_by_bucket


def tag_path(df: DataFrame) -> DataFrame:
    """Mark every row as belonging to the root problem (``path`` 0)."""
    return df.withColumn("path", F.lit(0).cast("bigint"))


def block_coords(coo: DataFrame, bs: int) -> DataFrame:
    """``i, j, v`` -> ``br, bc, ii, jj, v``: block coordinate and offset inside the block."""
    return coo.select(
        F.expr(f"i div {bs}").alias("br"),
        F.expr(f"j div {bs}").alias("bc"),
        (F.col("i") % bs).alias("ii"),
        (F.col("j") % bs).alias("jj"),
        "v",
    )


def unique_cells(coo: DataFrame, on_duplicate: str = "sum", *keys: str) -> DataFrame:
    """One row per (i, j), and per value of ``keys``. The sum is combined map-side, so a cell listed very often costs one row per task.

    ``on_duplicate``: ``"sum"`` adds repeated entries up, ``"error"`` fails the job when there are any.
    """
    total = F.sum("v")
    if on_duplicate == "error":
        total = F.when(F.count("*") > 1, F.raise_error(F.lit("duplicate matrix entry"))).otherwise(total)
    elif on_duplicate != "sum":
        raise ValueError("on_duplicate must be 'sum' or 'error'")
    return coo.groupBy(*keys, "i", "j").agg(total.alias("v"))


def inside(coo: DataFrame, n_rows: int, n_cols: int, column: str = "v") -> DataFrame:
    """The entries, with a check, made as ``column`` is read, that fails the job if one lies outside the matrix rather than losing it."""
    outside = F.expr(f"i < 0 OR j < 0 OR i >= {n_rows} OR j >= {n_cols}")
    failure = F.raise_error(F.lit(f"matrix entry outside {n_rows} x {n_cols}"))
    return coo.select(*[F.when(outside, failure).otherwise(F.col(n)).alias(n) if n == column else n for n in ("i", "j", "v")])


def list_in_full(coo: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """Every cell of a matrix of distinct entries, zeros included: ``i, j, v, times``, the last one the cells of row ``i``
    from ``j`` on that hold ``v``.

    An entry is a row of its own and a run of absent cells is one row, found from the entries on both sides of it. So
    there are at most two rows for an entry and one for a row of the matrix, and not one for each of its cells. What is
    shuffled are packed entries, once.
    """
    edges = coo.sparkSession.range(n_rows).select(F.col("id").alias("k"), F.lit(-1).cast("bigint").alias("pos"), F.lit(0.0).alias("v"))
    cells = inside(coo, n_rows, n_cols, "j").where("j IS NOT NULL")
    cells = cells.select(F.col("i").alias("k"), F.col("j").alias("pos"), F.coalesce("v", F.lit(0.0)).alias("v"))
    dealt = grouped_by_bucket(edges.unionByName(cells).withColumn("is_left", F.lit(True)), sums=False)
    return dealt.mapInArrow(packed.list_kernel(n_cols), T.StructType([*COO_SCHEMA.fields, T.StructField("times", T.LongType())]))


def tagged_coo_to_blocks(tagged: DataFrame, bs: int, dims: tuple[int, int, int], on_duplicate: str = "sum") -> DataFrame:
    """Both operands of a product, rows x inner and inner x cols, as blocks ``mat, br, bc, data`` in one pass.

    The frame keeps ``mat``, so one scan and the two shuffles of :func:`coo_to_blocks` serve both.
    """
    rows, inner, cols = dims
    cells = unique_cells(tagged, on_duplicate, "mat")
    outside = F.expr(
        f"mat NOT IN ('A', 'B') OR i < 0 OR j < 0 OR i >= if(mat = 'A', {rows}, {inner}) OR j >= if(mat = 'A', {inner}, {cols})"
    )
    failure = F.raise_error(F.lit(f"matrix entry outside {rows} x {inner} x {cols}"))
    placed = cells.select(
        "mat",
        F.expr(f"i div {bs}").alias("br"),
        F.expr(f"j div {bs}").alias("bc"),
        F.expr(f"int((i % {bs}) * {bs} + j % {bs})").alias("pos"),
        F.when(outside, failure).otherwise(F.col("v")).alias("v"),
    )
    schema = T.StructType([T.StructField("mat", T.StringType()), *BLOCKS_SCHEMA.fields])
    return placed.groupBy("mat", "br", "bc").applyInArrow(kernels.fill_kernel(bs, ["mat", "br", "bc"]), schema)


def coo_to_blocks(
    coo: DataFrame, bs: int, dims: tuple[int, int], on_duplicate: str = "sum", unique: bool = False
) -> BlockMatrix:
    """Entries -> dense blocks; absent entries are zero and a block without entries is not stored.

    Two shuffles: by cell, which removes duplicates, and by block, where a group then holds at most ``bs * bs`` rows
    however skewed the input is. ``unique=True`` promises distinct cells and saves the first one. An entry outside
    ``dims`` fails the job rather than vanishing.
    """
    cells = coo if unique else unique_cells(coo, on_duplicate)
    placed = inside(cells, *dims).select(
        F.expr(f"i div {bs}").alias("br"),
        F.expr(f"j div {bs}").alias("bc"),
        F.expr(f"int((i % {bs}) * {bs} + j % {bs})").alias("pos"),
        "v",
    )
    blocks = placed.groupBy("br", "bc").applyInArrow(kernels.fill_kernel(bs), BLOCKS_SCHEMA)
    return BlockMatrix(blocks, *dims, bs)


def blocks_to_coo(m: BlockMatrix, drop_zeros: bool = True) -> DataFrame:
    """Dense blocks -> entries of the true matrix (edge padding is cut off)."""
    cells = m.df.select("br", "bc", F.posexplode("data").alias("pos", "v")).select(
        (F.col("br") * m.bs + F.expr(f"pos div {m.bs}")).alias("i"),
        (F.col("bc") * m.bs + F.col("pos") % m.bs).alias("j"),
        "v",
    )
    cells = cells.where((F.col("i") < m.n_rows) & (F.col("j") < m.n_cols))
    return cells.where("v <> 0") if drop_zeros else cells


def union_operands(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both operands in one frame, told apart by ``mat``."""
    return a.select(F.lit("A").alias("mat"), "*").unionByName(b.select(F.lit("B").alias("mat"), "*"))


def select_operand(tagged: DataFrame, mat: str) -> DataFrame:
    """The rows of one operand, without the tag."""
    return tagged.where(F.col("mat") == mat).drop("mat")


def half_grid(m: BlockMatrix) -> tuple[int, int]:
    """Rows and columns of a quadrant in blocks; an odd grid is rounded up, the missing blocks being zero."""
    return ceil_div(m.grid_rows, 2), ceil_div(m.grid_cols, 2)


def quadrant_split(m: BlockMatrix) -> DataFrame:
    """Tag each block with its quadrant (``qr``, ``qc``) and make its coordinates relative to it."""
    hr, hc = half_grid(m)
    return m.df.select(
        F.expr(f"br div {hr}").alias("qr"),
        F.expr(f"bc div {hc}").alias("qc"),
        (F.col("br") % hr).alias("br"),
        (F.col("bc") % hc).alias("bc"),
        "data",
    )


def quadrant(m: BlockMatrix, qr: int, qc: int) -> BlockMatrix:
    """One quadrant as a matrix of its own, of half-grid size.

    Chosen by a range of ``br`` and ``bc``, a filter that a parquet scan of the blocks can use to skip row groups.
    """
    hr, hc = half_grid(m)
    rows = F.col("br") >= hr if qr else F.col("br") < hr
    cols = F.col("bc") >= hc if qc else F.col("bc") < hc
    df = m.df.where(rows & cols).select(
        (F.col("br") - qr * hr).alias("br"), (F.col("bc") - qc * hc).alias("bc"), "data"
    )
    return BlockMatrix(df, hr * m.bs, hc * m.bs, m.bs)


def coo_quadrant(
    coo: DataFrame, bs: int, dims: tuple[int, int], qr: int, qc: int, on_duplicate: str = "sum", unique: bool = False
) -> BlockMatrix:
    """One quadrant straight from entries: those of the others are dropped before anything is shuffled or filled."""
    whole = BlockMatrix(coo, *dims, bs)
    hr, hc = half_grid(whole)
    rows = F.col("i") >= hr * bs if qr else F.col("i") < hr * bs
    cols = F.col("j") >= hc * bs if qc else F.col("j") < hc * bs
    return quadrant(coo_to_blocks(coo.where(rows & cols), bs, dims, on_duplicate, unique), qr, qc)


def trim(blocks: DataFrame, n_rows: int, n_cols: int, bs: int) -> BlockMatrix:
    """Cut the padding off: drop blocks outside the matrix and zero the cells outside it in edge blocks.

    Sums that cancel leave rounding noise there.
    """
    m = BlockMatrix(blocks.select("br", "bc", "data"), n_rows, n_cols, bs)
    rows, cols = n_rows - F.col("br") * bs, n_cols - F.col("bc") * bs
    inside = F.transform(
        "data", lambda x, pos: F.when((pos / bs < rows) & (pos % bs < cols), x).otherwise(F.lit(0.0))
    )
    data = F.when((rows < bs) | (cols < bs), inside).otherwise(F.col("data"))
    return m.with_df(m.df.where((rows > 0) & (cols > 0)).select("br", "bc", data.alias("data")))


def quadrant_assemble(
    q11: BlockMatrix, q12: BlockMatrix, q21: BlockMatrix, q22: BlockMatrix, dims: tuple[int, int]
) -> BlockMatrix:
    """The matrix whose quadrants are given; ``dims`` are its true dimensions."""
    hr, hc = q11.grid_rows, q11.grid_cols
    shifted = [
        q.df.select((F.col("br") + r * hr).alias("br"), (F.col("bc") + c * hc).alias("bc"), "data")
        for q, r, c in ((q11, 0, 0), (q12, 0, 1), (q21, 1, 0), (q22, 1, 1))
    ]
    whole = BlockMatrix(reduce(DataFrame.unionByName, shifted), *dims, q11.bs)
    return whole.with_df(
        whole.df.where((F.col("br") < whole.grid_rows) & (F.col("bc") < whole.grid_cols))
    )
