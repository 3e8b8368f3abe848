"""Strassen's product as a dataflow of tagged blocks.

A block of a sub-problem carries ``path``, the base-7 number of its place in the recursion (root 0, child
``path * 7 + m - 1``). Only the logical grid is padded to a multiple of ``2 ** levels``; padding blocks are absent
rows and cost nothing. The number of stages depends on ``levels`` alone, never on the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.coefficients import A_TERMS, B_TERMS, C_TERMS, nested_terms, operand_table, output_table
from ..matrix import BLOCK_DATA, BlockMatrix, ceil_div, check_product_shape
from ..sources.staging import owned, stage
from .elementwise import add_blocks, signed_sum, subtract_blocks
from .layout import quadrant, tag_path, trim, union_operands
from .product import TASK_BYTES, multiply_blocks, tile_products

OPERAND_SCHEMA = T.StructType(
    [
        T.StructField("mat", T.StringType()),
        *[T.StructField(name, T.LongType()) for name in ("path", "br", "bc")],
        T.StructField("data", T.BinaryType()),
    ]
)
OPERAND_ARRAY_SCHEMA = T.StructType([*OPERAND_SCHEMA.fields[:4], T.StructField("data", BLOCK_DATA)])


@dataclass(frozen=True)
class Grid:
    """Rows, inner side and columns of a product in blocks."""

    rows: int
    inner: int
    cols: int

    def sub_grids(self, levels: int) -> list[Grid]:
        """The grids of the sub-problems at levels 1 to ``levels``.

        Padded once, for the deepest level, so that every level halves evenly and no two quadrants overlap.
        """
        leaf = [ceil_div(side, 2**levels) for side in (self.rows, self.inner, self.cols)]
        return [Grid(*(side * 2 ** (levels - level) for side in leaf)) for level in range(1, levels + 1)]


def product_grid(a: BlockMatrix, b: BlockMatrix) -> Grid:
    check_product_shape(a, b)
    return Grid(a.grid_rows, a.grid_cols, b.grid_cols)


def tagged_operands(a: BlockMatrix, b: BlockMatrix) -> DataFrame:
    """Both operands as the root problem of one stream: ``mat, path, br, bc, data``."""
    return tag_path(union_operands(a.df, b.df)).select("mat", "path", "br", "bc", "data")


def _quadrant_columns(sub: Grid) -> dict:
    """Quadrant and in-quadrant coordinates of operand blocks, whose sub-grids differ between A and B."""
    rows = f"if(mat = 'A', {sub.rows}L, {sub.inner}L)"
    cols = f"if(mat = 'A', {sub.inner}L, {sub.cols}L)"
    return {
        "qr": F.expr(f"br div {rows}"),
        "qc": F.expr(f"bc div {cols}"),
        "br": F.expr(f"br % {rows}"),
        "bc": F.expr(f"bc % {cols}"),
    }


# --- one level at a time, through the coefficient tables ---------------------------------------------------------


def strassen_replicate(operands: DataFrame, sub: Grid) -> DataFrame:
    """Send each block to the sub-problems that need its quadrant: ``mat, path, m, s, br, bc, data``.

    A join with the 24-row table of operand terms, whose fixed size is what allows broadcasting it.
    """
    table = F.broadcast(operand_table(operands.sparkSession))
    return (
        operands.withColumns(_quadrant_columns(sub))
        .join(table, ["mat", "qr", "qc"])
        .select("mat", (F.col("path") * 7 + F.col("m") - 1).alias("path"), "m", "s", "br", "bc", "data")
    )


def strassen_divide(operands: DataFrame, sub: Grid, bs: int, binary: bool = False) -> DataFrame:
    """The operands of the seven sub-problems, each the signed sum of at most two quadrant blocks."""
    return signed_sum(strassen_replicate(operands, sub), ["mat", "path", "br", "bc"], bs, binary)


def strassen_combine(products: DataFrame, sub: Grid, bs: int, binary: bool = False) -> DataFrame:
    """Seven sub-products -> their parent's blocks: ``path, br, bc, data``. Parts of one product block add up too."""
    table = F.broadcast(output_table(products.sparkSession))
    placed = (
        products.withColumn("m", (F.col("path") % 7 + 1).cast("int"))
        .join(table, "m")
        .select(
            F.expr("path div 7").alias("path"),
            (F.col("br") + F.col("qr") * sub.rows).alias("br"),
            (F.col("bc") + F.col("qc") * sub.cols).alias("bc"),
            "s",
            "data",
        )
    )
    return signed_sum(placed, ["path", "br", "bc"], bs, binary)


def strassen_by_table(
    a: BlockMatrix, b: BlockMatrix, levels: int = 1, task_bytes: int = TASK_BYTES
) -> BlockMatrix:
    """A * B with every divide and combine a table join and a signed sum: 2 * levels + 1 shuffles.

    Moves three copies of each operand per level; :func:`strassen_multiply` moves one in all.
    """
    grid = product_grid(a, b)
    operands = tagged_operands(a, b)
    if levels == 0:
        return multiply_blocks(a, b, task_bytes)
    subs = grid.sub_grids(levels)
    for sub in subs:
        operands = strassen_divide(operands, sub, a.bs, binary=True)
    leaf = subs[-1]
    products, _ = tile_products(operands, leaf.rows, leaf.inner, leaf.cols, a.bs, 7**levels, task_bytes)
    for sub in reversed(subs):
        products = strassen_combine(products, sub, a.bs, binary=sub is not subs[0])
    return trim(products, a.n_rows, b.n_cols, a.bs)


# --- grouped: every block is moved once ---------------------------------------------------------------------------


def strassen_divide_grouped(
    operands: DataFrame, sub: Grid, bs: int, levels: int = 1, binary: bool = True
) -> DataFrame:
    """The operands of all ``7 ** levels`` sub-problems, from one shuffle that moves each block once.

    Blocks at the same in-quadrant position meet in one group - at most ``4 ** levels`` of them - and the group emits
    every combination. ``sub`` is the grid of a sub-problem ``levels`` down.
    """
    kernel = kernels.divide_kernel(nested_terms(A_TERMS, levels), nested_terms(B_TERMS, levels), bs, binary)
    return (
        operands.withColumns(_quadrant_columns(sub))
        .groupBy("mat", "path", "br", "bc")
        .applyInArrow(kernel, OPERAND_SCHEMA if binary else OPERAND_ARRAY_SCHEMA)
    )


def strassen_combine_grouped(
    products: DataFrame, sub: Grid, bs: int, levels: int = 1, dims: tuple[int, int] | None = None
) -> DataFrame:
    """Products of ``7 ** levels`` sub-problems -> their common parent's blocks, in one shuffle.

    With ``dims``, the true dimensions, the result is the outermost matrix: padding is cut and data are arrays.
    """
    kernel = kernels.combine_kernel(
        nested_terms(C_TERMS, levels), sub.rows, sub.cols, bs, *(dims or (None, None)), binary=dims is None
    )
    data = T.BinaryType() if dims is None else BLOCK_DATA
    schema = T.StructType([*OPERAND_SCHEMA.fields[1:4], T.StructField("data", data)])
    parent = F.expr(f"path div {7**levels}")
    return products.groupBy(parent.alias("parent"), "br", "bc").applyInArrow(kernel, schema)


def strassen_multiply(
    a: BlockMatrix, b: BlockMatrix, levels: int = 1, task_bytes: int = TASK_BYTES
) -> BlockMatrix:
    """A * B with all levels of a phase fused: three shuffles whatever ``levels`` is.

    Divide moves each operand block once, the leaf stage moves the ``(7/4) ** levels`` larger operands, and combine
    moves the products. ``levels=0`` is the plain block product.
    """
    product_grid(a, b)
    if levels == 0:
        return multiply_blocks(a, b, task_bytes)
    return strassen_multiply_tagged(
        union_operands(a.df, b.df), (a.n_rows, a.n_cols, b.n_cols), a.bs, levels, task_bytes
    )


def strassen_multiply_tagged(
    blocks: DataFrame, dims: tuple[int, int, int], bs: int, levels: int = 1, task_bytes: int = TASK_BYTES
) -> BlockMatrix:
    """:func:`strassen_multiply` of both operands in one frame ``mat, br, bc, data`` (see ``tagged_coo_to_blocks``)."""
    n_rows, n_inner, n_cols = dims
    grid = Grid(*(ceil_div(side, bs) for side in dims))
    operands = tag_path(blocks).select("mat", "path", "br", "bc", "data")
    sub = grid.sub_grids(levels)[-1] if levels else grid
    if levels:
        operands = strassen_divide_grouped(operands, sub, bs, levels)
    products, _ = tile_products(operands, sub.rows, sub.inner, sub.cols, bs, 7**levels, task_bytes)
    result = strassen_combine_grouped(products, sub, bs, levels, (n_rows, n_cols))
    return BlockMatrix(result.select("br", "bc", "data"), n_rows, n_cols, bs)


def strassen_single_stream(
    a: BlockMatrix, b: BlockMatrix, levels: int = 1, task_bytes: int = TASK_BYTES
) -> BlockMatrix:
    """A * B level by level over one stream of both operands: 2 * levels + 1 shuffles of groups of four or seven.

    Groups stay small at any depth, where the fused form holds ``4 ** levels`` blocks at once.
    """
    grid = product_grid(a, b)
    operands = tagged_operands(a, b)
    if levels == 0:
        return multiply_blocks(a, b, task_bytes)
    subs = grid.sub_grids(levels)
    for sub in subs:
        operands = strassen_divide_grouped(operands, sub, a.bs)
    leaf = subs[-1]
    products, _ = tile_products(operands, leaf.rows, leaf.inner, leaf.cols, a.bs, 7**levels, task_bytes)
    for sub in reversed(subs):
        dims = (a.n_rows, b.n_cols) if sub is subs[0] else None
        products = strassen_combine_grouped(products, sub, a.bs, dims=dims)
    return BlockMatrix(products.select("br", "bc", "data"), a.n_rows, b.n_cols, a.bs)


# --- shared sums: all sub-problems of a level at once, each level a table -------------------------------------------


def strassen_shared(a: BlockMatrix, b: BlockMatrix, levels: int = 1, task_bytes: int = TASK_BYTES) -> BlockMatrix:
    """A * B by the recursive form with common sums formed once: 15 additions a level (Winograd) instead of 18.

    A level works on the operands of all its sub-problems together and writes them as a table, which the next level reads
    once: nothing is formed anew in branches, the number of scans does not grow with ``levels``, and executors lost later
    cost no more than a level. A level moves 7/4 of the one above, as :func:`strassen_single_stream` does. The tables are dropped
    in the end; the result is a table that belongs to the caller.
    """
    grid = product_grid(a, b)
    if levels == 0:
        return multiply_blocks(a, b, task_bytes)
    subs, dims = grid.sub_grids(levels), (a.n_rows, b.n_cols)
    with owned():
        operands = tagged_operands(a, b)
        for sub in subs:
            groups = operands.withColumns(_quadrant_columns(sub)).groupBy("mat", "path", "br", "bc")
            operands = stage(groups.applyInArrow(kernels.shared_divide_kernel(a.bs), OPERAND_SCHEMA), "shared-operands")
        leaf = subs[-1]
        products, _ = tile_products(operands, leaf.rows, leaf.inner, leaf.cols, a.bs, 7**levels, task_bytes)
        for sub in reversed(subs):
            last = sub is subs[0]
            kernel = kernels.shared_combine_kernel(sub.rows, sub.cols, a.bs, dims if last else None)
            schema = T.StructType([*OPERAND_SCHEMA.fields[1:4], T.StructField("data", BLOCK_DATA if last else T.BinaryType())])
            groups = products.groupBy(F.expr("path div 7").alias("parent"), "br", "bc")
            products = stage(groups.applyInArrow(kernel, schema), "shared-products", keep=last)
    return BlockMatrix(products.select("br", "bc", "data"), *dims, a.bs)


# --- recursive: composed of whole-matrix operators ----------------------------------------------------------------


def strassen_recursive(a: BlockMatrix, b: BlockMatrix, levels: int = 1, task_bytes: int = TASK_BYTES) -> BlockMatrix:
    """A * B as seven products of quadrant sums, each a matrix operation of its own.

    The plan has ``7 ** levels`` branches, each of which reads both operands, so the caller stages them; from a staged
    table a quadrant is a filter on the scan. Nothing is written or run while the plan is built. The seven products are
    tagged and added up in one pass. Only one level scales: the sums of a second one are formed anew in each of its
    branches. :func:`strassen_multiply` does the same arithmetic in one linear plan.
    """
    grid = product_grid(a, b)
    if levels == 0:
        return multiply_blocks(a, b, task_bytes)
    # The tables name the same sums as the stages above; here a sum is one add or subtract of two quadrants.
    products = []
    for m in range(1, 8):
        left, right = (_operand(x, terms, m) for x, terms in ((a, A_TERMS), (b, B_TERMS)))
        product = strassen_recursive(left, right, levels - 1, task_bytes)
        products.append(product.df.select(F.lit(m - 1).cast("bigint").alias("path"), "br", "bc", "data"))
    [sub] = grid.sub_grids(1)
    return trim(strassen_combine(reduce(DataFrame.unionByName, products), sub, a.bs), a.n_rows, b.n_cols, a.bs)


def _operand(x: BlockMatrix, terms, m: int) -> BlockMatrix:
    first, *rest = [(quadrant(x, r, c), s) for i, r, c, s in terms if i == m]
    if not rest:
        return first[0]
    [(other, sign)] = rest
    return add_blocks(first[0], other) if sign > 0 else subtract_blocks(first[0], other)
