"""Distributed dense and sparse matrix algebra on Spark DataFrames."""

from .matrix import BLOCKS_SCHEMA, COO_SCHEMA, TAGGED_COO_SCHEMA, BlockMatrix
from .operators.compressed import (
    CsrMatrix,
    blocks_to_csr,
    coo_to_csr,
    csr_to_blocks,
    csr_to_coo,
    multiply_csr,
)
from .operators.elementwise import (
    add_blocks,
    add_coo,
    scalar_multiply,
    scale_coo,
    signed_sum,
    subtract_blocks,
    subtract_coo,
    sum_coo,
)
from .operators.layout import (
    block_coords,
    blocks_to_coo,
    coo_quadrant,
    coo_to_blocks,
    quadrant,
    quadrant_assemble,
    quadrant_split,
    select_operand,
    tag_path,
    tagged_coo_to_blocks,
    trim,
    union_operands,
    unique_cells,
)
from .operators.product import (
    bucketed_product,
    entry_positions,
    multiply_blocks,
    multiply_coo,
    multiply_coo_by_tiles,
    multiply_coo_via_blocks,
    multiply_in_tiles,
    multiply_sparse_blocks,
)
from .operators.strassen import (
    strassen_by_table,
    strassen_combine,
    strassen_combine_grouped,
    strassen_divide,
    strassen_divide_grouped,
    strassen_multiply,
    strassen_multiply_tagged,
    strassen_recursive,
    strassen_replicate,
    strassen_shared,
    strassen_single_stream,
)
from .sources.dims import footer_dims, infer_dims, infer_square_dim, matrix_dims, tagged_dims
from .sources.staging import owned, scratch_path, stage, unstage
from .sources.tables import BlockTable, bucket_blocks
from .sources.text import preview, read_blocks, read_coo, read_quarantined, read_tagged, write_coo

__all__ = [name for name in dir() if not name.startswith("_")]
