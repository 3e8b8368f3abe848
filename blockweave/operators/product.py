"""Matrix products: by entry, and by block with a numpy kernel per tile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact_sum, kernels, packed
from ..matrix import BLOCK_DATA, COO_SCHEMA, BlockMatrix, ceil_div, check_product_shape
from .elementwise import signed_sum, sum_coo
from ..sources.tables import BlockTable
from .layout import coo_to_blocks, inside, tag_path, union_operands, unique_cells
from .packing import PACKED_SCHEMA, grouped_by_bucket, wanted_tasks

#: Memory that a task may hold for a result tile and one slice of its operands, and bytes it reads if it can be helped.
TASK_BYTES = 256 * 1024 * 1024
#: Operand bytes of one tile, which is one group and so lies in one partition.
TILE_BYTES = 1024 * 1024 * 1024
#: Tiles with less arithmetic than this are not split further just to occupy more cores.
MIN_TILE_FLOPS = 2e8
#: Rows of one piece of a heavy contracted index, whatever its share of the whole.
PIECE_ROWS = 4_000_000
#: Cells of a result tile whose sums one task of a product by entry holds, and those worth a tile of their own.
RESULT_CELLS, LEAST_CELLS = 1 << 21, 1 << 16
#: Side in cells below which a dense product is not halved any further.
STRASSEN_LEAF = 1024


# --- by entry -----------------------------------------------------------------------------------------------------


def heavy_indexes(a: DataFrame, b: DataFrame, share: float | None = None) -> DataFrame:
    """Contracted indexes that hold more than ``share`` of A's entries, of B's entries, or of all multiplications.

    At most ``3 / share`` rows whatever the data, since each of the three totals has room for ``1 / share`` of them;
    ``share`` is half the part of one shuffle partition unless given. ``sa`` and ``sb`` say into how many pieces to cut
    A's column and B's row, so that one pair of pieces does at most about ``share`` of the work; both are 0 for an
    index that the other matrix lacks.
    """
    if share is None:
        share = 0.5 / int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_a = a.groupBy(F.col("j").alias("c")).agg(F.count("v").cast("double").alias("na"))
    per_b = b.groupBy(F.col("i").alias("c")).agg(F.count("v").cast("double").alias("nb"))
    zero = F.lit(0.0)
    counts = per_a.join(per_b, "c", "full_outer").select(
        "c", F.coalesce("na", zero).alias("na"), F.coalesce("nb", zero).alias("nb")
    )
    totals = counts.agg(F.struct(F.sum("na").alias("a"), F.sum("nb").alias("b"), F.expr("sum(na * nb)").alias("w")))
    heavy = (
        counts.withColumn("total", totals.scalar())
        .select(
            "c",
            "na",
            "nb",
            (F.col("total.a") * share).alias("max_a"),
            (F.col("total.b") * share).alias("max_b"),
            (F.col("total.w") * share).alias("max_w"),
        )
        .where("na > max_a OR nb > max_b OR na * nb > max_w")
    )

    def pieces(n: str, other: str, limit: str) -> Column:
        # Square tiles of pairs where both sides are long, flat ones where the other side is short.
        return F.expr(
            f"if(na * nb = 0, 0, int(ceil({n} / greatest(1, "
            f"least({PIECE_ROWS}, {limit}, greatest(sqrt(max_w), max_w / {other}))))))"
        )

    return heavy.select("c", pieces("na", "nb", "max_a").alias("sa"), pieces("nb", "na", "max_b").alias("sb"))


def sketched_heavy_indexes(a: DataFrame, b: DataFrame, share: float | None = None, tracked: int | None = None) -> DataFrame:
    """As :func:`heavy_indexes`, from a sketch of the frequent indexes of each operand instead of full counts.

    A sketch is summed up inside each task and travels as one row, so no operand is grouped by index. It keeps ``tracked``
    indexes, eight for each that can be heavy unless given, and misses none that holds more than about
    ``3.5 / tracked`` of an operand; an index missed on both sides has at most the square of that of all pairs. Counts
    are estimates, which is enough: any number of pieces gives the same product. At most ``6 / share`` rows.
    """
    spark = a.sparkSession
    if share is None:
        share = 0.5 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, min(10_000, int(3 / share)))
    tracked = tracked or min(1_000_000, max(1024, 8 * most))
    most = min(most, tracked)

    def frequent(side: DataFrame, column: str, n: str) -> DataFrame:
        one = side.agg(F.count("v").cast("double").alias(f"all_{n}"), F.expr(f"approx_top_k({column}, {most}, {tracked})").alias("top"))
        rows = one.select(f"all_{n}", F.explode("top").alias("x")).select(F.col("x.item").alias("c"), F.col("x.count").cast("double").alias(n), f"all_{n}")
        return rows.where(F.col(n) > F.col(f"all_{n}") * share / 3)

    found = frequent(a, "j", "na").join(frequent(b, "i", "nb"), "c", "full_outer")
    # An index that one sketch lacks counts as one row there: it may be absent, and is cut by the other side alone.
    one = F.lit(1.0)
    counts = found.select("c", F.coalesce("na", one).alias("na"), F.coalesce("nb", one).alias("nb"), "all_na", "all_nb")
    totals = counts.agg(F.struct(F.max("all_na").alias("a"), F.max("all_nb").alias("b"), F.expr("sum(na * nb)").alias("w")))
    heavy = counts.withColumn("total", totals.scalar()).select(
        "c", "na", "nb",
        F.greatest(F.ceil(F.col("na") / F.least(F.lit(PIECE_ROWS), F.col("total.a") * share)), F.lit(1)).alias("pa"),
        F.greatest(F.ceil(F.col("nb") / F.least(F.lit(PIECE_ROWS), F.coalesce(F.col("total.b"), one) * share)), F.lit(1)).alias("pb"),
        (F.col("total.w") * share).alias("max_w"),
    )
    # What the known products add up to is the least that all do, so pieces may come out smaller than need be.
    more = F.greatest(F.sqrt(F.col("na") * F.col("nb") / (F.col("pa") * F.col("pb") * F.col("max_w"))), one)
    heavy = heavy.select("c", *[F.least(F.ceil(F.col(p) * more), F.col(n)).cast("int").alias(s) for p, n, s in (("pa", "na", "sa"), ("pb", "nb", "sb"))])
    return heavy.where("sa > 1 OR sb > 1")


def _cut(side: DataFrame, heavy: DataFrame, own: str, other: str, spread_by: str) -> DataFrame:
    """Give each row its own piece number and one copy for every piece of the other side (one in all if not heavy)."""
    return side.join(heavy, "c", "left").select(
        *side.columns,
        F.expr(f"int(pmod(xxhash64({spread_by}), greatest({own}, 1)))").alias(f"p_{own}"),
        F.explode(
            F.expr(f"case when {other} is null then array(0) when {other} = 0 then array() "
                   f"else sequence(0, {other} - 1) end")
        ).alias(f"p_{other}"),
    )


def _join_spread(left: DataFrame, right: DataFrame, heavy: DataFrame) -> DataFrame:
    """Join on the contracted index ``c`` with the pieces of heavy indexes as separate keys."""
    heavy = F.broadcast(heavy)
    left, right = _cut(left, heavy, "sa", "sb", "ai"), _cut(right, heavy, "sb", "sa", "bj")
    return left.join(right, ["c", "p_sa", "p_sb"])


TILE_SCHEMA = T.StructType([T.StructField("rt", T.LongType()), T.StructField("kt", T.LongType()), *(PACKED_SCHEMA[n] for n in ("bucket", "packed"))])


@dataclass(frozen=True)
class ResultTiles:
    """Sides in cells of the result tiles of a product by entry, their number along either, and parts of the inner axis."""

    rows: int
    cols: int
    nr: int
    nk: int
    nc: int


def choose_result_tiles(rows: int, cols: int, tasks: int) -> ResultTiles:
    """Tiles of at most ``RESULT_CELLS``, and smaller ones where ``tasks`` would have nothing to do.

    Sides are equal unless the result is narrower than that. Where even tiles of ``LEAST_CELLS`` are too few, the contracted
    axis is cut, too: what is then added up once more is small.
    """
    rows, cols = max(1, rows), max(1, cols)
    area = max(LEAST_CELLS, min(RESULT_CELLS, rows * cols // tasks))
    side = max(1, int(area**0.5))
    tr, tk = (rows, min(cols, area // rows)) if rows <= side else (area // min(cols, side), min(cols, side))
    tr = min(rows, tr)
    nr, nk = ceil_div(rows, tr), ceil_div(cols, tk)
    return ResultTiles(tr, tk, nr, nk, ceil_div(tasks, nr * nk))


def _heavy_tiles(side: DataFrame, tile: str, share: float, search: str) -> DataFrame:
    """``tile, pieces`` of the tiles along one axis that hold more than ``share`` of the entries: ``1 / share`` rows at most."""
    if search == "sketch":
        most = max(1, min(10_000, int(2 / share)))
        one = side.agg(F.count(F.lit(1)).alias("total"), F.expr(f"approx_top_k({tile}, {most}, {max(1024, 8 * most)})").alias("top"))
        counts = one.select("total", F.explode("top").alias("x")).select(F.col("x.item").alias(tile), F.col("x.count").alias("n"), "total")
    else:
        counts = side.groupBy(tile).agg(F.count(F.lit(1)).alias("n"))
        counts = counts.withColumn("total", counts.agg(F.sum("n")).scalar())
    return counts.where(F.col("n") > F.col("total") * share).select(tile, F.ceil(F.col("n") / (F.col("total") * share)).cast("int").alias(f"pieces_{tile}"))


def _sum_on_tiles(left: DataFrame, right: DataFrame, dims: tuple[int, int], split_heavy: bool, share: float | None, search: str) -> DataFrame:
    """``i, j, v``: products of entries ``c, ai, av`` and ``c, bj, bv`` with the same ``c``, summed in the task that forms them.

    Entries meet by contracted index once, packed, and equal cells are added up on the way. An entry is then copied to the tiles
    in which its index meets an entry of the other side, and to no other. Tiles that share rows or columns of more than
    ``share`` of an operand's entries are cut into pieces by contracted index.
    """
    spark = left.sparkSession
    tasks = 3 * spark.sparkContext.defaultParallelism
    t = choose_result_tiles(*dims, tasks)

    def tiled(side: DataFrame, tile: str, index: str, value: str, length: int) -> DataFrame:
        # An index that is null has a place of its own beyond the others' in tile 0.
        place = F.expr(f"coalesce(pmod({index}, {length}L), {length}L) + {tile} * {length + 1}L")
        side = side.withColumn(tile, F.expr(f"coalesce(({index} - pmod({index}, {length}L)) div {length}L, 0L)"))
        return side.select(tile, F.lit(tile == "rt").alias("is_left"), F.col("c").cast("bigint").alias("k"), place.alias("pos"), F.col(value).cast("double").alias("v"))

    left, right = tiled(left, "rt", "ai", "av", t.rows), tiled(right, "kt", "bj", "bv", t.cols)
    wanted = wanted_tasks(spark)
    met = grouped_by_bucket(left.drop("rt").unionByName(right.drop("kt")))
    both = met.groupBy("part", "bucket").applyInArrow(packed.place_kernel(t.rows, t.cols), TILE_SCHEMA)
    pieces = F.lit(t.nc)
    if split_heavy:
        share = share or 2.0 / max(tasks, t.nc)
        for side, tile, n in ((left, "rt", t.nr), (right, "kt", t.nk)):
            if n > 1:
                both = both.join(F.broadcast(_heavy_tiles(side, tile, share, search)), tile, "left")
                pieces = F.greatest(pieces, F.col(f"pieces_{tile}"))
    both = both.withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("bucket"), "pieces"))
    parts = max(wanted, min(20 * wanted, 4 * max(t.nr, t.nk)))
    keys = ["rt", "kt", "piece"]
    dealt = both.select(*keys, "pieces", "packed").repartition(parts, *keys).groupBy(*keys)
    if t.nc == 1 and (not split_heavy or t.nr * t.nk == 1):
        return dealt.applyInArrow(kernels.entry_product_kernel(t.rows, t.cols), COO_SCHEMA)
    # Only tiles in several pieces are shuffled once more, as packed sums; both ways start from the same shuffle.
    sums = dealt.applyInArrow(packed.parts_kernel(t.rows, t.cols), TILE_SCHEMA).repartition(wanted, "rt", "kt")
    added = sums.groupBy("rt", "kt").applyInArrow(packed.add_parts_kernel(t.rows, t.cols), COO_SCHEMA)
    if t.nc > 1:
        return added
    return dealt.applyInArrow(packed.product_kernel(t.rows, t.cols, cut=False), COO_SCHEMA).unionByName(added)


def multiply_coo(
    a: DataFrame,
    b: DataFrame,
    unique: bool = False,
    split_heavy: bool = True,
    share: float | None = None,
    reproducible: bool = False,
    search: str = "counts",
    dims: tuple[int, int] | None = None,
) -> DataFrame:
    """C(i, k) = sum over j of A(i, j) * B(j, k), for matrices of any shape; absent entries are zero.

    An equi-join on the contracted index followed by a sum that is combined map-side, so products are reduced in the
    task that forms them. Duplicate entries are summed first (``unique=True`` promises there are none): otherwise a
    cell repeated n times on both sides would cost n * n products.

    ``split_heavy`` cuts the columns of A and rows of B that belong to a heavy contracted index into pieces and pairs
    the pieces, which spreads such an index over many tasks; every pair is still formed exactly once. The list of
    heavy indexes is short by construction (see :func:`heavy_indexes`), which is what allows broadcasting it.

    ``search`` finds them by full ``"counts"`` or by a ``"sketch"`` (:func:`sketched_heavy_indexes`).

    With ``dims``, the rows and columns of the result, products are formed where they are summed: in result tiles of
    bounded size, to which the entries are copied that meet there. What is shuffled is then the entries and the result,
    and no longer a sum for each index and task. For results that no task holds; indexes beyond ``dims`` are fine. Heavy
    indexes are cut by the tiles, and heavy tiles by index; ``reproducible`` keeps to the join.

    ``reproducible`` gives the same bits for real numbers whatever the partitions: products are rounded one by one, and
    their sums, like those of duplicates, are free of rounding until they are put together.
    """
    # Both the join and the search for heavy indexes start from these two frames: with the join's own null filter
    # written out the plans are the same and Spark computes each shuffle once.
    a = a.select("i", "j", "v").where("j IS NOT NULL")
    b = b.select("i", "j", "v").where("i IS NOT NULL")
    on_tiles = dims and not reproducible
    if not unique and not on_tiles:
        a, b = (sum_coo(x) if reproducible else unique_cells(x) for x in (a, b))
    left = a.select(F.col("j").alias("c"), F.col("i").alias("ai"), F.col("v").alias("av"))
    right = b.select(F.col("i").alias("c"), F.col("j").alias("bj"), F.col("v").alias("bv"))
    find = {"counts": heavy_indexes, "sketch": sketched_heavy_indexes}[search]
    if on_tiles:
        return _sum_on_tiles(left, right, dims, split_heavy, share, search)
    pairs = _join_spread(left, right, find(a, b, share)) if split_heavy else left.join(right, "c")
    if reproducible:
        keyed = pairs.withColumnsRenamed({"ai": "i", "bj": "j"})
        tops = (x.select(exact_sum.top_of(exact_sum.largest(F.col("v")))).scalar() for x in (a, b))
        return exact_sum.exact_sum(keyed, ["i", "j"], F.col("av") * F.col("bv"), next(tops) + next(tops))
    return (
        pairs.groupBy(F.col("ai").alias("i"), F.col("bj").alias("j"))
        .agg((F.sum(F.col("av") * F.col("bv")) + F.lit(0.0)).alias("v"))
    )


# --- by block -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tiling:
    """Tile sides in blocks (rows x contracted x columns) and the number of tiles along each of the three axes."""

    tr: int
    tc: int
    tk: int
    nr: int
    nc: int
    nk: int


def choose_tiling(
    rows: int,
    inner: int,
    cols: int,
    bs: int,
    problems: int,
    tasks: int,
    task_bytes: int = TASK_BYTES,
    min_flops: float = MIN_TILE_FLOPS,
    tile_bytes: int = TILE_BYTES,
) -> Tiling:
    """Cut a rows x inner x cols block product into tiles.

    A task streams its tile's operands by contracted index and holds the result tile and one slice of the operands;
    these have to fit ``task_bytes``, the operands themselves ``tile_bytes``, and ``tasks`` tasks are to have
    something to do unless tiles would fall below ``min_flops`` operations.

    A-blocks are shipped once per column tile, B-blocks once per row tile. Result blocks stay where they are made with
    one inner tile; with more, the parts leave the kernel, are shuffled and enter another one, which is counted as
    three moves. Each halving takes, of the axes that help, the one that adds the least to the total.
    """
    n = [1, 1, 1]
    grid = (rows, inner, cols)

    def volume(parts: list[int]) -> int:
        nr, nc, nk = parts
        return nk * rows * inner + nr * inner * cols + (3 * nc if nc > 1 else 0) * rows * cols

    while True:
        tr, tc, tk = sides = [ceil_div(g, k) for g, k in zip(grid, n)]
        helps: set[int] = set()
        if 8 * bs * bs * (tr * tk + tr + tk) > task_bytes:
            helps = {0, 2}
        elif 8 * bs * bs * tc * (tr + tk) > tile_bytes:
            helps = {0, 1, 2}
        elif problems * n[0] * n[1] * n[2] < tasks and 2.0 * tr * tc * tk * bs**3 >= min_flops:
            helps = {0, 1, 2}
        options = []
        for axis in helps:
            if sides[axis] > 1:
                parts = list(n)
                parts[axis] = min(2 * n[axis], grid[axis])
                options.append((volume(parts), axis, parts))
        if not options:
            return Tiling(tr, tc, tk, ceil_div(rows, tr), ceil_div(inner, tc), ceil_div(cols, tk))
        n = min(options)[2]


def product_partitions(tiles: int, held_bytes: int, tasks: int) -> int:
    """Partitions of about ``TASK_BYTES`` for ``held_bytes`` of operands, ``tasks`` at least, never more than tiles."""
    return max(1, min(tiles, max(tasks, ceil_div(held_bytes, TASK_BYTES))))


def dealt_to(base: str, tiles: int, parts: int) -> Column:
    """The partition of tile ``base``. A multiple of the golden ratio takes any regular pattern of tiles apart."""
    if parts >= tiles:
        return F.expr(f"int({base})")
    return F.expr(f"int(({base} % 1073741824L) * 2654435769L % 4294967296L * {parts}L div 4294967296L)")


PRODUCT_SCHEMA = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("path", "br", "bc")] + [T.StructField("data", T.BinaryType())]
)
PRODUCT_ARRAY_SCHEMA = T.StructType([*PRODUCT_SCHEMA.fields[:3], T.StructField("data", BLOCK_DATA)])


def stream_tiles(placed: DataFrame, tiles: int, parts: int, kernel, schema: T.StructType) -> DataFrame:
    """One group per tile ``base``, its rows in the order of the contracted index ``c``: one exchange and one sort."""
    dealt = placed.withColumn("part", dealt_to("base", tiles, parts)).repartitionById(parts, "part")
    return dealt.sortWithinPartitions("part", "base", "c").groupBy("part", "base").applyInArrow(kernel, schema)


def place_on_tiles(operands: DataFrame, t: Tiling, bs: int, problems: int, tasks: int, share: float = 1.0) -> tuple[DataFrame, int, int]:
    """A copy of each operand block for every tile ``base`` that needs it; the number of tiles and of partitions.

    ``share`` is the size of a block over that of a dense one.
    """
    tiles = problems * t.nr * t.nc * t.nk
    held = int(share * tiles * 8 * bs * bs * (t.tr * t.tc + t.tc * t.tk))
    parts = product_partitions(tiles, held, tasks)
    # A-blocks fix the row and inner tile and are copied along the column tiles; B-blocks the other way round.
    first = F.expr(f"if(mat = 'A', br div {t.tr}, 0L)")
    last = F.expr(f"if(mat = 'A', 0L, bc div {t.tk})")
    placed = operands.withColumn("c", F.expr("if(mat = 'A', bc, br)"))
    inner_tile = F.expr(f"c div {t.tc}")
    placed = placed.withColumn("base", ((F.col("path") * t.nr + first) * t.nc + inner_tile) * t.nk + last)
    if t.nr > 1 or t.nk > 1:
        copies = F.expr(
            f"if(mat = 'A', sequence(0L, {t.nk - 1}L), sequence(0L, {(t.nr - 1) * t.nc * t.nk}L, {t.nc * t.nk}L))"
        )
        placed = placed.withColumn("copy", F.explode(copies)).withColumn("base", F.col("base") + F.col("copy"))
    return placed, tiles, parts


def place_where_met(
    operands: DataFrame, positions: tuple[DataFrame, DataFrame], t: Tiling, bs: int, tasks: int, share: float = 1.0
) -> tuple[DataFrame, int, int]:
    """As :func:`place_on_tiles` for one problem, without copies for tiles in which a block meets no other.

    ``positions`` are the ``br, bc`` of stored blocks of A and of B.
    """
    at_a, at_b = positions
    rows = at_a.select(F.lit("B").alias("mat"), F.col("bc").alias("c"), F.expr(f"br div {t.tr}").alias("tile")).distinct()
    cols = at_b.select(F.lit("A").alias("mat"), F.col("br").alias("c"), F.expr(f"bc div {t.tk}").alias("tile")).distinct()
    placed = operands.withColumn("c", F.expr("if(mat = 'A', bc, br)")).join(rows.unionByName(cols), ["mat", "c"])
    base = f"if(mat = 'A', (br div {t.tr} * {t.nc} + c div {t.tc}) * {t.nk} + tile, (tile * {t.nc} + c div {t.tc}) * {t.nk} + bc div {t.tk})"
    tiles = t.nr * t.nc * t.nk
    # At most what a dense product of that share holds; empty tiles cost nothing.
    parts = product_partitions(tiles, int(share * tiles * 8 * bs * bs * t.tc * (t.tr + t.tk)), max(tasks, min(20 * tasks, 4 * max(t.nr, t.nk))))
    return placed.withColumn("base", F.expr(base)).drop("tile"), tiles, parts


def tile_products(
    operands: DataFrame,
    rows: int,
    inner: int,
    cols: int,
    bs: int,
    problems: int = 1,
    task_bytes: int = TASK_BYTES,
    final: tuple[int, int] | None = None,
    min_flops: float = MIN_TILE_FLOPS,
) -> tuple[DataFrame, int]:
    """Multiply, for every sub-problem ``path``, its A-blocks by its B-blocks.

    ``operands`` has ``mat, path, br, bc, data``. Returns ``path, br, bc, data`` and the number of inner tiles: with
    more than one, a result block comes in that many parts which the caller has to add up. ``data`` is BINARY, or with
    ``final``, the true dimensions of the result, an array with clean padding if there is nothing to add.

    One shuffle. Each block goes to the tiles that need it; a tile is one group, its size is fixed by the tiling, and
    a popular block row or column is spread over its tiles.
    """
    tasks = wanted_tasks(operands.sparkSession)
    t = choose_tiling(rows, inner, cols, bs, problems, tasks, task_bytes, min_flops)
    placed, tiles, parts = place_on_tiles(operands, t, bs, problems, tasks)
    done = final if t.nc == 1 else None
    kernel = kernels.tile_product_kernel(bs, done is None, done)
    schema = PRODUCT_SCHEMA if done is None else PRODUCT_ARRAY_SCHEMA
    return stream_tiles(placed, tiles, parts, kernel, schema), t.nc


def multiply_blocks(
    a: BlockMatrix, b: BlockMatrix, task_bytes: int = TASK_BYTES, min_flops: float = MIN_TILE_FLOPS
) -> BlockMatrix:
    """A * B by tiles of blocks; parts of a result block from different inner tiles are added in a second shuffle.

    Absent cells of a stored block are zeros and take part (0 * Inf is NaN), those of absent blocks do not.
    """
    check_product_shape(a, b)
    operands = tag_path(union_operands(a.df, b.df))
    dims = (a.n_rows, b.n_cols)
    products, parts = tile_products(
        operands, a.grid_rows, a.grid_cols, b.grid_cols, a.bs, 1, task_bytes, dims, min_flops
    )
    if parts > 1:
        products = signed_sum(products.withColumn("s", F.lit(1.0)), ["br", "bc"], a.bs, dims=dims)
    return BlockMatrix(products.select("br", "bc", "data"), *dims, a.bs)


def panel_depth(tr: int, tk: int, bs: int, most: int, task_bytes: int) -> int:
    """Contracted indexes that fit into ``task_bytes`` at a time, beside the result tile and Strassen's scratch space.

    The scratch space of all levels is 4/3 of a quarter of either operand and of two quarters of the result.
    """
    blocks = task_bytes / (8 * bs * bs)
    return max(1, min(most, int((blocks - tr * tk * 5 / 3) / ((tr + tk) * 4 / 3))))


def multiply_in_tiles(
    a: BlockMatrix, b: BlockMatrix, leaf: int = STRASSEN_LEAF, task_bytes: int = TASK_BYTES, min_flops: float = MIN_TILE_FLOPS
) -> BlockMatrix:
    """A * B with Strassen's product inside each result tile, on blocks that its task already holds.

    Blocks travel as in :func:`multiply_blocks` - no operand of a sub-problem is ever shuffled - and are multiplied in
    panels of several contracted indexes, whose number follows from ``task_bytes``. Panels are halved until a side would
    fall below ``leaf`` cells. Panels with many absent blocks or a value that is not finite take the plain product.
    """
    check_product_shape(a, b)
    dims, bs = (a.n_rows, b.n_cols), a.bs
    tasks = wanted_tasks(a.df.sparkSession)
    t = choose_tiling(a.grid_rows, a.grid_cols, b.grid_cols, bs, 1, tasks, task_bytes // 3, min_flops)
    depth = panel_depth(t.tr, t.tk, bs, t.tc, task_bytes)
    done = dims if t.nc == 1 else None
    kernel = kernels.panel_product_kernel(bs, (t.tr, t.tc, t.tk), (t.nr, t.nc, t.nk), depth, leaf, done is None, done)
    placed, tiles, parts = place_on_tiles(tag_path(union_operands(a.df, b.df)), t, bs, 1, tasks)
    products = stream_tiles(placed, tiles, parts, kernel, PRODUCT_SCHEMA if done is None else PRODUCT_ARRAY_SCHEMA)
    if t.nc > 1:
        products = signed_sum(products.withColumn("s", F.lit(1.0)), ["br", "bc"], bs, dims=dims)
    return BlockMatrix(products.select("br", "bc", "data"), *dims, bs)


def bucketed_product(a: BlockTable, b: BlockTable, task_bytes: int = TASK_BYTES) -> BlockMatrix:
    """A * B of tables in as many buckets of the contracted index: of ``bc`` for A and of ``br`` for B.

    Neither operand is shuffled: buckets are joined where they lie, and each task adds up its pairs' products before
    the parts of a result block meet. For results that are small beside the operands, such as a Gram matrix of a tall
    one; a task holds up to ``task_bytes`` of parts and passes them on when there are more.
    """
    check_product_shape(a.matrix, b.matrix)
    if a.by != ("bc",) or b.by != ("br",) or a.buckets != b.buckets:
        raise ValueError(f"buckets do not match: {a.buckets} of {a.by} and {b.buckets} of {b.by}")
    bs, dims = a.matrix.bs, (a.matrix.n_rows, b.matrix.n_cols)
    left = a.matrix.df.select("br", F.col("bc").alias("c"), F.col("data").alias("a"))
    right = b.matrix.df.select(F.col("br").alias("c"), "bc", F.col("data").alias("b"))
    # A merge join reads the buckets in step; the hint keeps Spark from broadcasting what it takes for small.
    pairs = left.hint("merge").join(right, "c").select("br", "bc", "a", "b")
    parts = pairs.mapInArrow(kernels.pair_product_kernel(bs, task_bytes), T.StructType(PRODUCT_SCHEMA.fields[1:]))
    total = signed_sum(parts.withColumn("s", F.lit(1.0)), ["br", "bc"], bs, dims=dims)
    return BlockMatrix(total, *dims, bs)


def stored_positions(m: BlockMatrix) -> DataFrame:
    """``br, bc`` of the stored blocks. Reads the blocks' frame: stage it, or take :func:`entry_positions` instead."""
    return m.df.select("br", "bc")


def entry_positions(coo: DataFrame, bs: int) -> DataFrame:
    """``br, bc`` of the blocks that entries fill."""
    return coo.select(F.expr(f"i div {bs}").alias("br"), F.expr(f"j div {bs}").alias("bc")).distinct()


def multiply_sparse_blocks(
    a: BlockMatrix,
    b: BlockMatrix,
    positions: tuple[DataFrame, DataFrame] | None = None,
    task_bytes: int = TASK_BYTES,
    min_flops: float = MIN_TILE_FLOPS,
) -> BlockMatrix:
    """A * B for operands most of whose blocks are absent: a block goes only to result tiles where it meets another.

    The positions of stored blocks are matched first, as numbers: for each contracted index the column tiles in which B
    has a block, and the row tiles in which A has one. A block is joined with its index's row of that list, so it is
    shipped once per tile that needs it, and not at all if none does. ``positions`` are the stored blocks' ``br, bc`` of
    A and B where they can be had without building blocks, for example from entries.
    """
    check_product_shape(a, b)
    at_a, at_b = positions or (stored_positions(a), stored_positions(b))
    dims, bs = (a.n_rows, b.n_cols), a.bs
    tasks = wanted_tasks(a.df.sparkSession)
    t = choose_tiling(a.grid_rows, a.grid_cols, b.grid_cols, bs, 1, tasks, task_bytes, min_flops)
    tiles = t.nr * t.nc * t.nk
    cols = at_b.groupBy(F.col("br").alias("c")).agg(F.collect_set(F.expr(f"bc div {t.tk}")).alias("tiles"))
    rows = at_a.groupBy(F.col("bc").alias("c")).agg(F.collect_set(F.expr(f"br div {t.tr}")).alias("tiles"))

    def needed(m: BlockMatrix, mat: str, index: str, met: DataFrame, base: str) -> DataFrame:
        blocks = m.df.select(F.lit(mat).alias("mat"), "br", "bc", F.col(index).alias("c"), "data").join(met, "c")
        blocks = blocks.select("mat", "br", "bc", "c", F.explode("tiles").alias("tile"), "data")
        return blocks.withColumn("base", F.expr(base))

    placed = needed(a, "A", "bc", cols, f"(br div {t.tr} * {t.nc} + c div {t.tc}) * {t.nk} + tile").unionByName(
        needed(b, "B", "br", rows, f"(tile * {t.nc} + c div {t.tc}) * {t.nk} + bc div {t.tk}")
    )
    # At most what a dense product holds; empty tiles cost nothing.
    parts = product_partitions(tiles, tiles * 8 * bs * bs * t.tc * (t.tr + t.tk), tasks)
    done = dims if t.nc == 1 else None
    kernel = kernels.tile_product_kernel(bs, done is None, done)
    products = stream_tiles(tag_path(placed.drop("tile")), tiles, parts, kernel, PRODUCT_SCHEMA if done is None else PRODUCT_ARRAY_SCHEMA)
    if t.nc > 1:
        products = signed_sum(products.withColumn("s", F.lit(1.0)), ["br", "bc"], bs, dims=dims)
    return BlockMatrix(products.select("br", "bc", "data"), *dims, bs)


def multiply_coo_by_tiles(
    a: DataFrame,
    b: DataFrame,
    dims: tuple[int, int, int],
    bs: int,
    unique: bool = False,
    task_bytes: int = TASK_BYTES,
    min_flops: float = MIN_TILE_FLOPS,
) -> BlockMatrix:
    """Entries -> block product without shuffling any dense operand block, for operands of rows x inner, inner x cols.

    Ships each entry to the tiles along its row or column and builds dense slices there. Right for operands with up to
    about a quarter of their cells stored, where the entries are smaller than the blocks; for fuller ones
    :func:`multiply_coo_via_blocks` moves less, and for very wide and sparse ones, whose entries are copied to many tiles
    that hold nothing to meet them, :func:`multiply_coo` does. A tile holds distinct cells, so skew in rows or columns
    is bounded by its area.
    """
    rows, inner, cols = dims
    if not unique:
        a, b = unique_cells(a), unique_cells(b)
    grid = [ceil_div(side, bs) for side in dims]
    tasks = wanted_tasks(a.sparkSession)
    t = choose_tiling(*grid, bs, 1, tasks, task_bytes, min_flops)

    def place(block: str, side: int) -> Column:
        return F.expr(f"int(({block} div {bs} % {side}) * {bs * bs} + (i % {bs}) * {bs} + j % {bs})").alias("pos")

    def tile_of(index: str, side: int) -> str:
        return f"({index} div {bs * side})"

    left = inside(a, rows, inner).select(
        F.lit(True).alias("is_left"),
        F.expr(f"j div {bs}").alias("c"),
        F.expr(f"({tile_of('i', t.tr)} * {t.nc} + {tile_of('j', t.tc)}) * {t.nk}").alias("base"),
        F.expr(f"sequence(0L, {t.nk - 1}L)").alias("copies"),
        place("i", t.tr),
        "v",
    )
    right = inside(b, inner, cols).select(
        F.lit(False).alias("is_left"),
        F.expr(f"i div {bs}").alias("c"),
        F.expr(f"{tile_of('i', t.tc)} * {t.nk} + {tile_of('j', t.tk)}").alias("base"),
        F.expr(f"sequence(0L, {(t.nr - 1) * t.nc * t.nk}L, {t.nc * t.nk}L)").alias("copies"),
        place("j", t.tk),
        "v",
    )
    tiles = t.nr * t.nc * t.nk
    parts = product_partitions(tiles, tiles * 8 * bs * bs * (t.tr * t.tc + t.tc * t.tk), tasks)
    placed = (
        left.unionByName(right)
        .withColumn("copy", F.explode("copies"))
        .select((F.col("base") + F.col("copy")).alias("base"), "c", "is_left", "pos", "v")
    )
    done = (rows, cols) if t.nc == 1 else None
    kernel = kernels.cell_product_kernel(bs, (t.tr, t.tc, t.tk), (t.nr, t.nc, t.nk), done is None, done)
    products = stream_tiles(placed, tiles, parts, kernel, PRODUCT_SCHEMA if done is None else PRODUCT_ARRAY_SCHEMA)
    if t.nc > 1:
        products = signed_sum(products.withColumn("s", F.lit(1.0)), ["br", "bc"], bs, dims=(rows, cols))
    return BlockMatrix(products.select("br", "bc", "data"), rows, cols, bs)


def multiply_coo_via_blocks(
    a: DataFrame,
    b: DataFrame,
    dims: tuple[int, int, int],
    bs: int,
    levels: int = 0,
    unique: bool = False,
    persist: bool = False,
) -> BlockMatrix:
    """Entries -> blocks -> product (Strassen's for ``levels`` > 0), for operands of ``dims`` = rows, inner, cols.

    ``persist`` keeps the result for reuse once it has been computed.
    """
    from .strassen import strassen_multiply

    rows, inner, cols = dims
    left = coo_to_blocks(a, bs, (rows, inner), unique=unique)
    right = coo_to_blocks(b, bs, (inner, cols), unique=unique)
    product = strassen_multiply(left, right, levels) if levels else multiply_blocks(left, right)
    return product.persist() if persist else product
