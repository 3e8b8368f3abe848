"""Per-group Arrow functions: the only Python that touches block data.

Each runs inside one Spark group whose size is bounded by its key (see the callers), reads Arrow batches as zero-copy
numpy views and yields record batches of at most about ``BATCH_BYTES``. Between two kernels a block travels as BINARY
(little-endian float64, row-major), which crosses the JVM/Python border as one memory copy; frames handed to the user
carry ARRAY<DOUBLE>.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Iterator  # Spark tells the iterator form of applyInArrow from this annotation

import numpy as np
import pyarrow as pa

BATCH_BYTES = 32 * 1024 * 1024
#: Share of a panel's pairs of blocks that have to be stored for it to be multiplied as a whole.
FULL = 0.75
BLOCK_TYPE = pa.list_(pa.field("element", pa.float64(), nullable=False))

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def block_views(column: pa.Array, bs: int) -> Iterable[np.ndarray]:
    """The ``bs x bs`` blocks of an ARRAY<DOUBLE> or BINARY column."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return [np.frombuffer(x.as_buffer(), dtype="<f8").reshape(bs, bs) for x in column]
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, bs, bs)


def _block_column(blocks: list[np.ndarray], binary: bool) -> pa.Array:
    flat = np.concatenate([b.reshape(-1) for b in blocks])
    width = blocks[0].size
    if not binary:
        offsets = np.arange(len(blocks) + 1, dtype=np.int32) * width
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), type=BLOCK_TYPE)
    offsets = np.arange(len(blocks) + 1, dtype=np.int32) * (8 * width)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(flat)]
    return pa.Array.from_buffers(pa.binary(), len(blocks), buffers)


def emit(rows: Iterable[tuple], names: list[str], bs: int, binary: bool) -> Iterator[pa.RecordBatch]:
    """Batch ``(key..., block)`` rows; the last name is the block column. ``+ 0.0`` turns -0.0 into 0.0."""
    per_batch = max(1, BATCH_BYTES // (8 * bs * bs))
    pending: list[tuple] = []

    def flush() -> pa.RecordBatch:
        *keys, blocks = zip(*pending)
        columns = [pa.array(k, pa.string() if isinstance(k[0], str) else pa.int64()) for k in keys]
        return pa.RecordBatch.from_arrays([*columns, _block_column(list(blocks), binary)], names)

    for *keys, block in rows:
        pending.append((*keys, block + 0.0))
        if len(pending) == per_batch:
            yield flush()
            pending = []
    if pending:
        yield flush()


def _rows(batches: Iterator[pa.RecordBatch], bs: int, keys: list[str]) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        yield from zip(*columns, block_views(batch.column("data"), bs))


def clear_padding(block: np.ndarray, br: int, bc: int, dims: tuple[int, int] | None) -> np.ndarray:
    """Zero the cells of an edge block that lie outside a matrix of ``dims`` (Inf * 0 leaves NaN there)."""
    if dims is not None:
        bs = block.shape[0]
        rows, cols = dims[0] - br * bs, dims[1] - bc * bs
        if rows < bs:
            block[max(rows, 0):, :] = 0.0
        if cols < bs:
            block[:, max(cols, 0):] = 0.0
    return block


def fill_kernel(bs: int, keys: list[str] | None = None) -> Kernel:
    """Group of distinct cells ``keys..., pos, v`` of one block -> that block; keys are ``br, bc`` unless given."""
    names = keys or ["br", "bc"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.zeros(bs * bs)
        key = None
        for batch in batches:
            if batch.num_rows:
                key = [batch.column(name)[0].as_py() for name in names]
                block[batch.column("pos").to_numpy()] = batch.column("v").to_numpy()
        yield from emit([(*key, block.reshape(bs, bs))], [*names, "data"], bs, binary=False)

    return fill


def signed_sum_kernel(keys: list[str], bs: int, binary: bool, dims: tuple[int, int] | None = None) -> Kernel:
    """Group of rows ``keys..., s, data`` with equal keys -> one row holding the sum of ``s * data``."""

    def signed_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((bs, bs))
        key: list = []
        for *key, sign, block in _rows(batches, bs, [*keys, "s"]):
            total += block if sign == 1.0 else sign * block
        yield from emit([(*key, clear_padding(total, *key[-2:], dims))], [*keys, "data"], bs, binary)

    return signed_sum


class _Accumulator:
    """Result blocks of one tile, to which products of blocks with the same contracted index are added."""

    def __init__(self, bs: int):
        self.out: dict[tuple[int, int], np.ndarray] = {}
        self._scratch = np.empty((bs, bs))

    def add(self, left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]]) -> None:
        for r, a in left:
            for k, b in right:
                if (r, k) in self.out:
                    np.matmul(a, b, out=self._scratch)
                    self.out[r, k] += self._scratch
                else:
                    self.out[r, k] = a @ b


def tile_product_kernel(bs: int, binary: bool, dims: tuple[int, int] | None = None) -> Kernel:
    """Group of A- and B-blocks of one product tile -> the tile's result blocks, summed over its contracted range.

    Rows are ``path, mat, br, bc, data`` in the order of the contracted index, so only the result tile and the blocks
    of one index are held. Absent blocks take no part: a result block appears only if some pair of blocks contributes
    to it. With ``dims`` results are final and the padding of edge blocks is cleared.
    """

    def tile_product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Accumulator(bs)
        left: list[tuple[int, np.ndarray]] = []
        right: list[tuple[int, np.ndarray]] = []
        path, at = 0, None
        for path, mat, br, bc, block in _rows(batches, bs, ["path", "mat", "br", "bc"]):
            c = bc if mat == "A" else br
            if c != at:
                total.add(left, right)
                left, right, at = [], [], c
            if mat == "A":
                left.append((br, block))
            else:
                right.append((bc, block))
        total.add(left, right)
        rows = ((path, r, k, clear_padding(block, r, k, dims)) for (r, k), block in total.out.items())
        yield from emit(rows, ["path", "br", "bc", "data"], bs, binary)

    return tile_product


def pair_product_kernel(bs: int, held_bytes: int) -> Kernel:
    """Rows ``br, bc, a, b`` of pairs of blocks -> parts ``br, bc, data`` of result blocks, of at most ``held_bytes`` at a time."""

    def pair_product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        scratch = np.empty((bs, bs))
        most = max(1, held_bytes // (8 * bs * bs))

        def passed_on() -> Iterator[pa.RecordBatch]:
            yield from emit(((*key, block) for key, block in total.items()), ["br", "bc", "data"], bs, binary=True)
            total.clear()

        for batch in batches:
            keys = zip(batch.column("br").to_pylist(), batch.column("bc").to_pylist())
            for key, a, b in zip(keys, block_views(batch.column("a"), bs), block_views(batch.column("b"), bs)):
                if key in total:
                    np.matmul(a, b, out=scratch)
                    total[key] += scratch
                    continue
                if len(total) >= most:
                    yield from passed_on()
                total[key] = a @ b
        yield from passed_on()

    return pair_product


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Views of the four quadrants: 11, 12, 21, 22."""
    r, c = x.shape[0] // 2, x.shape[1] // 2
    return x[:r, :c], x[:r, c:], x[r:, :c], x[r:, c:]


def strassen_add(c: np.ndarray, a: np.ndarray, b: np.ndarray, leaf: int) -> None:
    """C += A @ B by Winograd's form of Strassen's product, down to sides of less than ``2 * leaf`` or odd ones.

    Seven products and fifteen sums a level, four of them into C. Scratch space is two operand quadrants and two result
    quadrants a level, 4/3 of that in all.
    """
    sides = (*a.shape, b.shape[1])
    if min(sides) < 2 * leaf or any(side % 2 for side in sides):
        c += a @ b
        return
    a11, a12, a21, a22 = _halves(a)
    b11, b12, b21, b22 = _halves(b)
    c11, c12, c21, c22 = _halves(c)
    s, t, p, u = np.empty(a11.shape), np.empty(b11.shape), np.empty(c11.shape), np.empty(c11.shape)

    def product(out: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if min(sides) // 2 < 2 * leaf:
            return np.matmul(left, right, out=out)
        out[:] = 0.0
        strassen_add(out, left, right, leaf)
        return out

    product(u, a11, b11)
    c11 += u
    c11 += product(p, a12, b21)
    np.add(a21, a22, out=s)  # S1
    np.subtract(b12, b11, out=t)  # T1
    product(p, s, t)
    c22 += p
    c12 += p
    s -= a11  # S2
    np.subtract(b22, t, out=t)  # T2
    u += product(p, s, t)  # U2
    c12 += u
    np.subtract(a12, s, out=s)  # S4
    c12 += product(p, s, b22)
    t -= b21  # T4
    c21 -= product(p, a22, t)
    np.subtract(a11, a21, out=s)  # S3
    np.subtract(b22, b12, out=t)  # T3
    u += product(p, s, t)  # U3
    c21 += u
    c22 += u


class _Panel:
    """Blocks of one operand for a few contracted indexes, side by side in one array."""

    def __init__(self, rows: int, cols: int, bs: int):
        self.bs, self.stored = bs, np.zeros((rows, cols), bool)
        self.data = np.zeros((rows * bs, cols * bs))

    def put(self, r: int, c: int, block: np.ndarray) -> None:
        self.block(r, c)[:] = block
        self.stored[r, c] = True

    def block(self, r: int, c: int) -> np.ndarray:
        return self.data[r * self.bs:(r + 1) * self.bs, c * self.bs:(c + 1) * self.bs]

    def clear(self) -> None:
        for r, c in np.argwhere(self.stored):
            self.block(r, c)[:] = 0.0
        self.stored[:] = False


def panel_product_kernel(
    bs: int, tile: tuple[int, int, int], tiles: tuple[int, int, int], depth: int, leaf: int, binary: bool, dims: tuple[int, int] | None = None
) -> Kernel:
    """As :func:`tile_product_kernel`, with ``depth`` contracted indexes multiplied at a time, by Strassen's product.

    Rows also have ``base``, the number of the tile. Where less than ``FULL`` of a panel's pairs of blocks are stored, or
    a value is not finite (which Strassen's sums would spread), its pairs are multiplied one by one, so a result block
    and a cell depend on exactly what they depend on in the plain product.
    """
    (tr, tc, tk), (_, nc, nk) = tile, tiles

    def panel_product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, total = _Panel(tr, depth, bs), _Panel(depth, tk, bs), _Panel(tr, tk, bs)

        def finish() -> None:
            pairs = left.stored.astype(np.int64) @ right.stored
            total.stored |= pairs > 0
            rows, cols = (np.flatnonzero(pairs.any(axis=axis)) for axis in (1, 0))
            if len(rows):
                # To the last index in use, and one more if that makes the side even.
                inner = int(np.flatnonzero(left.stored.any(axis=0) & right.stored.any(axis=1))[-1]) + 1
                h, k, w = (min(x + x % 2, most) for x, most in ((rows[-1] + 1, tr), (inner, depth), (cols[-1] + 1, tk)))
                a, b, c = left.data[: h * bs, : k * bs], right.data[: k * bs, : w * bs], total.data[: h * bs, : w * bs]
                if pairs.sum() >= FULL * h * k * w and np.isfinite(a.sum()) and np.isfinite(b.sum()):
                    strassen_add(c, a, b, leaf)
                else:
                    for r, n in np.argwhere(pairs > 0):
                        for m in np.flatnonzero(left.stored[r] & right.stored[:, n]):
                            total.block(r, n)[:] += left.block(r, m) @ right.block(m, n)
            left.clear()
            right.clear()

        path, base, at = 0, 0, None
        for path, base, mat, br, bc, block in _rows(batches, bs, ["path", "base", "mat", "br", "bc"]):
            index = (bc if mat == "A" else br) % tc
            if at is not None and index // depth != at:
                finish()
            at = index // depth
            if mat == "A":
                left.put(br % tr, index % depth, block)
            else:
                right.put(index % depth, bc % tk, block)
        finish()
        first_row, first_col = base // (nc * nk) * tr, base % nk * tk
        rows = (
            (path, first_row + int(r), first_col + int(k), clear_padding(total.block(r, k).copy(), first_row + int(r), first_col + int(k), dims))
            for r, k in np.argwhere(total.stored)
        )
        yield from emit(rows, ["path", "br", "bc", "data"], bs, binary)

    return panel_product


def cell_product_kernel(
    bs: int, tile: tuple[int, int, int], tiles: tuple[int, int, int], binary: bool, dims: tuple[int, int] | None = None
) -> Kernel:
    """Group of A- and B-cells of one product tile -> the tile's result blocks.

    Rows are ``base, c, is_left, pos, v`` in the order of ``c``, the contracted block index within the tile; ``base``
    numbers the tile and ``pos`` is the cell's place in the tile's slice of blocks with that index, block after block.
    The group streams in; the result tile and one slice of either operand are held.
    """
    (tr, _, tk), (_, nc, nk) = tile, tiles

    def cell_product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Accumulator(bs)
        sides = [(np.zeros((tr, bs, bs)), np.zeros(tr, bool)), (np.zeros((tk, bs, bs)), np.zeros(tk, bool))]

        def finish() -> None:
            left, right = ([(int(n), dense[n]) for n in np.flatnonzero(stored)] for dense, stored in sides)
            total.add(left, right)
            for dense, stored in sides:
                dense[stored] = 0.0
                stored[:] = False

        base, at = 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            base = batch.column("base")[0].as_py()
            index = batch.column("c").to_numpy()
            is_left = batch.column("is_left").to_numpy(zero_copy_only=False)
            pos, v = batch.column("pos").to_numpy(), batch.column("v").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(index)) + 1).tolist(), len(index)]
            for first, last in zip(cuts[:-1], cuts[1:]):
                if index[first] != at:
                    finish()
                    at = index[first]
                for (dense, stored), mine in zip(sides, (is_left[first:last], ~is_left[first:last])):
                    place = pos[first:last][mine]
                    dense.reshape(-1)[place] = v[first:last][mine]
                    stored[place // (bs * bs)] = True
        finish()
        first_row, first_col = base // (nc * nk) * tr, base % nk * tk
        rows = (
            (0, first_row + r, first_col + k, clear_padding(block, first_row + r, first_col + k, dims))
            for (r, k), block in total.out.items()
        )
        yield from emit(rows, ["path", "br", "bc", "data"], bs, binary)

    return cell_product


#: Nanoseconds of one product of two entries, and of one multiplication inside a dense product of values and of places.
PAIR_NS, LAID_OUT_NS = 20.0, 0.1
#: Entries of a tile that are multiplied at a time, products formed at a time, contracted indexes laid out at a time.
CHUNK_ROWS, PAIRS, PANEL = 1 << 18, 1 << 21, 256


class _EntrySums:
    """Sums of a result tile of ``tr x tk`` cells and one more row and column, for indexes that are null."""

    def __init__(self, tr: int, tk: int):
        self.tr, self.tk = tr, tk
        self.total = np.zeros((tr + 1, tk + 1))
        self.met, self.valued = np.zeros((tr + 1, tk + 1), bool), np.zeros((tr + 1, tk + 1), bool)

    def add(self, c: np.ndarray, is_left: np.ndarray, at: np.ndarray, v: np.ndarray, null: np.ndarray) -> None:
        """All entries of some contracted indexes, in their order."""
        c = np.concatenate(([0], np.cumsum(c[1:] != c[:-1])))
        a, b = ([x[side] for x in (c, at, v, null)] for side in (is_left, ~is_left))
        self.add_sides(a, b, int(c[-1]) + 1)

    def add_sides(self, a: list, b: list, indexes: int) -> None:
        """All entries ``c, at, v, null`` of A and of B of the contracted indexes 0 to ``indexes`` - 1, in their order."""
        start = np.searchsorted(b[0], np.arange(indexes + 1))
        counts = (start[1:] - start[:-1])[a[0]]
        plain = not any(x[3].any() or not np.isfinite(x[2]).all() for x in (a, b))
        for first in range(0, indexes, PANEL):
            lo, hi = np.searchsorted(a[0], (first, first + PANEL))
            own = slice(start[first], start[min(first + PANEL, indexes)])
            pairs = int(counts[lo:hi].sum())
            if not pairs:
                continue
            if plain and pairs * PAIR_NS > self.total.size * min(PANEL, indexes - first) * LAID_OUT_NS:
                self._lay_out([x[lo:hi] for x in a[:3]], [x[own] for x in b[:3]], first)
            else:
                self._pair([x[lo:hi] for x in a], b, counts[lo:hi], start)

    def _lay_out(self, a: list, b: list, first: int) -> None:
        left, right = np.zeros((self.tr + 1, PANEL)), np.zeros((PANEL, self.tk + 1))
        left[a[1], a[0] - first] = a[2]
        right[b[0] - first, b[1]] = b[2]
        self.total += left @ right
        left, right = (np.zeros(x.shape, np.float32) for x in (left, right))
        left[a[1], a[0] - first] = 1
        right[b[0] - first, b[1]] = 1
        self.valued |= left @ right > 0

    def _pair(self, a: list, b: list, counts: np.ndarray, start: np.ndarray) -> None:
        total, met, valued = (x.reshape(-1) for x in (self.total, self.met, self.valued))
        ends = np.cumsum(counts)
        first = 0
        while first < len(counts):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
            own = counts[first:last]
            each = np.repeat(np.arange(first, last), own)
            other = np.arange(len(each)) - np.repeat(ends[first:last] - own - done, own) + start[a[0][each]]
            cell = a[1][each] * np.int64(self.tk + 1) + b[1][other]
            null = a[3][each] | b[3][other]
            if null.any():
                met[cell[null]] = True
                each, other, cell = each[~null], other[~null], cell[~null]
            with np.errstate(invalid="ignore", over="ignore"):
                np.add.at(total, cell, a[2][each] * b[2][other])
            valued[cell] = True
            first = last

    def entries(self, first_row: int, first_col: int) -> Iterator[pa.RecordBatch]:
        """``i, j, v`` of the cells in which entries have met; null where no product has a value."""
        self.met |= self.valued
        cells = np.flatnonzero(self.met)
        for k in range(0, len(cells), CHUNK_ROWS):
            some = cells[k:k + CHUNK_ROWS]
            row, col = np.divmod(some, self.tk + 1)
            yield pa.RecordBatch.from_arrays([
                pa.array(row + first_row, mask=row == self.tr),
                pa.array(col + first_col, mask=col == self.tk),
                pa.array(self.total.reshape(-1)[some] + 0.0, mask=~self.valued.reshape(-1)[some]),
            ], ["i", "j", "v"])


def entry_product_kernel(tr: int, tk: int) -> Kernel:
    """Group of A- and B-entries of one result tile of ``tr x tk`` cells -> the tile's entries.

    Rows are ``rt, kt, piece, packed`` (see :mod:`.packed`); a packed row has all of the tile's entries of some contracted
    indexes, with the row or column within the tile, and ``tr`` or ``tk`` for one that is null. Cells of an operand are
    distinct, so an index has no more rows than the tile has sides. The group streams in; the tile and the entries of some
    indexes are held.
    """
    from .packed import product_kernel

    return product_kernel(tr, tk)


def divide_kernel(a_terms: dict, b_terms: dict, bs: int, binary: bool) -> Kernel:
    """Group of blocks at one in-quadrant position -> the operand blocks of every sub-problem at that position.

    Rows are ``mat, path, qr, qc, br, bc, data`` with one ``mat``, ``path``, ``br`` and ``bc`` per group; a sub-problem
    whose quadrants are all absent gets no block.
    """

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quadrants: dict[tuple[int, int], np.ndarray] = {}
        mat, path, r, c = "A", 0, 0, 0
        for mat, path, qr, qc, r, c, block in _rows(batches, bs, ["mat", "path", "qr", "qc", "br", "bc"]):
            quadrants[qr, qc] = block
        terms = a_terms if mat == "A" else b_terms

        def operands():
            for sub, combination in terms.items():
                present = [(s, quadrants[q, p]) for q, p, s in combination if (q, p) in quadrants]
                if present:
                    total = present[0][0] * present[0][1]
                    for s, block in present[1:]:
                        if s == 1.0:
                            total += block
                        else:
                            total -= block
                    yield mat, path * len(terms) + sub, r, c, total

        yield from emit(operands(), ["mat", "path", "br", "bc", "data"], bs, binary)

    return divide


def _plus(x: np.ndarray | None, y: np.ndarray | None, sign: float = 1.0) -> np.ndarray | None:
    """``x + sign * y`` where None is an absent block."""
    if y is None:
        return x
    if x is None:
        return y if sign > 0 else 0.0 - y
    return x + y if sign > 0 else x - y


def shared_divide_kernel(bs: int) -> Kernel:
    """As :func:`divide_kernel` for one level of Winograd's form: four sums an operand, each formed once.

    Sub-problems 0 to 6 are A11 B11, A12 B21, S4 B22, A22 T4, S1 T1, S2 T2 and S3 T3.
    """

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: dict[tuple[int, int], np.ndarray] = {}
        mat, path, r, c = "A", 0, 0, 0
        for mat, path, qr, qc, r, c, block in _rows(batches, bs, ["mat", "path", "qr", "qc", "br", "bc"]):
            x[qr, qc] = block
        x11, x12, x21, x22 = (x.get(q) for q in ((0, 0), (0, 1), (1, 0), (1, 1)))
        if mat == "A":
            s1 = _plus(x21, x22)
            s2 = _plus(s1, x11, -1.0)
            found = (x11, x12, _plus(x12, s2, -1.0), x22, s1, s2, _plus(x11, x21, -1.0))
        else:
            t1 = _plus(x12, x11, -1.0)
            t2 = _plus(x22, t1, -1.0)
            found = (x11, x21, x22, _plus(t2, x21, -1.0), t1, t2, _plus(x22, x12, -1.0))
        rows = ((mat, path * 7 + m, r, c, block) for m, block in enumerate(found) if block is not None)
        yield from emit(rows, ["mat", "path", "br", "bc", "data"], bs, binary=True)

    return divide


def shared_combine_kernel(step_rows: int, step_cols: int, bs: int, dims: tuple[int, int] | None) -> Kernel:
    """As :func:`combine_kernel` for one level of Winograd's form: seven sums, each formed once."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: list[np.ndarray | None] = [None] * 7
        parent, r, c = 0, 0, 0
        for path, r, c, block in _rows(batches, bs, ["path", "br", "bc"]):
            parent, sub = divmod(path, 7)
            p[sub] = _plus(p[sub], block)  # a product may come in parts
        u2 = _plus(p[0], p[5])
        u3, u4 = _plus(u2, p[6]), _plus(u2, p[4])
        found = ((0, 0, _plus(p[0], p[1])), (0, 1, _plus(u4, p[2])), (1, 0, _plus(u3, p[3], -1.0)), (1, 1, _plus(u3, p[4])))

        def placed():
            for qr, qc, block in found:
                br, bc = qr * step_rows + r, qc * step_cols + c
                if block is not None and (dims is None or (br * bs < dims[0] and bc * bs < dims[1])):
                    yield parent, br, bc, clear_padding(block + 0.0, br, bc, dims)

        yield from emit(placed(), ["path", "br", "bc", "data"], bs, binary=dims is None)

    return combine


def combine_kernel(
    terms: dict, step_rows: int, step_cols: int, bs: int, n_rows: int | None, n_cols: int | None, binary: bool
) -> Kernel:
    """Group of sub-product blocks at one position -> the result blocks they form, placed in the parent grid.

    Rows are ``path, br, bc, data``; several rows of one path (partial products) simply add up. When ``n_rows`` and
    ``n_cols`` are given this is the outermost level: blocks outside the matrix are dropped and the padding of edge
    blocks is set to zero.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[int, int], np.ndarray] = {}
        parent, r, c = 0, 0, 0
        for path, r, c, block in _rows(batches, bs, ["path", "br", "bc"]):
            parent, sub = divmod(path, len(terms))
            for qr, qc, s in terms[sub]:
                if (qr, qc) not in out:
                    out[qr, qc] = s * block
                elif s == 1.0:
                    out[qr, qc] += block
                else:
                    out[qr, qc] -= block

        def placed():
            for (qr, qc), block in out.items():
                br, bc = qr * step_rows + r, qc * step_cols + c
                if n_rows is not None:
                    if br * bs >= n_rows or bc * bs >= n_cols:
                        continue
                    clear_padding(block, br, bc, (n_rows, n_cols))
                yield parent, br, bc, block

        yield from emit(placed(), ["path", "br", "bc", "data"], bs, binary)

    return combine
