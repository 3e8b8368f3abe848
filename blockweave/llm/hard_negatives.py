"""Hard-negative mining on rotated one-bit codes.

A vector is rotated by signs and Hadamard transforms and kept as the signs of its coordinates, with its alignment (the
inner product of vector and code). What the code leaves of the vector is orthogonal to the code; it is rotated and coded
again, ``LEVELS`` times, and the length of the last residual is stored. An anchor is rotated the same way, quantised and
cut into bit planes, so that popcounts estimate its inner product with a vector. By Cauchy-Schwarz the estimate is off by
at most the product of the two residuals' lengths plus the known error of the quantisation. Only pairs whose interval
reaches into the range asked for and above the worst result so far are scored, in integers; so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage, unstage
from . import query_grid

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score is at least this share of the positive's, and at most that one, in hundredths.
RANGE = (30, 90)
LEVELS = 4
PLANES = 8
SEED = 1729
#: Pairs that are estimated at a time.
TILE_PAIRS = 1 << 17
#: Relative slack of the bounds for rounding in floating point.
SLACK = 1e-9

_CODED = "vec_id bigint, label bigint, embedding array<double>, codes binary, aligned binary, rest double"
_LOWEST = np.iinfo(np.int64).min


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, embedding`` of the rows that take part, one per ``vec_id`` (the least by label, then vector)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select("vec_id", F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return query_grid.one_per_id(rows.dropna().filter(finite), "vec_id")


def vectors(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """A list column as rows of ``floor(scale * x)``; shorter vectors end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if (np.abs(values) >= 2.0**63).any():
        raise ValueError("a component does not fit into 64 bits")
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def rotate(x: np.ndarray, level: int) -> np.ndarray:
    """An orthogonal map of rows whose width is a power of two: three rounds of random signs and a Hadamard transform."""
    width = x.shape[1]
    for signs in np.random.default_rng((SEED, level)).integers(0, 2, (3, width)) * 2.0 - 1:
        x = x * signs
        step = 1
        while step < width:
            pairs = x.reshape(len(x), -1, 2, step)
            x = np.concatenate((pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]), axis=2).reshape(len(x), width)
            step *= 2
        x = x / np.sqrt(width)
    return x


def padded(x: np.ndarray) -> np.ndarray:
    """Zeros up to a power of two of at least 64 columns."""
    width = max(64, 1 << max(x.shape[1] - 1, 0).bit_length())
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def words(bits: np.ndarray) -> np.ndarray:
    """The last axis of booleans as 64-bit words."""
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows, levels, words), alignments (rows, levels) and the length of what they leave."""
    rest, codes, aligned = padded(x), [], []
    for level in range(LEVELS):
        rest = rotate(rest, level)
        unit = np.where(rest > 0, 1.0, -1.0) / np.sqrt(rest.shape[1])
        along = np.abs(rest).sum(axis=1) / np.sqrt(rest.shape[1])
        codes.append(words(rest > 0))
        aligned.append(along)
        rest = rest - along[:, None] * unit
    return np.stack(codes, axis=1), np.stack(aligned, axis=1), np.linalg.norm(rest, axis=1)


class Anchors:
    """Bit planes of a block of anchors, and bounds of their inner products with coded vectors."""

    def __init__(self, x: np.ndarray):
        turned, self.planes, self.step, self.error, self.sums = padded(x), [], [], [], []
        half = 1 << (PLANES - 1)
        for level in range(LEVELS):
            turned = rotate(turned, level)
            step = np.abs(turned).max(axis=1, initial=0) / (half - 1)
            step[step == 0] = 1
            whole = np.rint(turned / step[:, None]).astype(np.int64)
            self.planes.append(words((whole[:, None, :] + half) >> np.arange(PLANES)[:, None] & 1 == 1))
            self.step.append(step / np.sqrt(turned.shape[1]))
            self.error.append(np.linalg.norm(turned - whole * step[:, None], axis=1))
            self.sums.append(whole.sum(axis=1))
        self.length = np.linalg.norm(x, axis=1)

    def bounds(self, some: np.ndarray, codes: np.ndarray, aligned: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most of the inner products of the anchors ``some`` (first axis) with the coded rows (second)."""
        middle, off = np.zeros((len(some), len(codes))), np.zeros((len(some), len(codes)))
        for level in range(LEVELS):
            planes, code = self.planes[level][some], codes[:, level]
            ones = np.bitwise_count(code).sum(axis=1, dtype=np.int32)
            inside = np.zeros(middle.shape, np.int32)
            for p in range(PLANES):
                for w in range(code.shape[1]):
                    inside += np.bitwise_count(planes[:, p, w, None] & code[None, :, w]).astype(np.int32) << p
            inner = 2 * (inside - (1 << (PLANES - 1)) * ones) - self.sums[level][some][:, None]
            middle += inner * self.step[level][some][:, None] * aligned[:, level]
            off += self.error[level][some][:, None] * aligned[:, level]
        size = np.sqrt((aligned**2).sum(axis=1) + rest**2)
        off += self.length[some][:, None] * (rest + SLACK * size) + SLACK
        return middle - off, middle + off


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; fails if one may not fit into 64 bits."""
    most = (np.abs(x).max(initial=0) * np.abs(y).max(initial=0)) * x.shape[1]
    if most < 2.0**53:
        return np.einsum("ij,ij->i", x, y).astype(np.int64)
    found = [sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for p, q in zip(x.tolist(), y.tolist(), strict=True)]
    return np.array(found, dtype=np.int64)


class Best:
    """The best ``k`` rows of each of ``n`` groups: highest scores first, ties by smaller id.

    What is added waits until there is as much of it as is held, so sorting costs little in all. ``floor`` is a score
    below which nothing can enter any more.
    """

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, _LOWEST)
        self.held = tuple(np.zeros(0, np.int64) for _ in range(3))
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def add(self, group: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        self.waiting.append((group, score, vec_id))
        self.count += len(group)
        if self.count > max(4096, len(self.held[0])):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, score, vec_id = (np.concatenate(p) for p in zip(self.held, *self.waiting, strict=True))
        order = np.lexsort((vec_id, ~score, group))  # ~ reverses the order of whole numbers without overflow
        group, score, vec_id = group[order], score[order], vec_id[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        last = rank == self.k - 1
        self.floor[group[last]] = score[last]
        keep = rank < self.k
        self.held, self.waiting, self.count = (group[keep], score[keep], vec_id[keep]), [], 0
        return self.held


def coded(rows: DataFrame, width: int, scale: float = SCALE) -> DataFrame:
    """``rows`` of :func:`usable` in whole numbers, with codes, alignments and the last residual's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = vectors(batch.column("embedding"), width, scale)
                codes, aligned, rest = encode(x)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * width, x.ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), lists, _bytes(codes), _bytes(aligned), pa.array(rest)],
                    ["vec_id", "label", "embedding", "codes", "aligned", "rest"],
                )

    return rows.mapInArrow(run, _CODED)


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _numbers(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _search(cells: DataFrame, width: int, wanted, schema: str) -> DataFrame:
    """Read the anchors of each cell, hand every tile of rows to ``wanted(anchors)``, and return what it then has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, search = [], None
        for batch in batches:
            asks = batch.column("is_query").to_numpy(zero_copy_only=False)
            if asks.any():
                held.append(batch.filter(pa.array(asks)))
            batch = batch.filter(pa.array(~asks))
            if not batch.num_rows or not held:
                continue
            search = search or wanted(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            tile = max(1, TILE_PAIRS // max(1, search.size))
            for at in range(0, batch.num_rows, tile):
                part = batch.slice(at, tile)
                ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
                codes = _numbers(part.column("codes"), "<u8", LEVELS, -1)
                search.see(ids, labels, vectors(part.column("embedding"), width, 1), codes, _numbers(part.column("aligned"), "<f8", LEVELS), part.column("rest").to_numpy())
        if search:
            yield search.found()

    return cells.mapInArrow(run, schema)


class _Positives:
    """The best rows of each anchor's own label."""

    def __init__(self, block: pa.RecordBatch, width: int, k: int):
        self.ids, self.labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
        self.x = vectors(block.column("embedding"), width, 1)
        self.anchors, self.best, self.size = Anchors(self.x), Best(len(self.ids), k), len(self.ids)

    def see(self, ids, labels, x, codes, aligned, rest) -> None:
        for label in np.intersect1d(labels, self.labels):
            some, rows = np.flatnonzero(self.labels == label), np.flatnonzero(labels == label)
            _, most = self.anchors.bounds(some, codes[rows], aligned[rows], rest[rows])
            open_ = (most >= self.best.floor[some][:, None]) & (self.ids[some][:, None] != ids[rows])
            a, r = np.nonzero(open_)
            a, r = some[a], rows[r]
            self.best.add(a, inner(self.x[a], x[r]), ids[r])

    def found(self) -> pa.RecordBatch:
        group, score, vec_id = self.best.settle()
        return pa.RecordBatch.from_arrays([pa.array(self.ids[group]), pa.array(vec_id), pa.array(score)], ["anchor_id", "vec_id", "score"])


class _Negatives:
    """The best rows of other labels whose score lies in the range of each of the anchors' positives."""

    def __init__(self, block: pa.RecordBatch, width: int, k: int, share: tuple[int, int]):
        self.ids, self.labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
        self.x = vectors(block.column("embedding"), width, 1)
        self.anchors, self.size = Anchors(self.x), len(self.ids)
        lists = block.column("positives")
        counts = np.diff(lists.offsets.to_numpy())
        pairs = lists.flatten()
        self.positive, self.reach = pairs.field("vec_id").to_numpy(), pairs.field("score").to_numpy()
        #: Pairs of anchor and positive in order of anchors; every anchor has one at least.
        self.of, self.first = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
        # In Python's whole numbers, as 100 scores may pass 64 bits.
        self.low = np.array([-(-share[0] * s // 100) for s in self.reach.tolist()], dtype=np.int64)
        self.high = np.array([share[1] * s // 100 for s in self.reach.tolist()], dtype=np.int64)
        self.best = Best(len(self.of), k)

    def see(self, ids, labels, x, codes, aligned, rest) -> None:
        every = np.arange(self.size)
        least, most = self.anchors.bounds(every, codes, aligned, rest)
        lowest = np.minimum.reduceat(np.maximum(self.low, self.best.floor), self.first)
        highest = np.maximum.reduceat(self.high, self.first)
        open_ = (most >= lowest[:, None]) & (least <= highest[:, None]) & (self.labels[:, None] != labels)
        a, r = np.nonzero(open_)
        score = inner(self.x[a], x[r])
        for nth in range(int(np.bincount(self.of, minlength=1).max())):
            pair = self.first[a] + nth
            own = pair < np.append(self.first, len(self.of))[a + 1]
            own[own] = (score[own] >= self.low[pair[own]]) & (score[own] <= self.high[pair[own]]) & (score[own] >= self.best.floor[pair[own]])
            self.best.add(pair[own], score[own], ids[r[own]])

    def found(self) -> pa.RecordBatch:
        pair, score, vec_id = self.best.settle()
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[self.of[pair]]), pa.array(self.positive[pair]), pa.array(self.reach[pair]), pa.array(vec_id), pa.array(score)],
            ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"],
        )


def _first(rows: DataFrame, by: list[str], score: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(key))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = RANGE, scale: float = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of vectors ``vec_id, label, embedding``.

    ``anchors`` is a condition on these columns. Vectors count as ``floor(scale * x)``. A row with a null id, label or
    vector or a null or non-finite component takes no part; of rows that repeat a ``vec_id`` the least takes part; vectors
    shorter than the longest end in zeros (so does an empty one); ties go to smaller ids; anchors without another row of
    their label, or without a negative in range, give no rows; an empty table gives none. Scores beyond 64 bits fail.
    """
    spark = rows.sparkSession
    rows = usable(rows)
    asks = F.count_if(anchors)
    n, asked, width = rows.agg(F.count("*"), asks, F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    grid = query_grid.plan(spark, n, asked)
    known = stage(coded(rows, width, scale), "vector-codes")
    chosen = known.filter(anchors)

    def positive(block):
        return _Positives(block, width, positives)

    def negative(block):
        return _Negatives(block, width, negatives, share)

    near = _search(query_grid.cells(known, chosen, grid, "vec_id", "vec_id", True), width, positive, "anchor_id bigint, vec_id bigint, score bigint")
    near = _first(near, ["anchor_id"], "score", "vec_id", positives)
    near = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "score"))).alias("positives"))
    near = stage(near, "positives")
    chosen = chosen.join(near, chosen["vec_id"] == near["anchor_id"]).drop("anchor_id")
    none = F.lit(None).cast("array<struct<vec_id:bigint,score:bigint>>")
    both = query_grid.cells(known.withColumn("positives", none), chosen, grid, "vec_id", "vec_id", True)
    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = _first(_search(both, width, negative, schema), ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    found = stage(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    for used in (known, near):
        unstage(used)
    return found
