"""Ranked lexical search: exact inner products of sparse vectors, pruned by ball trees.

A document is the vector of what its terms add to a score; an item is the vector of its terms' weights times repeats.
Each task builds ball trees over runs of documents: a node is a ball, its centre the mean of its documents, its radius
the largest distance from it, measured in each of up to ``SPACES`` subspaces (one radius over all terms prunes nothing,
as documents differ in hundreds of terms that an item lacks). An item scores at most its product with the centre plus,
summed over subspaces, its length times the radius, all rounded upwards; so subtrees are visited best first until the
bound falls below the item's worst kept score, and the leaves reached are scored in integers. What a task has found for
an item prunes its later trees, too.

Only terms of items matter, so documents are kept as counts of those. Items go in blocks of bounded size, each a pass.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.staging import stage, unstage
from .common import pieces
from .hard_negatives import Best

BEST = 20
#: Terms, with repeats, of a block of items; a block is what a task is sent whole.
BLOCK_TERMS = 1 << 19
#: Documents and their terms in one tree, and documents of a leaf.
TREE_DOCS = 1 << 12
TREE_TERMS = 1 << 20
LEAF = 16
#: Subspaces in which a node has a radius; each has one term until there are more terms than this.
SPACES = 1 << 13
#: Relative slack of the bounds, far above what rounding can amount to.
SLACK = 1e-9

_KEEP = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
_TABLE = bytes(ord(chr(b).lower()) if b < 0x80 and b in _KEEP else b if b in _KEEP else 0x20 for b in range(256))
#: Stands for a null doc_id inside trees, so that it loses ties.
_NO_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, text, count`` of terms of each item; an id with several texts stands for the least of them."""
    one = items.groupBy("item_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [len(terms(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths, pa.int64())], ["item_id", "text", "count"])

    kind = items.schema["item_id"].dataType.simpleString()
    return one.mapInArrow(run, f"item_id {kind}, text string, count bigint").filter("count > 0")


def sparse(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, times``: length of each document that has a term, and its counts of the vocabulary."""
    size = max(len(vocabulary), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for piece in pieces(batches, "text"):
            lengths, found = [], []
            for text in piece.column("text").to_pylist():
                words = terms(text)
                lengths.append(len(words))
                found.append(np.fromiter((v for w in words if (v := known(w)) is not None), np.int64))
            counts = np.array([len(f) for f in found])
            keys, times = np.unique(np.repeat(np.arange(len(found)), counts) * size + np.concatenate(found), return_counts=True)
            offsets = np.searchsorted(keys, np.arange(len(found) + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (keys % size, times)]
            out = pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])
            yield out.filter(pa.array(np.array(lengths) > 0))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, times array<int>")


@dataclass
class Rows:
    """Sparse rows of whole numbers: columns ``at[start[i]:start[i + 1]]`` of row i hold ``value``."""

    start: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        counts = self.start[rows + 1] - self.start[rows]
        start = np.concatenate(([0], np.cumsum(counts)))
        where = np.arange(start[-1]) + np.repeat(self.start[rows] - start[:-1], counts)
        return Rows(start, self.at[where], self.value[where])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """With a vector; no row may be empty."""
        return np.add.reduceat(self.value * dense[self.at], self.start[:-1])


class Items:
    """A block of items over terms ``0 .. len(weight)``: weight times repeats for scores, and for bounds repeats times the
    root of the weight (documents' values take the other root), also as lengths in each subspace."""

    def __init__(self, repeats: Rows, weight: np.ndarray):
        self.weight, self.size = weight, len(weight)
        self.exact = Rows(repeats.start, repeats.at, repeats.value * weight[repeats.at])
        self.half = Rows(repeats.start, repeats.at, repeats.value * np.sqrt(weight[repeats.at]))
        self.spaces = min(self.size, SPACES)
        item = np.repeat(np.arange(len(repeats.start) - 1), np.diff(repeats.start))
        keys, of = np.unique(item * self.spaces + repeats.at % self.spaces, return_inverse=True)
        length = np.sqrt(np.bincount(of, self.half.value**2, minlength=len(keys)))
        self.length = Rows(np.searchsorted(keys, np.arange(len(repeats.start)) * self.spaces), keys % self.spaces, length)


class BallTree:
    """Nodes in order of creation: their documents, their children, and the bound of every item."""

    def __init__(self, docs: Rows, items: Items):
        self.docs = docs
        scaled = Rows(docs.start, docs.at, docs.value * np.sqrt(items.weight)[docs.at])
        square = np.add.reduceat(scaled.value**2, scaled.start[:-1])
        self.members, self.children, self.bound = [], [], []
        pivot = np.zeros(items.size)

        def apart(own: Rows, norms: np.ndarray, nth: int) -> np.ndarray:
            """Squared distances from a member."""
            a, b = own.start[nth], own.start[nth + 1]
            pivot[own.at[a:b]] = own.value[a:b]
            found = norms + norms[nth] - 2 * own.dot(pivot)
            pivot[own.at[a:b]] = 0
            return found

        todo = [(-1, np.arange(len(docs.start) - 1))]
        while todo:
            parent, rows = todo.pop()
            own, norms, node = scaled.take(rows), square[rows], len(self.members)
            centre = np.bincount(own.at, own.value, minlength=items.size) / len(rows)
            middle = centre @ centre
            off = norms + middle - 2 * own.dot(centre)
            bound = (items.half.dot(centre) + items.length.dot(self._radius(own, centre, items))) * (1 + SLACK)
            self.members.append(rows)
            self.children.append([])
            self.bound.append(np.minimum(bound, self.bound[parent]) if parent >= 0 else bound)
            if parent >= 0:
                self.children[parent].append(node)
            if len(rows) <= LEAF or off.max() <= SLACK * (norms.max() + middle):
                continue  # few documents, or copies of one
            one = apart(own, norms, int(np.argmax(off)))
            side = one - apart(own, norms, int(np.argmax(one)))
            order = np.argpartition(side, len(rows) // 2)
            todo += [(node, rows[order[: len(rows) // 2]]), (node, rows[order[len(rows) // 2:]])]
        self.bound = np.array(self.bound)
        self.visited = 0

    @staticmethod
    def _radius(own: Rows, centre: np.ndarray, items: Items) -> np.ndarray:
        """The largest distance of a row from the centre in each subspace, rounded upwards."""
        empty = np.bincount(np.arange(items.size) % items.spaces, centre**2, minlength=items.spaces)  # of a row without a term there
        row = np.repeat(np.arange(len(own.start) - 1), np.diff(own.start))
        more = own.value * (own.value - 2 * centre[own.at])
        if items.spaces == items.size:
            keys, size = own.at, own.value**2
        else:
            keys, of = np.unique(row * items.spaces + own.at % items.spaces, return_inverse=True)
            keys, more, size = keys % items.spaces, np.bincount(of, more), np.bincount(of, own.value**2)
        square = empty.copy()
        np.maximum.at(square, keys, empty[keys] + more + SLACK * size)
        return np.sqrt(square + SLACK * empty)

    def search(self, items: Items, best: Best, ids: np.ndarray) -> None:
        """Add to ``best`` all that can be among the items' best."""
        query = np.zeros(items.size, np.int64)
        leaves: dict[int, Rows] = {}
        for item in np.flatnonzero(self.bound[0] >= best.floor):
            a, b = items.exact.start[item], items.exact.start[item + 1]
            query[items.exact.at[a:b]] = items.exact.value[a:b]
            bound, heap, floor = self.bound[:, item].tolist(), [(-self.bound[0, item], 0)], int(best.floor[item])
            scores, found = [], []
            count = 0
            while heap and -heap[0][0] >= floor:
                node = heapq.heappop(heap)[1]
                for child in self.children[node]:
                    if bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], child))
                if not self.children[node]:
                    self.visited += 1
                    rows = self.members[node]
                    if node not in leaves:
                        leaves[node] = self.docs.take(rows)
                    score = leaves[node].dot(query)
                    good = (score > 0) & (score >= floor)
                    if good.any():
                        scores.append(score[good])
                        found.append(ids[rows[good]])
                        count += int(good.sum())
                        if count >= best.k:
                            every = np.concatenate(scores)
                            floor = max(floor, int(np.partition(every, len(every) - best.k)[len(every) - best.k]))
            query[items.exact.at[a:b]] = 0
            if scores:
                score, vec_id = np.concatenate(scores), np.concatenate(found)
                good = score >= floor
                best.add(np.full(int(good.sum()), item), score[good], vec_id[good])
        best.settle()


def _block(rows: list) -> tuple[list, Rows, dict[bytes, int]]:
    """Ids, repeats and vocabulary of a block of items."""
    vocabulary: dict[bytes, int] = {}
    start, at, times = [0], [], []
    for row in rows:
        own: dict[int, int] = {}
        for term in terms(row["text"]):
            v = vocabulary.setdefault(term, len(vocabulary))
            own[v] = own.get(v, 0) + 1
        at += own.keys()
        times += own.values()
        start.append(len(at))
    return [r["item_id"] for r in rows], Rows(np.array(start), np.array(at, np.int64), np.array(times, np.int64)), vocabulary


def _search_block(docs: DataFrame, ids: pa.Array, repeats: Rows, vocabulary: dict[bytes, int], kind: str, k: int) -> DataFrame:
    counted = stage(sparse(docs, vocabulary), "term-counts")
    n, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # no more than the vocabulary
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(v, 0) + 1))) for v in range(len(vocabulary))], np.int64)
    if int((repeats.value * weight[repeats.at]).sum()) >= (1 << 63) // 10**6:
        raise ValueError("scores may not fit into 64 bits")
    items = Items(repeats, weight)

    def rows(batch: pa.RecordBatch) -> tuple[Rows, np.ndarray]:
        """Documents that hold a term of the block, as what each term adds per weight."""
        lengths, lists = batch.column("n").to_numpy(), batch.column("terms")
        counts = np.diff(lists.offsets.to_numpy())
        at, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "times"))
        norm = 100 - 25 + 25 * lengths * n // total
        value = 1_000_000_000 * times // (1000 * times + 12 * np.repeat(norm, counts))
        own = counts > 0
        return Rows(np.concatenate(([0], np.cumsum(counts[own]))), at, value), batch.column("doc_id").fill_null(_NO_ID).to_numpy()[own]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs_held, terms_held = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                ends = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))
                start = 0
                while start < batch.num_rows:
                    used = ends[start - 1] if start else 0
                    room = int(np.searchsorted(ends, used + TREE_TERMS - terms_held, side="right"))
                    stop = min(batch.num_rows, start + TREE_DOCS - docs_held, max(room, start + (not held)))
                    if stop > start:
                        held.append(batch.slice(start, stop - start))
                        docs_held, terms_held = docs_held + stop - start, terms_held + int(ends[stop - 1] - used)
                        start = stop
                    if start < batch.num_rows:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, docs_held, terms_held = [], 0, 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in cut(batches):
            vectors, doc_ids = rows(batch)
            if len(doc_ids):
                BallTree(vectors, items).search(items, best, doc_ids)
        item, score, doc = best.settle()
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(item)), pa.array(doc, mask=doc == _NO_ID), pa.array(score)], ["item_id", "doc_id", "score"]
        )

    return counted.mapInArrow(run, f"item_id {kind}, doc_id bigint, score bigint")


def rank(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above zero of each item.

    Null and empty texts have no terms; each row of ``docs`` is a document, also if it repeats another; ties go to smaller
    ``doc_id``, a null one comes last; repeated items are one, and an item with several texts stands for the least;
    a null item id is an id like others; empty tables, and items without a term or a match, give no rows.
    """
    asked = stage(item_terms(items.select("item_id", "text")), "item-terms")
    kind = items.schema["item_id"].dataType.simpleString()
    blocks = max(1, math.ceil((asked.agg(F.sum("count")).first()[0] or 0) / BLOCK_TERMS))

    def of(blocks: int):
        return F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(blocks))

    def sizes(blocks: int) -> DataFrame:
        return asked.groupBy(of(blocks).alias("block")).agg(F.sum("count").alias("n"), F.count("*").alias("items"))

    while not sizes(blocks).filter((F.col("n") > 2 * BLOCK_TERMS) & (F.col("items") > 1)).isEmpty():
        blocks *= 2
    found = None
    for block in range(blocks):
        rows = asked.filter(of(blocks) == block).collect()  # at most twice BLOCK_TERMS terms, or one item
        ids, repeats, vocabulary = _block(rows)
        ids = pa.array(ids, to_arrow_type(items.schema["item_id"].dataType))
        some = _search_block(docs, ids, repeats, vocabulary, kind, k)
        found = some if found is None else found.unionByName(some)
    unstage(asked)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")
