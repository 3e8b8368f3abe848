"""SimHash near-duplicates through vantage-point trees.

Fingerprints that differ in at most ``radius`` bits agree wholly on one of ``radius + 1`` blocks of bits. A shard holds the
points that share the first bits of a block, as many bits as make it a few thousand points; so a linked pair meets in one
shard at least. A task builds a vantage-point tree over its shard and joins the shard with itself through it: a node parts
its points by Hamming distance to one of them, and by the triangle inequality a point looks for partners on one side only
unless it lies within ``radius`` of the border. Shards that are still too large once all bits of the block are used are
parted by distance in Spark, and points of the border go to both sides. Shards yield stars, not all pairs: a linked
set of n fingerprints gives n - 1 links, which keep its reach. Equal fingerprints are one point.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import owned, stage
from .common import map_arrow
from .components import connected_components

RADIUS = 3
WORDS = 3
SEED = 42
#: Points of a shard that a task takes whole (prefixes are chosen for half as many), and of a leaf of its tree.
SHARD_POINTS = 8192
NODE_POINTS = 8
#: Links that are held before they are reduced to stars; vantage points tried on a shard that none makes smaller.
HELD_LINKS = 1 << 20
TRIES = 4

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, size: int = WORDS, seed: int = SEED) -> int:
    """64 bits as a signed number; null, empty and blank texts have fingerprint zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, ASCII blanks only
    if not words:
        return 0
    line = b" ".join(words)
    size = min(size, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[size - 1:].tolist(), strict=True)], dtype="<u8")
    octets = h.view(np.uint8).reshape(-1, 8)
    set_in = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(set_in * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, fp bigint", "text")


class Links:
    """Linked sets of ``n`` points: links come in as arrays and are reduced to stars when many are held."""

    def __init__(self, n: int):
        self.least, self.held, self.count = np.arange(n), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.count += len(a)
        if self.count > HELD_LINKS:
            self.reduce()

    def reduce(self) -> np.ndarray:
        """For each point, the least member of its linked set."""
        a, b = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *self.held, strict=True))
        while True:
            x, y = self.least[a], self.least[b]
            apart = x != y
            if not apart.any():
                break
            a, b, low, high = a[apart], b[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            np.minimum.at(self.least, high, low)
            while (self.least != (up := self.least[self.least])).any():
                self.least = up
        self.held, self.count = [], 0
        return self.least


def linked(points: np.ndarray, radius: int = RADIUS, node: int = NODE_POINTS, seen: Counter | None = None) -> np.ndarray:
    """For each of the distinct ``points``, the index of the least member of its linked set.

    A node of the vantage-point tree comes with the points inside it and those that may have a partner there. ``seen``
    counts nodes that were parted, points that the bounds kept out of a side, border points, and compared pairs.
    """
    links, seen = Links(len(points)), Counter() if seen is None else seen
    everyone = np.arange(len(points))
    todo = [(everyone, everyone)]
    while todo:
        inside, asking = todo.pop()
        if not len(asking):
            continue
        if len(inside) > node:
            vantage = points[inside[len(inside) // 2]]
            far = np.bitwise_count(points[inside] ^ vantage).astype(np.int64)
            border = int(np.partition(far, len(far) // 2)[len(far) // 2])
            border -= border == far.max()  # so that neither side is empty, if distances differ at all
            if border >= far.min():
                own = np.bitwise_count(points[asking] ^ vantage).astype(np.int64)
                near, beyond = own <= border + radius, own > border - radius
                seen.update(parted=1, kept_out=2 * len(asking) - int(near.sum() + beyond.sum()), border=int((near & beyond).sum()))
                todo += [(inside[far <= border], asking[near]), (inside[far > border], asking[beyond])]
                continue
        step = max(1, HELD_LINKS // len(inside))
        for at in range(0, len(asking), step):
            some = asking[at:at + step]
            seen["compared"] += len(some) * len(inside)
            x, y = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[inside]) <= radius)
            other = some[x] < inside[y]  # each pair is found from both sides
            links.add(some[x[other]], inside[y[other]])
    return links.reduce()


def _split(shards: DataFrame, large: DataFrame, radius: int, turn: int) -> DataFrame:
    """Part each large shard at a vantage point; sides are numbered as children of the shard."""
    pick = F.min_by("fp", F.xxhash64("fp", F.lit(turn)))
    points = large.groupBy("shard").agg(pick.alias("vantage"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))).cast("int")
    far = large.join(points, "shard").select("shard", "fp", "tries", apart.alias("d"))
    # The border that makes the larger of its sides least, from a count per distance: 65 rows a shard at most.
    counts = far.groupBy("shard", "d").count().groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("d", "count"))).alias("n"))

    def upto(d):
        return F.aggregate(F.filter(F.map_keys("n"), lambda k: k <= d), F.lit(0).cast("bigint"), lambda s, k: s + F.element_at("n", k))

    total = upto(F.lit(64))
    rated = F.transform(F.map_keys("n"), lambda d: F.struct(F.greatest(upto(d + radius), total - upto(d)).alias("larger"), d.alias("border")))
    borders = counts.select("shard", F.array_min(rated).alias("best"), total.alias("total"))
    # A shard that no border makes smaller by a tenth waits for another vantage point, and is taken whole after a few.
    borders = borders.select("shard", F.when(F.col("best.larger") <= 0.9 * F.col("total"), F.col("best.border")).alias("border"))
    sided = far.join(borders, "shard")
    inner = sided.filter("border IS NOT NULL AND d <= border + " + str(radius)).select(F.xxhash64("shard", F.lit(0)).alias("shard"), "fp", F.lit(0).alias("tries"))
    outer = sided.filter("border IS NOT NULL AND d > border").select(F.xxhash64("shard", F.lit(1)).alias("shard"), "fp", F.lit(0).alias("tries"))
    same = sided.filter("border IS NULL").select("shard", "fp", (F.col("tries") + 1).alias("tries"))
    return shards.unionByName(inner).unionByName(outer).unionByName(same)


def shard_points(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """``shard, fp``: each point in one shard for each block of bits; larger shards are parted by distance."""
    blocks, width = radius + 1, 64 // (radius + 1)
    # As many first bits of a block as part evenly spread points into shards of half the size allowed.
    bits = min(width, max(0, math.ceil(math.log2(max(1, 2 * points.count() / shard_points)))))

    def prefix(block: int) -> Column:
        value = F.shiftrightunsigned("fp", block * width + width - bits).bitwiseAND(F.lit((1 << bits) - 1))
        return F.xxhash64(F.lit(block), value)

    shards = points.select(F.explode(F.array(*[prefix(b) for b in range(blocks)])).alias("shard"), "fp", F.lit(0).alias("tries"))
    full, turn = bits == width, 0
    while True:
        sizes = shards.filter(F.col("tries") < TRIES).groupBy("shard").count()
        large_ids = stage(sizes.filter(F.col("count") > shard_points).select("shard"), "large-shards")
        if large_ids.isEmpty():
            return shards.select("shard", "fp")
        large = shards.join(large_ids, "shard", "left_semi")
        small = shards.join(large_ids, "shard", "left_anti")
        if not full:  # points that crowd on some prefixes: first by the rest of the block
            rest = [F.shiftrightunsigned("fp", b * width).bitwiseAND(F.lit((1 << width) - 1)) for b in range(blocks)]
            keyed = large.select("shard", "fp", "tries", F.explode(F.array(*[F.struct(prefix(b).alias("at"), F.xxhash64(F.lit(b), F.lit(7), rest[b]).alias("to")) for b in range(blocks)])).alias("x"))
            shards = stage(small.unionByName(keyed.filter("x.at = shard").select(F.col("x.to").alias("shard"), "fp", "tries")), "shards")
            full = True
            continue
        shards = stage(_split(small, large, radius, turn), "shards")
        turn += 1


def link_shards(shards: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: stars that join the linked sets of each shard."""

    def groups(batches) -> Iterator[np.ndarray]:
        key, held = None, []
        for batch in batches:
            shard, fp = (batch.column(c).to_numpy() for c in ("shard", "fp"))
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for part, ids in zip(np.split(fp, cuts), shard[np.concatenate(([0], cuts))] if len(shard) else [], strict=False):
                if key is not None and ids != key:
                    yield np.unique(np.concatenate(held))
                    held = []
                key = ids
                held.append(part)
        if held:
            yield np.unique(np.concatenate(held))

    def run(batches):
        out = []
        for points in groups(batches):
            if len(points) > 1:
                least = linked(points.view(np.uint64), radius)
                joined = np.flatnonzero(least != np.arange(len(points)))
                out.append((points[least[joined]], points[joined]))
            if len(out) > 4096:
                yield write(out)
                out = []
        if out:
            yield write(out)

    def write(out) -> pa.RecordBatch:
        a, b = (np.concatenate([o[i] for o in out]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return shards.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, points: int = SHARD_POINTS) -> DataFrame:
    """``doc_id, fp, component_id`` of each row; ``component_id`` is the least ``doc_id`` that links reach.

    Null texts count as empty; empty texts share fingerprint zero and are linked like any other; rows with a null id are
    members of their component but never name it (it is null if it has no other); an empty table gives no rows.
    """
    with owned():
        return stage(_near_duplicates(docs, radius, points), "simhash-components", keep=True)


def _near_duplicates(docs: DataFrame, radius: int, points: int) -> DataFrame:
    prints = stage(fingerprints(docs), "simhash")
    heads = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("head")), "simhash-heads")
    links = link_shards(shard_points(heads.select("fp"), radius, points), radius)
    found = connected_components(links)
    homes = heads.join(found, heads["fp"] == found["node"], "left").select("fp", "head", F.coalesce("component", "fp").alias("home"))
    homes = stage(homes, "simhash-homes")
    least = homes.groupBy("home").agg(F.min("head").alias("component_id"))
    named = homes.join(least, "home").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The document with the least id of each component, once; rows with a null id stay as they are."""
    found = near_duplicates(docs)
    keep = found.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi")
    if not found.groupBy("doc_id").count().filter("doc_id IS NOT NULL AND count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id IS NULL"))
