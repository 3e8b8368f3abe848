"""Windows of one length that occur earlier in a corpus: how two dealt operators find them without comparing all text.

1. Each document is cut into runs: consecutive windows whose anchor, the rightmost least k-gram hash in them, is the
   same. Equal windows have the same anchor, so they meet in its bucket. Windows and runs are found by content alone.
2. Buckets are shuffled as numbers, without text. Of runs that are equal as a whole the first stays, the others are
   repeats; equal runs of one task are reduced before the shuffle. A bucket with a single run is done.
3. Runs that differ but share a bucket get their symbols from the documents and are compared by an exact kernel. A
   bucket with very many different runs is dealt into parts; what is first in a part is then compared across parts by a
   128-bit digest of each window.

An occurrence is (doc_id, start). With ``own`` a window counts as repeated if it occurs earlier in its document, too;
without, only if it occurs in a document with a smaller id. A null ``doc_id`` is neither smaller nor larger than any
other: such a document loses nothing and is no earlier one. Rows that repeat a document are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import pieces
from .fingerprints import gram_hashes, mix

#: Different runs of a bucket that are compared in one part; text that a map task cuts, and that a kernel takes, at a time.
PART_RUNS = 4_000
MAP_BYTES = 4 << 20
KERNEL_BYTES = 2 << 20

RUNS = "bucket bigint, key bigint, doc_id bigint, start int, stop int"
SPANS = "doc_id bigint, start int, stop int"


@dataclass(frozen=True)
class Windows:
    """``length`` symbols to a window, ``gram`` (a power of two) to an anchor.

    ``own``: whether a window's own document counts, see above. ``symbols``: the numbers of a text's symbols.
    """

    length: int
    gram: int
    own: bool
    symbols: Callable[[str], np.ndarray]
    #: ``content(text)`` gives a function from (first, end) in symbols to their bytes, or None past the end (of another
    #: text with the same id).
    content: Callable[[str], Callable[[int, int], bytes]]
    #: ``windows(content)`` gives a function from a window's number to its bytes.
    windows: Callable[[bytes], Callable[[int], bytes]]

    @property
    def width(self) -> int:
        return self.length - self.gram + 1


def minima(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the rightmost least hash of each window of ``width`` hashes."""
    at = np.arange(len(h), dtype=np.int32)
    value, reach = h, 1
    while 2 * reach <= width:
        later = value[reach:] <= value[:-reach]
        value = np.where(later, value[reach:], value[:-reach])
        at = np.where(later, at[reach:], at[:-reach])
        reach *= 2
    rest = width - reach
    if rest:
        later = value[rest:] <= value[:-rest]
        at = np.where(later, at[rest:], at[:-rest])
    return at


def cut_runs(symbols: np.ndarray, starts: np.ndarray, spec: Windows) -> tuple[np.ndarray, ...]:
    """``document, start, stop, bucket, key`` of the runs of documents that lie end to end in ``symbols``.

    ``starts`` has where each begins, and the end of the last. start and stop (inclusive) count windows of a document.
    ``key`` identifies the run's whole content and where its anchor lies in it.
    """
    n, length = len(symbols), spec.length
    block = 1 << (length.bit_length() - 1)
    if n < length:
        return (np.empty(0, np.int64),) * 5
    h = gram_hashes(symbols, spec.gram)
    at = minima(h, spec.width)  # one for each window of the whole, also those across a border
    first, counts = starts[:-1], np.maximum(np.diff(starts) - length + 1, 0)
    document = np.repeat(np.arange(len(first)), counts)
    window = np.arange(counts.sum()) + np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    anchor = at[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1])
    begin = np.flatnonzero(new)
    if not len(begin):
        return (np.empty(0, np.int64),) * 5
    end = np.concatenate((begin[1:], [len(window)])) - 1
    s1, s2, a = window[begin].astype(np.int64), window[end].astype(np.int64), anchor[begin].astype(np.int64)
    whole = gram_hashes(symbols, block)
    last = s2 + length - block
    key = mix(((a - s1) << 32 | (s2 - s1)).astype(np.uint64))
    for i in range(-(-(2 * length - spec.gram) // block)):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + whole[np.minimum(s1 + i * block, last)])
    base = first[document[begin]]
    return document[begin], s1 - base, s2 - base, h[a].view(np.int64), key.view(np.int64)


def _runs(docs: DataFrame, spec: Windows) -> DataFrame:
    """Runs of all documents (``key`` not null), and repeats that one task saw itself (``key`` null)."""

    def cut(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch | None:
        ids = np.array([r[0] for r in rows], np.int64)
        starts = np.concatenate(([0], np.cumsum([len(r[1]) for r in rows])))
        document, start, stop, bucket, key = cut_runs(np.concatenate([r[1] for r in rows]), starts, spec)
        if not len(document):
            return None
        doc = ids[document]
        order = np.lexsort((start, doc, key, bucket))
        doc, start, stop, bucket, key = (x[order] for x in (doc, start, stop, bucket, key))
        new = np.ones(len(doc), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
        same_doc = doc == doc[head]
        same = same_doc & (start == start[head]) & ~new
        repeat = (~same_doc | (~new & ~same)) if spec.own else ~same_doc
        keep = ~same
        stop = np.where(repeat, stop + spec.length, stop)
        bucket = np.where(repeat, mix(doc.view(np.uint64)).view(np.int64), bucket)
        columns = [pa.array(bucket[keep]), pa.array(key[keep], mask=repeat[keep]), pa.array(doc[keep]),
                   pa.array(start[keep].astype(np.int32)), pa.array(stop[keep].astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "key", "doc_id", "start", "stop"])

    def run(batches):
        held, size = [], 0
        for piece in pieces(batches, "text"):
            for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                found = spec.symbols(text or "")
                if len(found) < spec.length:
                    continue
                held.append((doc, found))
                size += found.nbytes if found.itemsize == 1 else len(found) * 6
                if size >= MAP_BYTES:
                    out = cut(held)
                    held, size = [], 0
                    if out is not None:
                        yield out
        if held:
            out = cut(held)
            if out is not None:
                yield out

    return docs.mapInArrow(run, RUNS)


def _match_runs(runs: DataFrame, spec: Windows) -> DataFrame:
    """``bucket, doc_id, start, stop``: repeats (``bucket`` null, stop in symbols), and runs to be compared.

    One pass over each sorted partition; it holds a batch, and the first run of the bucket it is in.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, key, doc and start of its first run, whether its bucket is known to have several
        pending: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            is_run = np.asarray(batch.column("key").is_valid())
            bucket, key = batch.column("bucket").to_numpy(), batch.column("key").fill_null(0).to_numpy(zero_copy_only=False)
            doc, start, stop = batch.column("doc_id").to_numpy(), batch.column("start").to_numpy(), batch.column("stop").to_numpy()
            if not is_run.all():
                yield write(np.full((~is_run).sum(), -1), doc[~is_run], start[~is_run], stop[~is_run], repeats=True)
                bucket, key, doc, start, stop = (x[is_run] for x in (bucket, key, doc, start, stop))
            n = len(bucket)
            if not n:
                continue
            new_bucket = np.ones(n, bool)
            new_bucket[1:] = bucket[1:] != bucket[:-1]
            new_key = new_bucket.copy()
            new_key[1:] |= key[1:] != key[:-1]
            goes_on = last is not None and last[0] == bucket[0]
            if goes_on:
                new_bucket[0] = False
                new_key[0] = last[1] != key[0]
            head = np.maximum.accumulate(np.where(new_key, np.arange(n), -1))
            first_doc = np.where(head >= 0, doc[head], last[2] if goes_on else 0)
            first_start = np.where(head >= 0, start[head], last[3] if goes_on else 0)
            same_doc = doc == first_doc
            repeat = ~same_doc | (start != first_start) if spec.own else ~same_doc
            keep = ~repeat & (new_key | (start != first_start))
            segment = np.cumsum(new_bucket) - (0 if goes_on else 1)
            keys = np.bincount(segment, weights=new_key, minlength=segment[-1] + 1)
            if goes_on:
                keys[0] += 2 if last[4] else 1
            several = keys > 1
            rows = np.stack([bucket, doc, start, stop])
            if goes_on and several[0] and pending:
                yield write(*np.concatenate(pending, axis=1))
            if not (goes_on and segment[-1] == 0 and not several[0]):
                pending = []
            ready = keep & several[segment]
            if ready.any():
                yield write(*rows[:, ready])
            if repeat.any():
                yield write(np.full(repeat.sum(), -1), doc[repeat], start[repeat], stop[repeat] + spec.length, repeats=True)
            if not several[-1]:
                tail = keep & (segment == segment[-1])
                if tail.any():
                    pending.append(rows[:, tail])
            last = (bucket[-1], key[-1], first_doc[-1], first_start[-1], bool(several[-1]))

    def write(bucket, doc, start, stop, repeats=False) -> pa.RecordBatch:
        columns = [pa.array(bucket, mask=np.full(len(bucket), repeats)), pa.array(doc),
                   pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "doc_id", "start", "stop"])

    dealt = runs.repartition("bucket").sortWithinPartitions("bucket", "key", "doc_id", "start")
    return dealt.mapInArrow(run, "bucket bigint, doc_id bigint, start int, stop int")


CONTENTS = "bucket bigint, part int, parts int, doc_id bigint, start int, content binary"


def _with_content(docs: DataFrame, runs: DataFrame, spec: Windows, part_runs: int) -> DataFrame:
    """The runs with their symbols; those of a bucket with very many runs are dealt into parts."""
    sizes = runs.groupBy("bucket").count().filter(F.col("count") > part_runs)
    sizes = stage(sizes.select("bucket", F.ceil(F.col("count") / part_runs).cast("int").alias("parts")), "large-buckets")
    part = F.pmod(F.xxhash64("doc_id", "start"), F.col("parts")).cast("int")
    dealt = runs.join(sizes, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.select(F.col("doc_id").alias("owner"), F.struct("bucket", part.alias("part"), "parts", "start", "stop").alias("run"))
    dealt = dealt.groupBy("owner").agg(F.collect_list("run").alias("runs"))  # as many as a document has, at most
    joined = docs.join(dealt, F.col("doc_id") == F.col("owner")).select("doc_id", "text", "runs")

    def run(batches):
        for piece in pieces(batches, "text", 1 << 20):
            out = []
            for doc, text, runs in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "runs")), strict=True):
                content = spec.content(text or "")
                found = ((r, content(r["start"], r["stop"] + spec.length)) for r in runs)
                out += [(r["bucket"], r["part"], r["parts"], doc, r["start"], c) for r, c in found if c is not None]
            if not out:
                continue
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            names = ["bucket", "part", "parts", "doc_id", "start", "content"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return joined.mapInArrow(run, CONTENTS)


#: From a list of groups of (doc_id, start, content), ordered by id and start, to a boolean array for each content: which
#: of its windows are repeats.
Kernel = Callable[[list[list[tuple[int, int, bytes]]]], list[list[np.ndarray]]]


def _compare(contents: DataFrame, spec: Windows, kernel: Kernel) -> DataFrame:
    """Repeats as ``digest`` null and start, stop in symbols; windows that are first in a part, with their digest."""

    def groups(batches) -> Iterator[tuple[int, list]]:
        key, held = None, []
        for batch in batches:
            for bucket, part, parts, doc, start, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is not None and (bucket, part) != key[:2]:
                    yield key[2], held
                    held = []
                key = (bucket, part, parts)
                held.append((doc, start, content))
        if held:
            yield key[2], held

    def run(batches):
        ready, size = [], 0
        for parts, group in groups(batches):
            ready.append((parts, group))
            size += sum(len(x[2]) for x in group)
            if size >= KERNEL_BYTES:
                yield write(ready)
                ready, size = [], 0
        if ready:
            yield write(ready)

    def write(ready) -> pa.RecordBatch:
        out = []
        for (parts, group), found in zip(ready, kernel([g for _, g in ready]), strict=True):
            for (doc, start, content), repeat in zip(group, found, strict=True):
                edges = np.flatnonzero(np.diff(np.concatenate(([False], repeat, [False])).astype(np.int8))).tolist()
                out += [(None, doc, start + a, start + b - 1 + spec.length) for a, b in zip(edges[::2], edges[1::2], strict=True)]
                if parts > 1:
                    windows = spec.windows(content)
                    for i in np.flatnonzero(~repeat).tolist():
                        digest = hashlib.blake2b(windows(i), digest_size=16).digest()
                        out.append((digest, doc, start + i, start + i + spec.length))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        arrays = [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, ["digest", "doc_id", "start", "stop"])

    dealt = contents.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "doc_id", "start")
    return dealt.mapInArrow(run, "digest binary, " + SPANS)


def repeated_spans(docs: DataFrame, spec: Windows, kernel: Kernel, part_runs: int = PART_RUNS) -> DataFrame:
    """``doc_id, spans``: the symbols of each document that repeated windows cover, as (start, stop), unmerged."""
    docs = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    found = stage(_match_runs(_runs(docs, spec), spec), "window-runs")
    repeats = found.filter("bucket IS NULL").select("doc_id", "start", "stop")
    differing = found.filter("bucket IS NOT NULL")
    compared = stage(_compare(_with_content(docs, differing, spec, part_runs), spec, kernel), "window-repeats")
    repeats = repeats.unionByName(compared.filter("digest IS NULL").select("doc_id", "start", "stop"))

    across = compared.filter("digest IS NOT NULL")
    place = F.struct("doc_id", "start") if spec.own else F.struct("doc_id")
    first = across.groupBy("digest").agg(F.min(place).alias("first"))
    later = across.join(first, "digest").filter(F.col("first") < place).select("doc_id", "start", "stop")
    spans = repeats.unionByName(later).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return spans


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, text, starts, stops`` of every row of ``docs``."""
    spans = spans.select(F.col("doc_id").alias("owner"), F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    joined = docs.select("doc_id", "text").join(spans, F.col("doc_id") == F.col("owner"), "left")
    return joined.select("doc_id", "text", "starts", "stops")


def merged(starts: list[int] | None, stops: list[int] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of covered symbols, of ``size``; spans that touch are one."""
    if not starts:
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = np.asarray(starts)[order], np.minimum(np.maximum.accumulate(np.asarray(stops)[order]), size)
    starts, reach = starts[starts < size], reach[starts < size]
    if not len(starts):
        return []
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    return list(zip(starts[new].tolist(), reach[np.concatenate((new[1:], [len(reach)])) - 1].tolist(), strict=True))
