"""Suffix-array dedup by bucket-pointer refinement.

Suffixes are sorted as deep as a window is long. Their first buckets hold equal q-grams; a bucket is refined by sorting
its suffixes on the bucket that each one's suffix at a later offset is in, and every refinement serves the next, which so
reaches twice as deep. A suffix alone in its bucket is sorted and takes no further part. The suffixes that share a bucket
at full depth are the occurrences of one string. Which suffixes are sorted together, see :mod:`.windows`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.staging import owned, stage
from .common import pieces
from .windows import Windows, merged, repeated_spans, with_spans

LENGTH = 100
#: Bytes of an anchor, and of the first buckets.
GRAM = 32
FIRST = 8


def _octets(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _content(text: str):
    octets = text.encode("utf-8", "surrogatepass")
    return lambda a, b: octets[a:b] if b <= len(octets) else None


def byte_windows(length: int = LENGTH, gram: int = GRAM) -> Windows:
    return Windows(length, gram, True, _octets, _content, lambda content: lambda i: content[i: i + length])


def refine(octets: np.ndarray, positions: np.ndarray, depth: int, first: int = FIRST) -> np.ndarray:
    """Bucket of each of ``positions`` after sorting their suffixes ``depth`` bytes deep (all lie within the text).

    Buckets are ranks: a suffix's bucket pointer is the number of suffixes in buckets up to its own, so refining a
    bucket leaves those of others as they are.
    """
    n = len(octets) - first + 1
    grams = np.zeros(n, np.uint64)
    for i in range(first):  # big-endian, so numbers are in the order of the bytes
        grams = (grams << np.uint64(8)) | octets[i: i + n]
    order = np.argsort(grams, kind="stable")
    pointer = np.empty(n, np.int64)
    pointer[order] = _last_of_equal(grams[order])
    reach, active = first, np.flatnonzero(_crowded(pointer))
    while reach < depth and len(active):
        step = min(reach, depth - reach)
        # Those at the very end have no later offset; they are shorter than ``depth`` and not asked for.
        active = active[active + step < n]
        keys = pointer[active] << np.int64(32) | pointer[active + step]
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        group = sorted_keys >> np.int64(32)
        last = _last_of_equal(sorted_keys)
        # The refined bucket ends where it ends within the old one, whose end the old pointer was.
        refined = group - (_last_of_equal(group) - last)
        fresh = np.empty(len(active), np.int64)
        fresh[order] = refined
        pointer[active] = fresh
        sizes = np.unique(fresh, return_inverse=True, return_counts=True)
        active = active[sizes[2][sizes[1]] > 1]
        reach += step
    return pointer[positions]


def _last_of_equal(values: np.ndarray) -> np.ndarray:
    """For each of sorted values, the index of the last that equals it."""
    ends = np.flatnonzero(np.concatenate((values[1:] != values[:-1], [True])))
    return np.repeat(ends, np.diff(np.concatenate(([-1], ends))))


def _crowded(pointer: np.ndarray) -> np.ndarray:
    return np.bincount(pointer)[pointer] > 1


def repeats(groups: list[list[tuple[int, int, bytes]]], length: int = LENGTH) -> list[list[np.ndarray]]:
    """Which windows of each content occur earlier, by document and start, in any of the contents."""
    rows = [row for group in groups for row in group]
    sizes = np.array([len(r[2]) for r in rows])
    octets = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
    begins = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(rows)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    bucket = refine(octets, begins[row] + nth, length)
    doc = np.array([r[0] for r in rows], np.int64)[row]
    start = np.array([r[1] for r in rows], np.int64)[row] + nth
    order = np.lexsort((start, doc, bucket))
    b, d, s = bucket[order], doc[order], start[order]
    head = np.maximum.accumulate(np.where(np.concatenate(([True], b[1:] != b[:-1])), np.arange(len(b)), 0))
    later = np.empty(len(b), bool)
    later[order] = (d != d[head]) | (s != s[head])
    split = iter(np.split(later, np.cumsum(counts)[:-1]))
    return [[next(split) for _ in group] for group in groups]


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<int>, stops array<int>"


@owned()
def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part_runs: int | None = None) -> DataFrame:
    """Each row's bytes that no earlier ``length``-byte string covers, as a digest, and the removed spans.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller id, or
    further up in its own. Texts shorter than that, empty and null ones lose nothing; a null id is neither smaller nor
    larger; rows that repeat a document get its result each; an empty table gives no rows. The result is a table of the caller's.
    """
    spec = byte_windows(length, gram)
    extra = {} if part_runs is None else {"part_runs": part_runs}
    spans = repeated_spans(docs, spec, lambda groups: repeats(groups, length), **extra)

    def run(batches):
        for piece in pieces(batches, "text"):
            out = []
            for doc, text, starts, stops in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "starts", "stops")), strict=True):
                octets = (text or "").encode("utf-8", "surrogatepass")
                gone = merged(starts, stops, len(octets))
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(octets[at:a])
                    at = b
                kept.update(octets[at:])
                out.append((doc, len(octets), sum(b - a for a, b in gone), len(gone), kept.hexdigest(), [g[0] for g in gone], [g[1] for g in gone]))
            types = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int32())] * 2
            names = [c.split()[0] for c in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return stage(with_spans(docs, spans).mapInArrow(run, RESULT), "suffix-dedup", keep=True)
