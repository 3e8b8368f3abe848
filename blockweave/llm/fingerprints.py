"""Document fingerprints by winnowing, and the order of documents they are compared in.

Rolling hashes of all k-grams of code points; from every window of ``width`` hashes the least is kept, the rightmost of
equal ones, with its position. Two texts that share ``gram + width - 1`` code points share a fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Powers of two, so that both hash and minimum double their reach step by step.
GRAM = 16
WIDTH = 32
#: Text of a run, at most about; smaller where the session asks for more shuffle partitions, down to a megabyte.
RUN_BYTES = 256 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _STEP
    return h ^ (h >> np.uint64(29))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` symbols from each position on; ``gram`` is a power of two."""
    h = mix(symbols.astype(np.uint64) + _MIX)
    reach = 1
    while reach < gram:
        h = h[:-reach] * _MIX + h[reach:]
        h = mix(h)
        reach *= 2
    return h


def rightmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least hash of each window, rightmost of equal ones, ascending without repeats."""
    value, at = h, np.arange(len(h), dtype=np.int32)
    reach = 1
    while reach < width:
        later = value[reach:] <= value[:-reach]
        value = np.where(later, value[reach:], value[:-reach])
        at = np.where(later, at[reach:], at[:-reach])
        reach *= 2
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def winnow(symbols: np.ndarray, gram: int = GRAM, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a text's fingerprint.

    A text of fewer k-grams than a window is one window; one shorter than a k-gram is hashed whole; an empty one has no
    fingerprint.
    """
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    if n < gram:
        whole = hashlib.blake2b(symbols.tobytes(), digest_size=8).digest()
        return np.frombuffer(whole, np.uint64), np.zeros(1, np.int32)
    h = gram_hashes(symbols, gram)
    if len(h) < width:
        at = np.array([len(h) - 1 - np.argmin(h[::-1])], np.int32)
    else:
        at = rightmost_minima(h, width)
    return h[at], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints' hashes; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def shown(hashes: np.ndarray) -> str:
    """Twelve hexadecimal digits a hash, in the order of the text."""
    return np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes().hex()


def in_runs(docs: DataFrame, runs: int) -> DataFrame:
    """``doc_id, text, run, extra``: documents cut by ascending id into runs, one a partition, sorted.

    The first document of each following run also ends the run before it (``extra``), so each run knows the successor of
    its last one. Boundaries come from Spark's quantile sketch of ids. One id per run reaches the driver and is broadcast;
    that is 16 bytes for each ``run_bytes`` of text.
    """
    spark = docs.sparkSession
    bounds = docs.approxQuantile("doc_id", [i / runs for i in range(1, runs)], 1 / (4 * runs)) if runs > 1 else []
    cuts = np.unique(np.array(bounds, np.int64))

    @F.pandas_udf("int")
    def run_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            known = ids.notna()
            run = np.zeros(len(ids), np.int32)  # ids that are null come first of all
            run[known] = np.searchsorted(cuts, ids[known].astype(np.int64).to_numpy(), side="right")
            yield pd.Series(run)

    ids = docs.groupBy(run_of(F.col("doc_id")).alias("run"))
    heads = ids.agg(F.min_by("doc_id", F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("head")).orderBy("run").collect()
    # The document after run r is the first of the next run that has any; the last run is followed by the first of all.
    targets = [(r["head"], heads[i - 1]["run"]) for i, r in enumerate(heads)]
    targets = spark.createDataFrame(targets, "head bigint, before int")
    placed = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    placed = placed.withColumn("run", run_of(F.col("doc_id")))
    placed = placed.join(F.broadcast(targets), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    twice = F.array(
        F.struct(F.col("run"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("run"), F.lit(True).alias("extra"))
    )
    rows = placed.select("doc_id", "text", F.explode(F.filter(twice, lambda x: x["run"].isNotNull())).alias("x"))
    rows = rows.select("doc_id", "text", "x.run", "x.extra")
    dealt = rows.repartitionById(len(cuts) + 1, F.col("run"))
    return dealt.sortWithinPartitions("run", "extra", F.col("doc_id").asc_nulls_first(), "text")


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, positions array<int>, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def fingerprint_edits(docs: DataFrame, run_bytes: int = RUN_BYTES, gram: int = GRAM, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text and of its edited text, and the likeness to it and to the next document's.

    Edited: the last floor(n/4) code points replaced by the first as many (or all) of the next document by ascending
    ``doc_id``; the first follows the last. Null texts are empty; null ids come first; rows of one id follow each other
    by text; a single document is its own successor; an empty table gives no rows. A task streams a run of documents
    and holds two texts.
    """
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    asked = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = in_runs(docs, max(1, -(-total // run_bytes), min(asked, total >> 20)))

    def pairs(batches) -> Iterator[tuple]:
        held = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text", "run", "extra")]
            for doc_id, text, run, extra in zip(*columns, strict=True):
                if held is not None and held[2] == run and not held[3]:
                    yield held[0], held[1], text
                held = (doc_id, text, run, extra)

    def write(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches):
        out, held, ready = [], 0, (None, None)
        for doc_id, text, follower in pairs(batches):
            hashes, at = ready[1] if ready[0] == text else winnow(code_points(text), gram, width)
            following, next_at = winnow(code_points(follower), gram, width)
            n = len(text)
            cut = n // 4
            edited = text[: n - cut] + follower[:cut]
            edited_hashes, _ = winnow(code_points(edited), gram, width)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, n, digest, shown(hashes), at, shown(edited_hashes), likeness(hashes, edited_hashes), likeness(hashes, following)))
            ready = (follower, (following, next_at))
            held += n
            if held > 4 << 20:
                yield write(out)
                out, held = [], 0
        if out:
            yield write(out)

    return rows.mapInArrow(run, SCHEMA)
