"""Packing by shortest-pack-first over the length histogram.

Documents become token ids, cut into full sequences and one rest each. The histogram of rest lengths, at most
``limit - 1`` numbers, is packed on the driver: longest lengths first, each into the packs with most room, whole groups
of equal packs at a time. What comes out are placements: so many sequences from this number on get so many pieces of this
length at this offset. Pieces find theirs by their rank among those of equal length.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..sources.staging import stage
from .common import pieces as bounded

LIMIT = 1024
#: A length's pieces are ranked in so many parts, so that one length may hold a third of all pieces.
RANK_PARTS = 256
#: Fixed value: how byte-level BPE parts a text before it merges; no merge crosses these borders.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blanks in a row with which a text goes to the library: the faster implementation gives up on about a million.
LONG_BLANKS = 100_000
_BLANKS = re.compile(r"\s+")
PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it shows, else one from 256 on."""
    shown = [b for b in range(256) if b in range(33, 127) or b in range(161, 173) or b in range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def long_blanks(text: str, least: int = LONG_BLANKS) -> bool:
    """Whether ``text`` has a run of so many blanks."""
    return len(text) >= least and any(m.end() - m.start() >= least for m in _BLANKS.finditer(text))


class TokenIds:
    """Little-endian ids of a text by the vocabulary of a byte-level BPE file.

    Its ids are in the order of its merges, so they serve as ranks for a faster implementation of the same merges; the
    library whose file it is takes texts with blanks that one would give up on. With ``added``, the library also takes each text that holds
    an added token of the file, which it cuts out as that token's id; without, special tokens are ordinary text.
    """

    def __init__(self, tokenizer_file: str, added: bool = False):
        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        self._tokenizer.encode_special_tokens = not added
        special = self._tokenizer.get_added_tokens_decoder()
        self._added = [t.content for t in special.values()] if added else []
        value = byte_values()
        ranks = {bytes(value[c] for c in t): i for t, i in self._tokenizer.get_vocab().items() if i not in special}
        self._fast = tiktoken.Encoding("vocabulary", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self._added) or long_blanks(text):
            return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self._fast.encode_ordinary(text)).tobytes()


#: By file alone, or by file and ``added``.
_LOADED: dict[str | tuple[str, bool], TokenIds] = {}


def token_pieces(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT) -> DataFrame:
    """The pieces of each row's ids (added tokens as the library has them) and a final 0: full ones, then the rest."""

    def run(batches):
        key = (tokenizer_file, True)
        if key not in _LOADED:
            _LOADED[key] = TokenIds(tokenizer_file, added=True)
        for batch in bounded(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = _LOADED[key].encode(text or "") + bytes(4)
                n = len(ids) // 4
                for start in range(0, n, limit):
                    part = ids[4 * start: 4 * (start + limit)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
            names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA)


def pack_histogram(counts: dict[int, int], limit: int = LIMIT) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Placements ``(length, first_rank, base, packs, each, offset)``, and the number of sequences.

    ``packs`` sequences from ``base`` on take ``each`` pieces of ``length`` at ``offset``. A pack is opened only when
    none has room; of equal lengths an opened pack takes as many as fit, as it is then the shortest.
    """
    placements, opened, sequences = [], [], 0  # opened: heap of (-room, base, packs)
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            if opened and -opened[0][0] >= length:
                room, base, packs = heapq.heappop(opened)
                taken = min(packs, left)
                placements.append((length, rank, base, taken, 1, limit + room))
                if -room > length:
                    heapq.heappush(opened, (room + length, base, taken))
                if packs > taken:
                    heapq.heappush(opened, (room, base + taken, packs - taken))
                left, rank = left - taken, rank + taken
                continue
            each = min(limit // length, left)
            packs = left // each
            placements.append((length, rank, sequences, packs, each, 0))
            if limit > each * length:
                heapq.heappush(opened, (each * length - limit, sequences, packs))
            sequences, left, rank = sequences + packs, left - packs * each, rank + packs * each
    return placements, sequences


def ranked(pieces: DataFrame, parts: int = RANK_PARTS) -> DataFrame:
    """``pieces`` with ``rank``, gapless from 0 among those of equal length."""
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int")
    dealt = pieces.withColumn("part", part)
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    dealt = dealt.withColumn("nth", F.row_number().over(within) - 1)
    return dealt.join(counts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("part", "before", "nth")


def pack(docs: DataFrame, tokenizer_file: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of each piece.

    A null or empty text is its final id alone. Repeated rows are packed one by one; a null id is kept; an empty table
    gives no rows.
    """
    pieces = stage(token_pieces(docs, tokenizer_file, limit), "token-pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``limit`` rows
    placements, _ = pack_histogram(counts, limit)
    table = docs.sparkSession.createDataFrame(
        placements, "length bigint, first bigint, base bigint, packs bigint, each bigint, at bigint"
    ).withColumnRenamed("length", "of_length")
    mine = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("first")) & (
        F.col("rank") < F.col("first") + F.col("packs") * F.col("each")
    )
    # Placements depend on the histogram alone, not on how many documents there are.
    placed = ranked(pieces).join(F.broadcast(table), mine).withColumn("k", F.col("rank") - F.col("first"))
    sequence = F.col("base") + F.floor(F.col("k") / F.col("each")).cast("bigint")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"),
        (F.col("at") + F.pmod("k", "each") * F.col("length")).alias("offset"),
    )
