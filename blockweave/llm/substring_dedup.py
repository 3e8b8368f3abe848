"""Substring dedup by suffix automata of reference shards.

A shard is a bucket of passages that share an anchor (see :mod:`.windows`). Its automaton grows document by document, in
the order of ids: each document is streamed through the automaton of those before it, which yields its matching
statistics, the length of the longest match that ends at each word; where that reaches a window's length, the window
occurs in a document with a smaller id. Automata stay with their shards, which have a bounded size; passages are sent to
them, for an automaton of a whole corpus has no bound that would allow broadcasting it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ..sources.staging import owned, stage
from .common import pieces
from .windows import Windows, merged, repeated_spans, with_spans

LENGTH = 13
GRAM = 4


def words_of(text: str) -> list[bytes]:
    """Maximal runs of anything but ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").split()


def _symbols(text: str) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _content(text: str):
    words = words_of(text)
    return lambda a, b: b" ".join(words[a:b]) if b <= len(words) else None


def word_windows(length: int = LENGTH, gram: int = GRAM) -> Windows:
    def windows(content: bytes):
        words = content.split(b" ")
        return lambda i: b" ".join(words[i: i + length])

    return Windows(length, gram, False, _symbols, _content, windows)


class SuffixAutomaton:
    """Of a set of sequences; each is added symbol by symbol after :meth:`restart`."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0

    def restart(self) -> None:
        self.last = 0

    def extend(self, symbol) -> None:
        if symbol in self.next[self.last]:  # seen here in another sequence
            known = self.next[self.last][symbol]
            self.last = known if self.length[known] == self.length[self.last] + 1 else self._clone(self.last, symbol, known)
            return
        state = self._state(self.length[self.last] + 1, {})
        at = self.last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = state
            at = self.link[at]
        if at < 0:
            self.link[state] = 0
        else:
            known = self.next[at][symbol]
            self.link[state] = known if self.length[known] == self.length[at] + 1 else self._clone(at, symbol, known)
        self.last = state

    def _state(self, length: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, at: int, symbol, known: int) -> int:
        clone = self._state(self.length[at] + 1, dict(self.next[known]))
        self.link[clone] = self.link[known]
        self.link[known] = clone
        while at >= 0 and self.next[at].get(symbol) == known:
            self.next[at][symbol] = clone
            at = self.link[at]
        return clone

    def statistics(self, symbols) -> list[int]:
        """Length of the longest match that ends at each symbol."""
        out, at, long = [], 0, 0
        for symbol in symbols:
            while at and symbol not in self.next[at]:
                at = self.link[at]
                long = self.length[at]
            if symbol in self.next[at]:
                at = self.next[at][symbol]
                long += 1
            out.append(long)
        return out


def repeats(groups: list[list[tuple[int, int, bytes]]], length: int = LENGTH) -> list[list[np.ndarray]]:
    """Which windows of each content occur in a document with a smaller id of its group."""
    out = []
    for group in groups:
        automaton, waiting, found = SuffixAutomaton(), [], []
        for i, (doc, _, content) in enumerate(group):
            if waiting and group[i - 1][0] != doc:
                for passage in waiting:
                    automaton.restart()
                    for word in passage:
                        automaton.extend(word)
                waiting = []
            words = content.split(b" ")
            reach = automaton.statistics(words)[length - 1:] if len(automaton.link) > 1 else [0] * (len(words) - length + 1)
            found.append(np.array(reach) >= length)
            waiting.append(words)
        out.append(found)
    return out


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, starts array<int>, stops array<int>"


@owned()
def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part_runs: int | None = None) -> DataFrame:
    """Each row's words that no window of a document with a smaller id covers, as a digest, and the removed spans.

    Words are runs of anything but ASCII blanks, unchanged; a null text has none. Documents of fewer words than a window
    lose nothing. A null id is neither smaller nor larger than any; rows that repeat a document get its result each; an empty
    table gives no rows. The result is a table of the caller's.
    """
    spec = word_windows(length, gram)
    extra = {} if part_runs is None else {"part_runs": part_runs}
    spans = repeated_spans(docs, spec, lambda groups: repeats(groups, length), **extra)

    def run(batches):
        for piece in pieces(batches, "text"):
            out = []
            for doc, text, starts, stops in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "starts", "stops")), strict=True):
                words = words_of(text or "")
                gone = merged(starts, stops, len(words))
                kept, at = [], 0
                for a, b in gone:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                digest = hashlib.sha256(b" ".join(kept)).hexdigest()
                out.append((doc, len(words), len(words) - len(kept), digest, [g[0] for g in gone], [g[1] for g in gone]))
            types = [pa.int64()] * 3 + [pa.string()] + [pa.list_(pa.int32())] * 2
            names = [c.split()[0] for c in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return stage(with_spans(docs, spans).mapInArrow(run, RESULT), "substring-dedup", keep=True)
