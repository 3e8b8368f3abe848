"""Byte and word windows that occur earlier, against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockweave.llm import substring_dedup, suffix_dedup, windows

FEW = (None, 3)


def documents(rows):
    """Distinct (id, text) in the order of ids; those without an id come last."""
    return sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def expected_bytes(rows, length):
    seen, out = {}, {}
    for doc, text in documents(rows):
        octets = text.encode()
        gone = np.zeros(len(octets), bool)
        for i in range(len(octets) - length + 1 if doc is not None else 0):
            window = octets[i:i + length]
            if window in seen:
                gone[i:i + length] = True
            else:
                seen[window] = doc
        kept = bytes(np.frombuffer(octets, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone))) == 1).sum())
        out[doc, text] = (len(octets), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def expected_words(rows, length):
    seen, out = {}, {}
    for doc, text in documents(rows):
        words = text.encode().split()
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - length + 1 if doc is not None else 0):
            window = tuple(words[i:i + length])
            if seen.setdefault(window, doc) != doc:
                gone[i:i + length] = True
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc, text] = (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("part_runs", FEW)
@pytest.mark.parametrize(("module", "expected", "length", "gram", "columns"), [
    (suffix_dedup, expected_bytes, 100, 32, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    (suffix_dedup, expected_bytes, 24, 8, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    (substring_dedup, expected_words, 13, 4, ["n_words", "n_removed", "kept_sha256"]),
    (substring_dedup, expected_words, 5, 2, ["n_words", "n_removed", "kept_sha256"]),
])
def test_matches_brute_force(edges, rows, module, expected, length, gram, columns, part_runs):
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, tuple(r[c] for c in columns)) for r in
                 module.remove_repeats(edges, length, gram, part_runs).collect())
    known = expected(rows, length)
    wanted = sorted((r[0] is not None, r[0] or 0, known[r[0], r[1] or ""]) for r in rows)
    assert got == wanted


@pytest.mark.parametrize("module", [suffix_dedup, substring_dedup])
def test_empty_table(nothing, module):
    assert module.remove_repeats(nothing).count() == 0


def test_spans_rebuild_the_kept_text(edges):
    for r in suffix_dedup.remove_repeats(edges).join(edges.select("doc_id", "text").distinct(), "doc_id").collect():
        octets, at, kept = (r["text"] or "").encode(), 0, b""
        for a, b in zip(r["starts"], r["stops"], strict=True):
            assert at <= a < b
            kept, at = kept + octets[at:a], b
        assert hashlib.sha256(kept + octets[at:]).hexdigest() == r["kept_sha256"]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=20, max_size=120).map(lambda b: bytes(x % 3 for x in b)), st.integers(8, 20))
def test_refined_buckets_are_equal_strings(octets, depth):
    at = np.arange(len(octets) - depth + 1)
    bucket = suffix_dedup.refine(np.frombuffer(octets, np.uint8), at, depth)
    strings = [octets[i:i + depth] for i in at]
    assert len({(b, s) for b, s in zip(bucket, strings, strict=True)}) == len(set(strings)) == len(set(bucket.tolist()))
    assert [s for _, s in sorted(zip(bucket, strings, strict=True))] == sorted(strings)  # buckets are in suffix order


def test_matching_statistics():
    rng = random.Random(1)
    for _ in range(50):
        known = [[rng.choice("ab") for _ in range(rng.randrange(1, 30))] for _ in range(4)]
        automaton = substring_dedup.SuffixAutomaton()
        for sequence in known:
            automaton.restart()
            for x in sequence:
                automaton.extend(x)
        text = [rng.choice("abc") for _ in range(40)]
        joined = ["".join(s) for s in known]
        for j, long in enumerate(automaton.statistics(text)):
            best = max(n for n in range(j + 2) if any("".join(text[j + 1 - n:j + 1]) in s for s in joined))
            assert long == best


def test_runs_partition_the_windows_of_each_document():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 3, n).astype(np.uint8) for n in (0, 23, 24, 25, 400, 90)]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    spec = suffix_dedup.byte_windows(24, 8)
    document, start, stop, bucket, key = windows.cut_runs(np.concatenate(texts), starts, spec)
    for i, t in enumerate(texts):
        covered = [w for d, a, b in zip(document, start, stop, strict=True) if d == i for w in range(a, b + 1)]
        assert covered == list(range(max(0, len(t) - 23)))


def test_merged_spans():
    assert windows.merged(None, None, 9) == []
    assert windows.merged([5, 0, 2, 20], [9, 3, 5, 30], 30) == [(0, 9), (20, 30)]


def test_one_id_with_two_texts_does_not_fail(spark):
    rows = [(1, "a b c d e f g " * 30), (1, "a b c d e f g " * 9), (2, "x " + "a b c d e f g " * 30), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for module in (suffix_dedup, substring_dedup):
        assert module.remove_repeats(docs).count() == 4
