from __future__ import annotations

import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from blockweave.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


def placed(counts, limit):
    """Every piece as (sequence, offset, length), from the placements."""
    placements, sequences = packing.pack_histogram(counts, limit)
    out, ranks = [], defaultdict(list)
    for length, first, base, packs, each, offset in placements:
        for k in range(packs * each):
            ranks[length].append(first + k)
            out.append((base + k // each, offset + k % each * length, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    return sorted(out), sequences


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 40), max_size=12))
def test_histogram_packing_fits(counts):
    out, sequences = placed(counts, 30)
    at = defaultdict(int)
    for sequence, offset, length in out:
        assert offset == at[sequence]
        at[sequence] += length
    assert set(at) == set(range(sequences)) and all(v <= 30 for v in at.values())
    assert sum(v <= 15 for v in at.values()) <= 1  # no two packs that would fit in one


def test_histogram_packing_of_huge_counts_is_short():
    placements, _ = packing.pack_histogram({n: 10**9 + n for n in range(1, 1025)})
    assert len(placements) < 10_000


def test_texts_are_tokenized_like_by_the_library(tokenizer, rows):
    ids_of = packing.TokenIds(FILE)
    texts = [r[1] or "" for r in rows] + ["a  b\n\n c\t", "   ", "x\x1c\x1d y\x85z", "²½ⅷ Ⅷ", " " * 3_000_000 + "x", "a" * 20_000, "<|endoftext|> x", "it's WE'LL 12ab", " x y　", "é \U0001F600"]
    for text in texts:
        assert np.frombuffer(ids_of.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_is_tokenized_alike(tokenizer, text):
    if FILE not in packing._LOADED:
        packing._LOADED[FILE] = packing.TokenIds(FILE)
    assert np.frombuffer(packing._LOADED[FILE].encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_character_is_tokenized_alike(tokenizer):
    """Each BMP character between letters, digits and blanks."""
    ids_of = packing.TokenIds(FILE)
    texts = ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}" for c in range(start, start + 64)) for start in range(0, 0xD800, 64)]
    for text in texts:
        assert np.frombuffer(ids_of.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [1024, 64])
def test_round_trip(edges, rows, tokenizer, limit):
    got = packing.pack(edges, FILE, limit).collect()
    wanted = []
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), limit):
            part = ids[start:start + limit]
            wanted.append((repr(doc), start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    assert sorted((repr(r["doc_id"]), *r[1:5]) for r in got) == sorted(wanted)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(sequences) == set(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert len(sequences) <= 1.1 * sum(r["length"] for r in got) / limit + 2


def test_added_tokens_are_ids_of_the_unaltered_library(spark):
    library = Tokenizer.from_file(FILE)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>  y\n", "<|endoftext |> <|ENDOFTEXT|>", "é<|endoftext|>'s 12"]
    texts += ["<|endoftext|>".join(["word "] * 700)]
    ids_of = packing.TokenIds(FILE, added=True)
    assert np.frombuffer(ids_of.encode(texts[0]), "<u4").tolist() == [64, 220, 50256, 275]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), FILE).collect()
    wanted = []
    for doc, text in enumerate(texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), packing.LIMIT):
            part = ids[start:start + packing.LIMIT]
            wanted.append((doc, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    assert sorted(tuple(r)[:5] for r in got) == wanted


def test_empty_table(nothing):
    assert packing.pack(nothing, FILE).count() == 0


def test_ranks_of_one_hot_length(spark):
    rows = [(i, 0, 7 if i % 3 else i % 50 + 1, i * 31, 9) for i in range(2000)] + [(None, 0, 7, 1, 9)] * 5
    df = spark.createDataFrame(rows, packing.PIECE_SCHEMA)
    ranks = defaultdict(list)
    for r in packing.ranked(df, 16).collect():
        ranks[r["length"]].append(r["rank"])
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())


@pytest.mark.parametrize("text", [" " * 99_999 + "x", " " * 100_000, "a" + "\n" * 1_200_000 + "b", "é" * 300_000, "!" * 300_000, "7" * 300_000, "\t \n" * 40_000])
def test_long_runs_have_the_library_s_ids(text):
    ids = packing.TokenIds(FILE, added=True)
    assert ids.encode(text) == array("I", Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids).tobytes()
