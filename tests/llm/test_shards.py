from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.llm import shards


def check(got, rows, count, tolerance):
    text = lambda t: (t or "").encode()
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(
        (repr(i), len(text(t)) + 1, zlib.crc32(text(t))) for i, t in rows
    )
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert set(slots) <= set(range(count))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    fair = sum(sizes.values()) / count
    assert max(abs(sizes[s] - fair) for s in range(count)) <= tolerance
    return sizes


@pytest.mark.parametrize("count", [1, 3, 16])
def test_edge_rows(edges, rows, count):
    largest = max(len((r[1] or "").encode()) + 1 for r in rows)
    check(shards.shard_by_bytes(edges, count).collect(), [r[:2] for r in rows], count, 2 * largest)


def test_hot_key_is_subdivided(spark):
    """A third of all bytes are one text: shards stay even, and other groups of equal texts stay whole."""
    rows = [(i, "copy of one text" if i % 3 == 0 else f"text {i // 6} " + "x" * (i % 50)) for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = shards.shard_by_bytes(docs, 16).collect()
    total = sum(r["size"] for r in got)
    check(got, rows, 16, 0.01 * total / 16)
    hot = [r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"copy of one text")]
    assert len(set(hot)) >= 4
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for crc, s in where.items() if crc != zlib.crc32(b"copy of one text"))


def test_groups_beside_a_hot_key_stay_whole(spark):
    """A third of all bytes are one text, all others come in pairs: those in the hot key's range are not torn."""
    hot_text = "one text" + "y" * 37  # some 20 pairs have keys between it and the next splitter
    rows = [(i, hot_text if i % 3 == 0 else f"{i // 3:05d}" + "y" * 40) for i in range(60_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = shards.shard_by_bytes(docs, 16).collect()
    check(got, rows, 16, 0.01 * sum(r["size"] for r in got) / 16)
    text, where = dict(rows), defaultdict(set)
    for r in got:
        where[text[r["doc_id"]]].add(r["shard"])
    assert len(where.pop(hot_text)) >= 4
    assert len(where) == 20_000 and all(len(s) == 1 for s in where.values())


def test_inner_splitters(spark):
    """Heavy keys get a range of their own, light ones share ranges of about a fair size."""
    rows = [(k, 1) for k in range(1000)] + [(500, 300)] * 2 + [(700, 450)]
    bounds = shards.inner_splitters(spark.createDataFrame(rows, "key bigint, size bigint"), 4000, 20)
    assert {500, 501, 700, 701} <= set(bounds.tolist()) and 4 <= len(bounds) <= 12
    assert shards.inner_splitters(spark.createDataFrame([(2**63 - 1, 10)], "key bigint, size bigint"), 40, 20).tolist() == [2**63 - 1]


def test_empty_table(nothing):
    got = shards.shard_by_bytes(nothing, 16)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and got.count() == 0


def test_sample_is_weighted_by_size(spark):
    rows = spark.range(20_000).select(F.col("id").alias("rid"), F.col("id").alias("key"), F.when(F.col("id") < 2_000, 91).otherwise(1).alias("size"))
    keys = shards.sample_keys(rows, 200_000, 1_000)
    assert 900 < len(keys) < 1_100 and 0.87 < np.mean(keys < 2_000) < 0.95
    assert shards.splitters(np.array([5, 5, 5, 5]), 4).tolist() == [5]
