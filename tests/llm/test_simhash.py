from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

from blockweave.llm import simhash
from blockweave.llm.components import connected_components
from blockweave.sources.staging import shared_root


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def flipped(rng, base, bits):
    for b in rng.sample(range(64), bits):
        base ^= 1 << b
    return base


def clustered(seed, size=400):
    """Fingerprints in clusters and chains, some far apart."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(size // 8)]
    while len(out) < size:
        out.append(flipped(rng, rng.choice(out), rng.choice((1, 2, 3, 3, 4, 5))))
    return np.unique(np.array(out, np.uint64))


def test_fingerprints(edges, rows):
    got = sorted((repr(r["doc_id"]), r["fp"] % 2**64) for r in simhash.fingerprints(edges).collect())
    assert got == sorted((repr(r[0]), brute_fingerprint(r[1])) for r in rows)


@pytest.mark.parametrize("node", [4, 50, 1000])
def test_tree_in_memory(node):
    for seed in range(4):
        points = clustered(seed)
        least = simhash.linked(points, node=node)
        known = brute_components(range(len(points)), lambda a, b: (int(points[a]) ^ int(points[b])).bit_count() <= 3)
        assert least.tolist() == [known[i] for i in range(len(points))]


def test_the_tree_parts_prunes_and_visits_borders():
    """On fingerprints as documents have them the tree does the search: it compares a small part of all pairs."""
    points = np.unique(np.random.default_rng(1).integers(0, 2**64, 4000, np.uint64))
    points = np.unique(np.concatenate([points, points[:200] ^ np.uint64(1 << 40), points[:200] ^ np.uint64(5 << 9)]))
    seen = Counter()
    least = simhash.linked(points, seen=seen)
    assert seen["parted"] > 400 and seen["kept_out"] > len(points) and seen["border"] > len(points)
    assert seen["compared"] < 0.4 * len(points) ** 2
    true = np.bitwise_count(points[:, None] ^ points) <= 3
    for i in range(len(points)):
        assert (least[np.flatnonzero(true[i])] == least[i]).all()
    assert len(np.unique(least)) == len(points) - 400


def test_many_links_are_reduced_as_they_come(monkeypatch):
    monkeypatch.setattr(simhash, "HELD_LINKS", 50)
    points = clustered(3, 300)
    known = brute_components(range(len(points)), lambda a, b: (int(points[a]) ^ int(points[b])).bit_count() <= 3)
    assert simhash.linked(points).tolist() == [known[i] for i in range(len(points))]


def test_a_crowded_prefix_is_parted_further(spark):
    """A third of all points share half of their bits."""
    rng = random.Random(4)
    points = [rng.getrandbits(64) for _ in range(200)] + [0xABCD1234ABCD0000 + rng.getrandbits(16) for _ in range(120)]
    points = np.unique(np.array(points, np.uint64)).view(np.int64)
    df = spark.createDataFrame([(int(p),) for p in points], "fp bigint")
    shards = simhash.shard_points(df, shard_points=30)
    got = {r["node"]: r["component"] for r in connected_components(simhash.link_shards(shards)).collect()}
    known = brute_components(points.tolist(), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {n: got.get(n, n) for n in points.tolist()} == known


def test_nothing_staged_is_left_but_the_result(spark, edges):
    root = Path(shared_root(spark).removeprefix("file:"))
    before = set(root.iterdir())
    simhash.near_duplicates(edges, points=6)
    assert [p.name.rpartition("-")[0] for p in set(root.iterdir()) - before] == ["simhash-components"]


@pytest.mark.parametrize("shard", [5, 8192])
def test_shards_lose_no_link(spark, shard):
    points = clustered(9, 250)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint")
    links = simhash.link_shards(simhash.shard_points(df, shard_points=shard))
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    signed = points.view(np.int64).tolist()
    known = brute_components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {n: got.get(n, n) for n in signed} == known


def test_near_duplicates(edges, rows):
    got = simhash.near_duplicates(edges, points=6).collect()
    prints = {(r[0], r[1]): brute_fingerprint(r[1]) for r in rows}
    known = brute_components(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    ids = {}
    for (doc, _), fp in prints.items():
        if doc is not None:
            ids[known[fp]] = min(doc, ids.get(known[fp], doc))
    wanted = sorted((repr(r[0]), prints[r[:2]], repr(ids.get(known[prints[r[:2]]]))) for r in rows)
    assert sorted((repr(r["doc_id"]), r["fp"] % 2**64, repr(r["component_id"])) for r in got) == wanted


def test_one_of_each_stays(edges):
    kept = simhash.keep_one_each(edges)
    found = simhash.near_duplicates(edges)
    assert kept.columns == edges.columns
    got = [r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()]
    assert sorted(got) == sorted({r["component_id"] for r in found.filter("doc_id IS NOT NULL").collect()})


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.keep_one_each(nothing).count() == 0


@pytest.mark.parametrize("edges_of", ["chain", "star", "random", "none"])
def test_components(spark, edges_of):
    rng = random.Random(2)
    pairs = {
        "chain": [(i, i + 1) for i in range(60)], "star": [(9, i) for i in range(40)], "none": [(3, 3)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
    }[edges_of]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    linked = set(pairs) | {(b, a) for a, b in pairs}
    assert got == brute_components(nodes, lambda a, b: (a, b) in linked)
