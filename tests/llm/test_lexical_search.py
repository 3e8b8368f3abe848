from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from blockweave.llm import lexical_search as ls
from blockweave.llm.hard_negatives import Best

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return PATTERN.findall((text or "").translate(UPPER))


def brute(docs, items, k=20) -> list[tuple]:
    tokens = [(i, words(t)) for i, t in docs]
    n, total = sum(1 for _, w in tokens if w), sum(len(w) for _, w in tokens)
    df = Counter(t for _, w in tokens for t in set(w))
    texts = {}
    for i, t in items:
        if t is not None:
            texts[i] = min(texts.get(i, t), t)
    out = []
    for item, text in texts.items():
        asked = Counter(words(text))
        scored = []
        for doc, w in tokens:
            tf = Counter(w)
            m = 75 + 25 * len(w) * n // max(total, 1)
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m)) for t, c in asked.items() if tf[t])
            if s > 0:
                scored.append((-s, math.inf if doc is None else doc))
        out += [(item, r + 1, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.collect()]


def test_edge_rows(edges, items):
    assert found(ls.rank(edges, items)) == brute(pairs(edges, "doc_id"), pairs(items, "item_id"))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(300)], k=rng.randrange(1, 60))) for _ in range(500)]
    texts += [texts[3]] * 80 + [texts[4] + " T7 été", None, "", "-- !!"]
    asked = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(25)] + [(90, texts[3]), (91, "Été"), (92, "nowhere"), (None, texts[4]), (93, None), (94, "..")]
    return list(enumerate(texts)), asked


def frames(spark, corpus, parts=4):
    docs, asked = corpus
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts), spark.createDataFrame(asked, "item_id bigint, text string")


def test_equals_brute_force_with_ties(spark, corpus):
    got = found(ls.rank(*frames(spark, corpus)))
    assert got == brute(*corpus)
    ties = [r[2] for r in sorted((r for r in got if r[0] == 90), key=lambda r: r[1])]
    assert ties[:20] == sorted(ties[:20]), "copies by ascending id"


def test_small_trees_blocks_and_subspaces(spark, corpus, monkeypatch):
    for name, value in {"TREE_DOCS": 64, "TREE_TERMS": 500, "LEAF": 3, "SPACES": 16, "BLOCK_TERMS": 40}.items():
        monkeypatch.setattr(ls, name, value)
    assert found(ls.rank(*frames(spark, corpus))) == brute(*corpus)


def test_string_ids_and_nothing(spark, corpus):
    docs, asked = frames(spark, corpus)
    named = asked.selectExpr("concat('i', item_id) AS item_id", "text")
    assert {r[0] for r in found(ls.rank(docs, named))} >= {"i0", "i90"}
    assert ls.rank(docs.limit(0), asked).count() == 0 and ls.rank(docs, asked.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    topics, rows = rng.integers(0, 400, (20, 30)), []
    for i in range(1500):
        rows.append(np.unique(rng.choice(topics[i % 20], 12)))
    start = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    docs = ls.Rows(start, np.concatenate(rows), rng.integers(1, 10**6, start[-1]))
    own = [np.unique(rng.choice(t, 8)) for t in topics]
    repeats = ls.Rows(np.concatenate(([0], np.cumsum([len(o) for o in own]))), np.concatenate(own), np.ones(sum(map(len, own)), np.int64))
    items = ls.Items(repeats, rng.integers(1, 9000, 400))
    tree = ls.BallTree(docs, items)
    dense = np.zeros((1500, 400))
    dense[np.repeat(np.arange(1500), np.diff(start)), docs.at] = docs.value
    asked = np.zeros((20, 400))
    asked[np.repeat(np.arange(20), np.diff(repeats.start)), repeats.at] = items.exact.value
    true = dense @ asked.T
    for members, bound in zip(tree.members, tree.bound, strict=True):
        assert (true[members].max(axis=0) <= bound).all()
    best = Best(20, 20)
    tree.search(items, best, np.arange(1500))
    leaves = sum(1 for c in tree.children if not c)
    assert tree.visited < 0.5 * leaves * 20, "most subtrees are pruned"
    group, score, _ = best.settle()
    for i in range(20):
        assert score[group == i].tolist() == sorted(true[:, i].tolist(), reverse=True)[:20]
