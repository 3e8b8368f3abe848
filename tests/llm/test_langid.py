from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.llm import langid

SYLLABLES = {"aa": "ka lo mi tu ra ne", "bb": "sch ung keit ver zu ein", "cc": "eau oux ille ment ré on", "dd": "при вет да ны ко лы"}


def text(rng, lang, words):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(8)
    return [(i, text(rng, lang, rng.randrange(1, 80)), lang) for i, lang in enumerate(random.Random(1).choices(list(SYLLABLES), k=400))]


@pytest.fixture(scope="module")
def model(spark, labelled):
    return langid.fit(spark.createDataFrame([r + ("x",) for r in labelled], "doc_id bigint, text string, lang string, counts string"))


def test_held_out_accuracy(spark, model):
    rng = random.Random(99)
    fresh = [(i, text(rng, lang, 12), lang) for i, lang in enumerate(list(SYLLABLES) * 50)]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(fresh, "doc_id bigint, text string, lang string"), model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in fresh) >= 196
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(r["rejected"] for r in got.values()) <= 2


def test_rejects_what_no_language_is_near_to(spark, model):
    rows = [(1, "xq zq wq qx " * 40), (2, "12 34 !!"), (3, ""), (4, None), (5, "漢字" * 50)]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert all(r["rejected"] for r in got.values())
    assert [got[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and [got[i]["score"] for i in (2, 3, 4)] == [0.0] * 3


def test_edge_rows(edges, rows, model):
    got = langid.predict(edges, model).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r[0]) for r in rows)
    letters = {(r[0], r[1]): any(c.isalpha() for c in r[1] or "") for r in rows}
    assert sum(r["lang_pred"] == "und" for r in got) == sum(not letters[r[:2]] for r in rows)
    kept = langid.keep_accepted(edges, model)
    assert kept.dtypes == edges.dtypes and kept.count() == sum(not r["rejected"] for r in got)


def test_empty_tables_and_no_labels(edges, nothing, model):
    assert langid.predict(nothing, model).count() == 0
    none = langid.fit(nothing)
    assert none.languages == [] and {r["lang_pred"] for r in langid.predict(edges, none).collect()} == {"und"}
    with_letter = sum(any(c.isalpha() for c in r["text"] or "") for r in edges.collect())
    assert langid.keep_accepted(edges, none).count() == with_letter > 0


def test_equals_a_plain_tf_idf_and_cosines(spark, labelled, model):
    """Weights and cosines written out again, gram by gram."""
    def grams(t):
        line = re.sub(r"[^a-zа-яé]+", " ", f" {t.lower()} ")
        return Counter(line[i:i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1) if n > 1 or line[i] != " ")

    place = {}
    for _, t, _ in labelled:
        for g in grams(t):
            place.setdefault(g, int(np.flatnonzero(langid.count_grams(g)[0])[0]) if len(g) == 1 else None)
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame([r[:2] for r in labelled[:60]], "doc_id bigint, text string"), model).collect()}
    for i, t, _ in labelled[:60]:
        counts, letters = langid.count_grams(t)
        assert counts.sum() == sum(grams(t).values()) and letters == sum(c.isalpha() for c in t)
        weights = [math.log1p(float(c)) * float(w) for c, w in zip(counts, model.idf)]
        size = math.sqrt(sum(w * w for w in weights))
        near = {name: max(sum(w * float(x) for w, x in zip(weights, c)) / size for c, o in zip(model.centroids, model.owner) if model.languages[o] == name) for name in model.languages}
        best = max(near.values())
        assert near[got[i]["lang_pred"]] > best - 1e-5
        assert abs(got[i]["score"] - 1 / sum(math.exp(25 * (v - best)) for v in near.values())) < 1e-3
        assert got[i]["rejected"] == (best < model.floors[min(int(math.log2(letters)), 16)])


def test_no_language_is_cut_by_its_name(spark, labelled):
    docs = spark.createDataFrame(labelled * 3, "doc_id bigint, text string, lang string")
    for sample in (4, 8, 100):
        assert langid.fit(docs, sample=sample).languages == sorted(SYLLABLES)
    assert len(langid.fit(docs, sample=2).languages) == 2, "more languages than samples: the most frequent ones"


def test_sample_is_bounded(spark, labelled):
    docs = spark.createDataFrame(labelled, "doc_id bigint, text string, lang string")
    small = langid.fit(docs, sample=40)
    assert small.languages == sorted(SYLLABLES) and len(small.centroids) <= 12


def test_counts():
    counts, letters = langid.count_grams("Ab, c")
    assert letters == 3 and counts.sum() == 3 + 5 + 4  # of " ab c "
    assert (langid.count_grams("AB  ..C")[0] == langid.count_grams("ab c")[0]).all()


def rejected(spark, model, texts):
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    return [r["rejected"] for r in sorted(got, key=lambda r: r["doc_id"])]


def test_rare_lengths_borrow_a_floor(spark, model):
    """No sample text is nearly as long as these: the floor of the nearest lengths holds."""
    rng = random.Random(4)
    foreign = ["漢字" * 20_000, "xq zq wq qx " * 5_000, "".join(chr(0x10A0 + rng.randrange(33)) + " " * (i % 5 == 0) for i in range(70_000))]
    assert rejected(spark, model, [*foreign, text(rng, "aa", 15_000), text(rng, "dd", 15_000)]) == [True] * 3 + [False] * 2
    assert (model.floors > 0).all()


def test_small_models_reject(spark, labelled):
    few = [r for r in labelled if len(r[1].split()) > 20][:15]
    small = langid.fit(spark.createDataFrame(few, "doc_id bigint, text string, lang string"))
    assert rejected(spark, small, ["漢字" * 50, "xq zq wq qx " * 40, few[0][1]]) == [True, True, False]
    one = langid.fit(spark.createDataFrame(few[:1], "doc_id bigint, text string, lang string"))
    assert rejected(spark, one, [few[0][1], "12"]) == [False, True]


def test_left_out_language_is_rejected(spark):
    """Held-out documents of a language left out of the fit go, those of the others stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 4 = 0 OR lang = 'de'")
    model = langid.fit(docs.filter("lang <> 'de' AND doc_id % 8 = 0"))
    got = langid.predict(docs.filter("doc_id % 8 = 4 OR lang = 'de'"), model).join(docs.select("doc_id", "lang"), "doc_id")
    rate = {r["out"]: r["rate"] for r in got.groupBy((F.col("lang") == "de").alias("out")).agg(F.avg(F.col("rejected").cast("int")).alias("rate")).collect()}
    assert rate[True] >= 0.9 and rate[False] <= 0.01, rate
