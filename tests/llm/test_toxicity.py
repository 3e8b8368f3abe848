from __future__ import annotations

import random

import pytest

from blockweave.llm import toxicity

BAD = ("grumble", "snarlish", "blimefork")


def clean_words(rng, n):
    return [rng.choice("abcdefgh") + rng.choice(("one", "two", "red", "tin")) + str(rng.randrange(30) + 20) for _ in range(n)]


def document(rng, toxic):
    words = clean_words(rng, rng.randrange(5, 60))
    if rng.random() < 0.2:
        words.insert(rng.randrange(len(words)), "grumbler")
    if toxic:
        words.insert(rng.randrange(len(words)), rng.choice(BAD) if rng.random() < 0.6 else "vex" + rng.choice(("amo", "ira", "olu", "ent")))
    return " ".join(words)


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(3)
    rows = [(i, document(rng, i % 6 == 0), int(i % 6 == 0)) for i in range(900)]
    docs = spark.createDataFrame(rows + [(5000, None, None), (5001, "grumble", None)], "doc_id bigint, text string, weight int")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows] + [(5001, 0, None), (None, 1, 1), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    return toxicity.fit(docs, labels, phrases=("grumble pie",))


def scores(spark, lexicon, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["score"] for r in toxicity.score(df, lexicon).orderBy("doc_id").collect()]


def test_held_out_accuracy(spark, learned):
    rng = random.Random(77)
    truth = [i % 4 == 0 for i in range(200)]
    got = scores(spark, learned, [document(rng, t) for t in truth])
    assert sum((s >= 0.5) == t for s, t in zip(got, truth, strict=True)) >= 197


def test_disguises_and_exceptions(spark, learned):
    disguised = ["you grуmble".replace("у", "u"), "sn4rl1sh talk", "ｂｌｉｍｅｆｏｒｋ", "bl!mef0rk", "gru​mble", "snаrlish"]
    harmless = ["grumble pie", "grumbler grumbler", "", None, "!!", "plain words"]
    assert all(s >= 0.5 for s in scores(spark, learned, disguised))
    assert all(s < 0.5 for s in scores(spark, learned, harmless))


def test_shorter_texts_score_no_lower(spark, learned):
    rng = random.Random(5)
    short, long = scores(spark, learned, ["a grumble b", "grumble " + " ".join(clean_words(rng, 3000))])
    assert short >= long >= 0.5


def test_edge_rows(edges, rows, nothing, learned):
    got = toxicity.score(edges, learned)
    assert sorted(repr(r["doc_id"]) for r in got.collect()) == sorted(repr(r[0]) for r in rows)
    assert got.filter("score IS NULL OR score < 0 OR score > 1").isEmpty()
    assert toxicity.score(nothing, learned).count() == 0


def test_nothing_to_learn(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    for docs in (edges, nothing):
        lexicon = toxicity.fit(docs, labels)
        assert not lexicon.weights and toxicity.score(edges, lexicon).filter("score >= 0.5").isEmpty()


def test_matches_are_longest_and_apart():
    lexicon = toxicity.Lexicon(weights={"\nab": 1.0, "\nabc\n": 3.0, "\nd": 2.0}, exceptions=("\nda\nabc\n",))
    assert [m[2] for m in lexicon.matches(toxicity.fold("abc d abd"))] == [3.0, 2.0, 1.0]
    assert lexicon.matches(toxicity.fold("da abc")) == []


def test_form_of_a_stem_in_few_clean_texts_is_no_exception(spark):
    """Forms share a stem entry: one that a few clean texts hold still marks, one that belongs to clean texts is spared."""
    rng = random.Random(9)
    forms = ("vexamo", "vexira", "vexolu", "vexent")
    rows = [(i, " ".join(clean_words(rng, 20)), 0) for i in range(1200)]
    rows = [(i, t + (" vexamo" if i < 5 else " vexillum" if i < 30 else ""), 0) for i, t, _ in rows]
    rows += [(2000 + i, " ".join([*clean_words(rng, 20), forms[i % 4]]), 1) for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    learned = toxicity.fit(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int"))
    assert any(not e.endswith("\n") and "\nvexamo\n".startswith(e) for e in learned.weights)
    assert "\nvexamo\n" not in learned.exceptions and "\nvexi" + "iium\n" in learned.exceptions
    marked = scores(spark, learned, ["so vexamo it is", "so vexira it is", "so vexillum it is"])
    assert [s >= 0.5 for s in marked] == [True, True, False]


def test_matches_are_those_of_a_plain_search():
    """Every entry looked for at every place, without an automaton."""
    rng = random.Random(6)
    for _ in range(60):
        pool = ["".join(rng.choice("abo") for _ in range(rng.randrange(2, 5))) for _ in range(12)]
        weights = {("\n" + w if rng.random() < 0.5 else "\n" + w + "\n"): round(rng.uniform(0.5, 3), 3) for w in pool}
        spared = tuple("\n" + "".join(rng.choice("abo") for _ in range(4)) + "\n" for _ in range(3))
        lexicon = toxicity.Lexicon(weights=dict(weights), exceptions=tuple(e for e in spared if e not in weights))
        folded = toxicity.fold(" ".join("".join(rng.choice("abo") for _ in range(rng.randrange(1, 7))) for _ in range(30)))
        inside = [(i, i + len(e)) for e in lexicon.exceptions for i in range(len(folded)) if folded.startswith(e, i)]
        hits = sorted((i, i + len(e), w) for e, w in weights.items() for i in range(len(folded)) if folded.startswith(e, i))
        wanted = []
        for a, b, w in hits:
            if any(x <= a and b <= y for x, y in inside):
                continue
            if wanted and a < wanted[-1][1] - 1:
                if w > wanted[-1][2]:
                    wanted[-1] = (a, b, w)
            else:
                wanted.append((a, b, w))
        assert lexicon.matches(folded) == wanted


def test_lexicon_has_no_cap(spark):
    """Thousands of entries with like evidence are all learned."""
    rows, labels = [], []
    for i in range(400):
        rows.append((i, " ".join(f"bad{c}" for c in ("q" * (k + 1) + "z" * (i % 8) for k in range(8)))))
        labels.append((i, i % 2))
    rows = [(i, t if i % 2 else " ".join(w.replace("bad", "good") for w in t.split())) for i, t in rows]
    lexicon = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert lexicon.weights and all(lexicon.matches(toxicity.fold(t)) for i, t in rows if i % 2)
    assert not hasattr(toxicity, "ENTRIES")
