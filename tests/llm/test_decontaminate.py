from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockweave.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(rows, items, window):
    found = set()
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        found |= {(tuple(w[i:i + n]), item) for i in range(len(w) - n + 1 if n else 0)}
    out = {}
    for doc, text in rows:
        w = words(text)
        hit, who = set(), set()
        for gram, item in found:
            for i in range(len(w) - len(gram) + 1):
                if tuple(w[i:i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    who |= {str(item)} - {"None"}
        out[doc, text] = (len(w), len(hit), sorted(who))
    return out


@pytest.mark.parametrize(("window", "gram"), [(10, 5), (4, 4)])
def test_matches_brute_force(edges, rows, items, window, gram):
    known = expected({r[:2] for r in rows}, [(r["item_id"], r["text"]) for r in items.collect()], window)
    got = decontaminate.contamination(edges, items, window, gram)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()), key=str)
    assert got == sorted(((r[0], *known[r[:2]]) for r in rows), key=str)
    assert any(r[2] for r in got) and not all(r[2] for r in got)


def test_rows_with_null_ids_are_told_apart(spark, items):
    leak = " ".join(f"w{i}" for i in range(12))
    asked = spark.createDataFrame([(1, leak), (2, "short item")], "item_id bigint, text string")
    rows = [(None, f"x {leak} y"), (None, "quite clean text here"), (None, None), (None, "one short item"), (None, f"x {leak} y"), (3, f"x {leak} y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, asked).collect())
    assert got == [(0, 0, []), (3, 2, ["2"]), (4, 0, []), *[(14, 12, ["1"])] * 3]
    assert sorted(map(str, (r["text"] for r in decontaminate.keep_clean(docs, asked).collect()))) == ["None", "quite clean text here"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.none() | st.integers(0, 3), st.none() | st.text("ab ", max_size=60)), max_size=8), st.lists(st.text("ab ", max_size=40), max_size=4))
def test_never_more_hits_than_words(spark, docs, asked):
    docs = list({r[0]: r for r in docs if r[0] is not None}.values()) + [r for r in docs if r[0] is None]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    table = spark.createDataFrame(list(enumerate(asked)), "item_id bigint, text string")
    known = expected(docs, enumerate(asked), 4)
    got = decontaminate.contamination(frame, table, 4, 2).collect()
    assert all(r["n_hit"] <= r["n_words"] for r in got)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == sorted(((r[0], *known[r]) for r in docs), key=str)


def test_a_long_text_that_is_hit_everywhere(spark):
    words_ = [f"w{i % 50}" for i in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words_)), (2, "clean")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(i, " ".join(words_[i:i + 30])) for i in range(50)], "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"])) for r in decontaminate.contamination(docs, asked).collect()}
    assert got == {1: (60_000, 60_000, 50), 2: (1, 0, 0)}


def test_empty_tables(edges, items, nothing):
    assert decontaminate.contamination(nothing, items).count() == 0
    none = decontaminate.contamination(edges, items.limit(0))
    assert none.count() == edges.count() and none.filter("n_hit > 0").isEmpty()


def test_keep_clean(edges, items):
    found = decontaminate.contamination(edges, items)
    clean = decontaminate.keep_clean(edges, items)
    assert clean.columns == edges.columns
    assert clean.count() == found.filter("n_hit = 0").count()


def test_main_path_is_native(edges, items, monkeypatch):
    plans, write = [], decontaminate.stage
    monkeypatch.setattr(decontaminate, "stage", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *a, **k))[1])
    decontaminate.contamination(edges, items)
    decontaminate.keep_clean(edges, items)
    assert len(plans) == 12 and not any(re.search("Python|Arrow|Pandas", plan) for plan in plans)


def test_winnow_keeps_equal_marks_for_equal_spans(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(text,), ("x y " + text[:text.index("w10")] + "z",)], "t string")
    marks = [set(r[0]) for r in df.select(decontaminate.winnow(decontaminate.gram_hashes(F.split("t", " "), 5), 6)).collect()]
    assert marks[0] & marks[1]
