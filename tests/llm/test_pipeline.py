"""The pipeline against its parts, and every registered query."""

from __future__ import annotations

import pytest
from oracle import compare, connect, entry
from pyspark.sql import functions as F

import corpus_pipeline
from blockweave.llm import decontaminate, langid, packing, queries, secret_scan, simhash
from blockweave.llm.common import table
from blockweave.sources.staging import stage

SF_DIR = "/root/testdata/sf0.001"
DEALT = [f"op{n}_" for n in range(1, 14)]
#: The queries that give a row for each document; the others have shapes of their own.
BY_DOCUMENT = [n for n in queries.queries() if not n.startswith(("op9_", "op11_", "op12_", "op13_"))]


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_names():
    names = list(queries.queries())
    assert sorted(next(n for n in names if n.startswith(d)) for d in DEALT) == sorted(names)
    assert set(names) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_matches_sql(spark, duck, name):
    rows, _ = compare(spark, duck, SF_DIR, name)
    assert rows > 0 and (name not in BY_DOCUMENT or rows == table(spark, SF_DIR, "documents").count())


@pytest.mark.parametrize("name", [n for n in BY_DOCUMENT if n not in queries.oracle_sql()])
def test_one_row_a_document(spark, name):
    got = entry.queries()[name](spark, SF_DIR)
    ids = sorted(r["doc_id"] for r in got.collect())
    assert ids == sorted(r["doc_id"] for r in table(spark, SF_DIR, "documents").collect())


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF_DIR, "documents")
    for name, step in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, SF_DIR), name)
        assert docs.dtypes == before.dtypes, name
        left = {r["doc_id"] for r in docs.collect()}
        assert left <= {r["doc_id"] for r in before.collect()}
        if name == "near_dedup":
            homes = simhash.near_duplicates(before).collect()
            assert left == {r["component_id"] for r in homes}
        if name == "decontaminate":
            found = decontaminate.contamination(before, table(spark, SF_DIR, "benchmark"))
            assert left == {r["doc_id"] for r in found.filter("n_hit = 0").collect()}
        if name == "secrets":
            assert len(left) == before.count()
            assert secret_scan.scan_documents(docs).filter("size(spans) > 0").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r["doc_id"] for r in packed.collect()} == left
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, packed.collect()))
    assert whole.columns[:5] == [c.split()[0] for c in packing.PIECE_SCHEMA.split(", ")]


def test_stages_of_an_empty_table_and_edge_rows(spark, edges, nothing):
    for docs in (nothing, edges):
        for _, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, SF_DIR)
        assert docs.count() >= 0


def test_unlabelled_documents_keep_what_has_a_letter(spark, edges):
    unlabelled = edges.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.STAGES[0][1](spark, unlabelled, SF_DIR)
    assert kept.count() == edges.filter(F.col("text").rlike(r"\p{L}")).count() > 0


def test_language_id_learns_from_every_labelled_row(spark, monkeypatch):
    seen = []
    learn = langid.fit
    monkeypatch.setattr(langid, "fit", lambda docs, **k: seen.append(docs.count()) or learn(docs, **k))
    docs = table(spark, SF_DIR, "documents")
    corpus_pipeline.STAGES[0][1](spark, docs, SF_DIR)
    assert seen == [docs.count()]
