"""The dealt operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    fingerprints,
    hard_negatives,
    langid,
    lexical_search,
    neighbours,
    packing,
    secret_scan,
    shards,
    simhash,
    substring_dedup,
    suffix_dedup,
    toxicity,
)
from .common import crc_of_id, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


SHARDS = 16


@_register("op2_sharding")
def _(spark, sf):
    dealt = shards.shard_by_bytes(table(spark, sf, "documents"), SHARDS)
    return dealt.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def _spans_sql(kind: int, pattern: str, value: str, least: int) -> str:
    """Positions from the lengths of gaps and matches; ``value`` gives the part of a match ``m`` that must be long."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, text, {kind} AS kind, m, p0 + own0 AS s, p0 + own0 + length(m) AS e, {value} AS v, {least} AS least
    FROM (SELECT doc_id, text, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gs[1:i], lambda g: length(g))))) AS p0,
                 unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS own0
          FROM (SELECT doc_id, text, regexp_extract_all(text, '{quoted}') AS ms, regexp_split_to_array(text, '{quoted}') AS gs FROM d))"""


_SECRET_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS (
  {_spans_sql(0, secret_scan.ASSIGN_PATTERN, "regexp_extract(m, '" + secret_scan.ASSIGN_PATTERN.replace("'", "''") + "', 2)", 12)}
  UNION ALL {_spans_sql(1, "AKIA[A-Z0-9]+", "m", 18)}
  UNION ALL {_spans_sql(2, "[0-9a-f]+", "m", 16)}),
good AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
         count(*) FILTER (kind = 2) AS n_hex,
         string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind) AS spans
  FROM found WHERE length(v) >= least GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN good USING (doc_id)
"""


@_register("op10_secrets", _SECRET_SQL)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    # Two rounds, as when a rule is added: the second finds the ledger of the first and scans for the new rule alone.
    _, ledger = secret_scan.update_ledger(docs, None, secret_scan.RULES[:-1])
    found = secret_scan.scan_documents(docs, ledger)
    counts = {f"n_{r.kind}": secret_scan.count_kind(F.col("spans"), k) for k, r in enumerate(secret_scan.RULES)}
    shown = found.withColumns(counts).withColumn("spans", secret_scan.describe(F.col("spans")))
    return shown.select("doc_id", *counts, F.sha2("spans", 256).alias("base_sha256"), "spans")


_LEAK_SQL = r"""
WITH t AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
items AS (
  SELECT DISTINCT id AS item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM w WHERE side = 1 AND len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM items),
runs AS (
  SELECT id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM w, lengths WHERE side = 0 AND len(w) >= n)),
hits AS (SELECT DISTINCT id, i, runs.n, item_id FROM runs JOIN items ON runs.win = items.win AND runs.n = items.n),
words AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY id),
who AS (
  SELECT id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT id, item_id::VARCHAR AS item FROM hits) GROUP BY id)
SELECT w.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words ON words.id = w.id LEFT JOIN who ON who.id = w.id WHERE side = 0
"""


@_register("op8_decontamination", _LEAK_SQL)
def _(spark, sf):
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@_register("op6_fingerprints")
def _(spark, sf):
    return fingerprints.fingerprint_edits(table(spark, sf, "documents")).drop("positions")


def learnable(docs: DataFrame) -> Column:
    """True for the documents that a language model may learn from."""
    return crc_of_id(docs["doc_id"]) % 3 != 1


@_register("op4_language_id")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.fit(docs.filter(learnable(docs)))
    held_out = crc_of_id(F.col("doc_id")) % 3 == 1
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@_register("op7_toxicity")
def _(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    lexicon = toxicity.fit(docs, labels.filter(crc_of_id(F.col("doc_id")) % 5 != 0))
    return toxicity.score(docs, lexicon).select(
        "doc_id", (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@_register("op3_simhash")
def _(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_register("op9_packing")
def _(spark, sf):
    return packing.pack(table(spark, sf, "documents"), tokenizer_file())


_SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
runs AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS win
  FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
firsts AS (SELECT win, min({'d': doc_id, 'i': i}) AS first FROM runs GROUP BY win),
gone AS (SELECT doc_id, i FROM runs JOIN firsts USING (win) WHERE {'d': doc_id, 'i': i} > first),
cuts AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM gone),
islands AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (
    SELECT doc_id, i, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM cuts)
  GROUP BY doc_id, island),
parts AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM islands),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


@_register("op1_suffix_dedup", _SUFFIX_SQL)
def _(spark, sf):
    return suffix_dedup.remove_repeats(table(spark, sf, "documents")).drop("starts", "stops")


_WINDOW_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
runs AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
firsts AS (SELECT win, min(doc_id) AS first FROM runs GROUP BY win),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (
    SELECT doc_id, unnest(range(i, i + 13)) AS p FROM runs JOIN firsts USING (win) WHERE doc_id > first) GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
         list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)) AS k
  FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""


@_register("op5_substring_dedup", _WINDOW_SQL)
def _(spark, sf):
    return substring_dedup.remove_repeats(table(spark, sf, "documents")).drop("starts", "stops")


_NEGATIVES_SQL = """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
one AS (SELECT vec_id, min({'l': label, 'e': e}) AS o FROM given GROUP BY vec_id),
v AS (SELECT vec_id, o.l AS label, list_transform(o.e, lambda x: floor(256 * x)) AS x FROM one),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
near AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM near JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


@_register("op11_hard_negatives", _NEGATIVES_SQL)
def _(spark, sf):
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


@_register("op12_neighbours")
def _(spark, sf):
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


_LEXICAL_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)) GROUP BY item_id, term),
s AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
tf AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
weights AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
adds AS (
  SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * tf.n * s.n) // s.l))) AS a FROM tf JOIN weights USING (term), s),
scored AS (SELECT item_id, r, doc_id, sum(c * a)::BIGINT AS score FROM adds JOIN q USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


@_register("op13_lexical_search", _LEXICAL_SQL)
def _(spark, sf):
    return lexical_search.rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
