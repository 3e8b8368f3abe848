"""Benchmark decontamination by winnowing, in DataFrame functions only.

The hashes of a document's k-grams of words are winnowed: of each ``window - k + 1`` consecutive ones the least is kept
(any rule that looks only at hash values keeps the same fingerprint in equal spans). So a document and a benchmark item
that share ``window`` words share a fingerprint. Items of fewer words have no fingerprint; the hashes of all runs of as
many words stand for them. One pass over the corpus cuts it into words and says which documents share a mark of
either kind; these few are searched around their hits for whole windows of the benchmark, compared as text, so chance
collisions cost work and never change a result.

A row is known by its ``doc_id``, or by the digest of its text if that is null; equal rows share their result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import owned, stage
from .common import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a null text has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _starts(count: Column, length: int) -> Column:
    """0 .. count - length as an array, empty where that is negative."""
    return F.when(count >= length, F.sequence(F.lit(0), count - length)).otherwise(F.array().cast("array<int>"))


def gram_hashes(tokens: Column, gram: int) -> Column:
    """The hash of each run of ``gram`` words."""
    return F.transform(_starts(F.size(tokens), gram), lambda i: F.xxhash64(*[tokens[i + j] for j in range(gram)]))


def winnow(hashes: Column, width: int) -> Column:
    """The distinct least values of all runs of ``width`` hashes."""
    return F.array_distinct(F.transform(_starts(F.size(hashes), width), lambda i: F.array_min(F.slice(hashes, i + 1, width))))


#: What tells rows apart: ``doc_id``, and ``own`` where that is null.
KEYS = ("doc_id", "own")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.sha2(text, 256)).alias("own"))


def _join_keys(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the keys of a row, one of which is null; the right side's are dropped."""
    right = right.withColumnsRenamed({k: f"other_{k}" for k in KEYS})
    same = [left[k].eqNullSafe(right[f"other_{k}"]) for k in KEYS]
    return left.join(right, same[0] & same[1], how).drop(*[f"other_{k}" for k in KEYS])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, window, length``: all windows of each item; an item of fewer words, but not none, is one window."""
    tokens = items.select("item_id", words(F.col("text")).alias("w"))
    count = F.size("w")
    length = F.least(count, F.lit(window))
    full = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - length)).otherwise(F.array().cast("array<int>")),
        lambda i: F.array_join(F.slice("w", i + 1, length), " "),
    )
    return tokens.select("item_id", length.alias("length"), F.explode(full).alias("window")).distinct()


def _run_hashes(tokens: Column, length: int) -> Column:
    """The hash of each run of ``length`` words, other than those of :func:`gram_hashes`."""
    return F.transform(_starts(F.size(tokens), length), lambda i: F.xxhash64(F.lit(length), *[tokens[i + j] for j in range(length)]))


def shared_marks(docs: DataFrame, windows: DataFrame, shorter: list[int], window: int, gram: int) -> DataFrame:
    """``doc_id, own, n_words, marks`` of each row of :func:`_keyed`: its marks that the benchmark has, too.

    The rows that the marks make meet their marks' table first and are put together in the task that made them.
    """

    def cut(rows: DataFrame, *kept: str) -> DataFrame:
        """Grams and runs of words ``w``, before they are used: what a lambda holds is computed for each of its elements."""
        runs = [F.array_distinct(_run_hashes(F.col("w"), n)).alias(f"runs_{n}") for n in shorter]
        return rows.select(*kept, gram_hashes(F.col("w"), gram).alias("h"), *runs)

    long = winnow(F.col("h"), window - gram + 1)
    of_length = F.when(F.col("length") == window, long)
    for n in shorter:
        of_length = of_length.when(F.col("length") == n, F.col(f"runs_{n}"))
    marks = cut(windows.select("length", "window").distinct().select("length", F.split("window", " ").alias("w")), "length")
    marks = stage(marks.select(F.explode(of_length).alias("mark")).distinct(), "benchmark-marks")
    marks = marks.withColumn("shared", F.lit(True))  # of known size: broadcast if small, else shuffled
    tokens = docs.select(*KEYS, words(F.col("text")).alias("w"))
    own = cut(tokens.select(*KEYS, F.size("w").cast("bigint").alias("n_words"), "w"), *KEYS, "n_words")
    own = own.select(*KEYS, "n_words", F.concat(long, *[f"runs_{n}" for n in shorter]).alias("marks"))
    each = own.select(*KEYS, "n_words", F.explode_outer("marks").alias("mark")).join(marks, "mark", "left")
    found = each.groupBy(*KEYS).agg(F.max("n_words").alias("n_words"), F.collect_set(F.when(F.col("shared"), F.col("mark"))).alias("marks"))
    return stage(found, "benchmark-shared")


def window_hits(docs: DataFrame, shared: DataFrame, windows: DataFrame, shorter: list[int], window: int, gram: int) -> DataFrame:
    """``doc_id, own, at, length, window``: each place of a row of :func:`_keyed` where a window of the benchmark occurs."""
    # Few rows as a rule: a table of its own, whose size decides how it meets the texts.
    some = stage(shared.filter(F.size("marks") > 0).select(*KEYS, "marks"), "benchmark-near")
    near = _join_keys(docs, some, "inner").select(*KEYS, "marks", words(F.col("text")).alias("w"))

    def marked(hashes: Column) -> Column:
        return F.transform(hashes, lambda h: F.array_contains("marks", h))

    # A full window holds a shared fingerprint among its grams; a shorter one is marked itself.
    flags = near.select(*KEYS, "w", marked(gram_hashes(F.col("w"), gram)).alias("grams"), *[marked(_run_hashes(F.col("w"), n)).alias(f"runs_{n}") for n in shorter])
    # Both uses of the flags matter: what is used once, inside a lambda, Spark computes anew for each element.
    width = window - gram + 1
    full = F.filter(_starts(F.size("grams"), width), lambda i: F.array_contains(F.slice("grams", i + 1, width), True))

    def texts(starts: Column, length: int) -> Column:
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(length).alias("length"), F.array_join(F.slice("w", i + 1, length), " ").alias("window")))

    def own(n: int) -> Column:
        return F.filter(_starts(F.size(f"runs_{n}"), 1), lambda i: F.col(f"runs_{n}")[i])

    every = [texts(full, window), *[texts(own(n), n) for n in shorter]]
    places = flags.select(*KEYS, F.explode(F.concat(*every)).alias("x")).select(*KEYS, "x.*")
    return places.join(windows.select("length", "window").distinct(), ["length", "window"]).select(*KEYS, "at", "length", "window")


def _search(docs: DataFrame, items: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The benchmark's windows, the rows with their number of words, and the hits."""
    windows = stage(item_windows(items.select("item_id", "text"), window), "benchmark-windows")
    # At most window - 1 numbers.
    shorter = sorted(r[0] for r in windows.filter(F.col("length") < window).select("length").distinct().collect())
    shared = shared_marks(docs, windows, shorter, window, gram)
    hits = stage(window_hits(docs, shared, windows, shorter, window, gram).distinct(), "benchmark-hits")
    return windows, shared, hits


@owned()
def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_hit, items``: words of each document inside any occurring window; ids of items, sorted.

    ``items`` are strings. Null and empty texts have no words; rows with a null ``doc_id`` are told apart by their texts;
    null item ids are left out of ``items`` (their words count); repeated items and rows change nothing; an empty benchmark
    hits nothing; an empty table gives no rows.
    The result is a table of the caller's.
    """
    docs = _keyed(docs)
    windows, shared, hits = _search(docs, items, window, gram)
    # Over places in order, the words beyond the last end: no list of words is built.
    places = F.array_sort(F.collect_set(F.struct("at", "length")))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def cover(state: Column, x: Column) -> Column:
        end = F.greatest(state["end"], x["at"] + x["length"])
        return F.struct((state["n"] + end - F.greatest(state["end"], x["at"])).alias("n"), end.alias("end"))

    spans = hits.groupBy(*KEYS).agg(F.aggregate(places, nothing, cover, lambda s: s["n"]).cast("bigint").alias("n_hit"))
    # Windows of the same items bring the same list, which a row then has once.
    owners = windows.groupBy("window").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = hits.select(*KEYS, "window").distinct().join(owners, "window")
    found = found.groupBy(*KEYS).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    results = _join_keys(_join_keys(shared.select(*KEYS, "n_words"), spans, "left"), found, "left")
    results = results.select(
        *KEYS, "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )
    found = _join_keys(docs.select(*KEYS), results, "inner").select("doc_id", "n_words", "n_hit", "items")
    return stage(found, "contamination", keep=True)


@owned()
def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, unchanged; rows with a null ``doc_id`` are judged by their texts."""
    _, _, hits = _search(_keyed(docs), items, WINDOW, GRAM)
    hits = stage(hits.select(F.col("doc_id").alias("hit_id"), F.col("own").alias("hit_own")).distinct(), "contaminated", keep=True)
    own = F.when(docs["doc_id"].isNull(), F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["hit_id"]) & own.eqNullSafe(hits["hit_own"]), "left_anti")
