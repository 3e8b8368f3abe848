"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Folding makes disguised spellings one: compatibility forms and lower case, look-alike letters of other scripts, digits
and signs that stand for letters, invisible characters. The lexicon is learned from labelled texts: words and beginnings
of words that toxic texts hold far more often than chance allows, each with its log odds. Words that begin like an
entry but belong to clean texts are exceptions; phrases may be given too. The weights of a text's matches, with and
without division by its length, give the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import owned, stage
from .common import map_arrow

#: Labelled texts that a model is fitted on, at most, of either label.
SAMPLE_TOXIC = 5_000
SAMPLE_CLEAN = 15_000
#: Lengths of beginnings of words that may become entries.
STEMS = range(3, 9)
#: Rounds of search, each among the toxic texts that no entry explains yet, and the part of a round's best evidence that
#: an entry needs. Words that only mark copies of one toxic text are so passed over: their texts are explained before.
ROUNDS = 8
EVIDENCE = 0.25
#: Clean texts that a word needs to be an exception.
EXCEPTION_TEXTS = 3
EDGE = "\n"

# Letters that look like a Latin one (i and l count as one letter, as 1 stands for both).
LOOKALIKES = {
    "а": "a", "α": "a", "в": "b", "β": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "ё": "e", "һ": "h", "і": "i",
    "ι": "i", "ı": "i", "ј": "j", "к": "k", "κ": "k", "м": "m", "ո": "n", "о": "o", "ο": "o", "σ": "o", "օ": "o", "р": "p",
    "ρ": "p", "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ս": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "х": "x", "χ": "x", "у": "y",
    "γ": "y", "ɡ": "g", "ɑ": "a", "ӏ": "l",
}
# Digits and signs that stand for a letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
# Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"

_FOLD = str.maketrans(LOOKALIKES | SUBSTITUTES | dict.fromkeys(INVISIBLE, ""))
_WORDS = re.compile(r"[^\W_]+")
#: A sign is a letter only between word characters; elsewhere it is punctuation.
_SIGN = re.compile(r"(?<!\w)[@$!|]+(?!\w)|[!|]+(?!\w)|(?<!\w)[!|]+")


def fold(text: str) -> str:
    """Folded words of a text, each between line ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = _SIGN.sub(" ", text.lower()).translate(_FOLD)
    return EDGE + EDGE.join(_WORDS.findall(text)) + EDGE


def candidates(folded: str) -> set[str]:
    """Words and beginnings of words, each as the string to be matched."""
    out = set()
    for word in set(folded.split(EDGE)):
        if len(word) >= min(STEMS):
            out.add(EDGE + word + EDGE)
            out.update(EDGE + word[:n] for n in STEMS if n <= len(word))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    #: Of the constant, log(1 + weight) and the square root of weight per word.
    terms: tuple[float, float, float] = (-4.0, 3.0, 0.0)
    _machine: ahocorasick.Automaton | None = None

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for phrase in self.exceptions:
                self._machine.add_word(phrase, (len(phrase), None))
            for entry, weight in self.weights.items():
                self._machine.add_word(entry, (len(entry), weight))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """``start, end, weight`` of entries outside exception phrases; of overlapping entries the heaviest."""
        machine = self.machine()
        if not len(machine):
            return []
        found, spared = [], []
        for last, (length, weight) in machine.iter(folded):
            span = (last + 1 - length, last + 1)
            spared.append(span) if weight is None else found.append((*span, weight))
        out: list[tuple[int, int, float]] = []
        for start, end, weight in sorted(found):
            if any(a <= start and end <= b for a, b in spared):
                continue
            if out and start < out[-1][1] - 1:  # words share the edge between them
                if weight > out[-1][2]:
                    out[-1] = (start, end, weight)
            else:
                out.append((start, end, weight))
        return out

    def measure(self, text: str) -> tuple[float, int]:
        """Sum of weights, and the number of words."""
        folded = fold(text)
        return sum(w for *_, w in self.matches(folded)), folded.count(EDGE) - 1

    def score(self, weight: float, words: int) -> float:
        a, b, c = self.terms
        return 1 / (1 + math.exp(-(a + b * math.log1p(weight) + c * math.sqrt(weight / max(words, 1)))))


def exception_phrase(phrase: str) -> str:
    return fold(phrase)


def _measures(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)  # what a sample of bounded size gives evidence of

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [shared.value.measure(t or "") for t in batch.column("text").to_pylist()]
        got = [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *got], ["doc_id", "toxic", "weight", "words"])

    return map_arrow(texts.select("doc_id", "toxic", "text"), run, "doc_id bigint, toxic int, weight double, words bigint", "text")


def _candidate_counts(texts: DataFrame) -> DataFrame:
    """``entry, n``: the number of texts that hold each candidate; summed within a batch, then by Spark."""

    def run(batches):
        for batch in batches:
            n = Counter()
            for text in batch.column("text").to_pylist():
                n.update(candidates(fold(text or "")))
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["entry", "n"])

    counted = texts.select("text").mapInArrow(run, "entry string, n bigint")
    return counted.groupBy("entry").agg(F.sum("n").alias("n"))


def _closed(found: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """Entries without those that another one makes needless: a longer one with nearly the same toxic
    texts (nine in ten), else a shorter one."""
    out = {}
    for entry, (p, n) in sorted(found.items(), key=lambda x: (-len(x[0]), x[0])):
        longer = any(e != entry and e.startswith(entry) and q[0] >= 0.9 * p for e, q in found.items())
        if not longer:
            out[entry] = (p, n)
    return {e: v for e, v in out.items() if not any(e != s and e.startswith(s) for s in out)}


@owned()  # what is staged here is used up when the model is there
def fit(docs: DataFrame, labels: DataFrame, phrases: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon of labelled texts, from bounded samples that a hash of the id picks.

    Rows with a null text or label teach nothing; without a toxic text nothing is an entry. ``phrases`` are exceptions
    besides the learned ones.
    """
    toxic = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in toxic.groupBy("toxic").count().collect()}
    u = F.xxhash64("doc_id", F.lit(13)).cast("double") / F.lit(float(1 << 64)) + 0.5
    clean_share = min(1.0, 0.95 * SAMPLE_CLEAN / max(sizes.get(0, 0), 1))
    toxic_share = min(1.0, 0.95 * SAMPLE_TOXIC / max(sizes.get(1, 0), 1))
    drawn = toxic.filter(u < F.when(F.col("toxic") == 1, toxic_share).otherwise(clean_share))
    # Ids and labels of the sample alone, about SAMPLE_TOXIC + SAMPLE_CLEAN rows at most, go to where the texts are.
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    sample = stage(texts, "toxicity-sample")
    clean, unexplained = sample.filter("toxic = 0"), sample.filter("toxic = 1")
    n_toxic, n_clean = unexplained.count(), clean.count()
    lexicon = Lexicon(exceptions=tuple(map(exception_phrase, phrases)))
    if not n_toxic:
        return lexicon
    in_clean = stage(_candidate_counts(clean).withColumnRenamed("n", "clean"), "toxicity-clean")
    left = n_toxic
    for _ in range(ROUNDS):
        counts = _candidate_counts(unexplained).filter("n >= 3").join(in_clean, "entry", "left").na.fill(0, ["clean"])
        counts = stage(counts, "toxicity-counts")
        # Toxic texts by chance: each text that holds the entry is toxic with the base rate (a binomial tail's bound).
        base = math.log((left + n_clean) / left)
        share = F.col("n") / (F.col("n") + F.col("clean"))
        tail = F.col("n") * (F.log(share) + F.lit(base)) + F.when(
            F.col("clean") > 0, F.col("clean") * (F.log(1 - share) - F.log(F.lit(n_clean / (left + n_clean))))
        ).otherwise(F.col("clean") * 0.0)
        found = counts.filter(share >= 0.8).withColumn("tail", tail).filter(F.col("tail") > math.log(max(1, counts.count())) + 3)
        best = found.agg(F.max("tail")).first()[0]
        if best is None:
            break
        # Bounded by the evidence that an entry needs and the sample that gives it, not by a number.
        rows = found.filter(F.col("tail") >= EVIDENCE * best).orderBy(F.desc("tail"), "entry").collect()
        fresh = _closed({r["entry"]: (r["n"], r["clean"]) for r in rows})
        for entry, (p, n) in fresh.items():
            lexicon.weights[entry] = round(math.log((p + 0.5) / (left + 1)) - math.log((n + 0.5) / (n_clean + 1)) + math.log1p(p), 6)
        matched = _measures(unexplained, lexicon).filter("weight = 0").select("doc_id")
        unexplained = stage(unexplained.join(matched.distinct(), "doc_id"), "toxicity-left")
        left = unexplained.count()
        if left < 3:
            break
    # Whole words of clean texts that begin like an entry: exceptions if toxic texts hold them no more often. Fewer than
    # EXCEPTION_TEXTS clean texts say nothing: an entry, too, may have a fifth of its texts among the clean ones.
    stems = sorted(e for e in lexicon.weights if not e.endswith(EDGE))
    if stems:
        begins = F.lit(False)
        for size in sorted({len(s) for s in stems}):
            begins |= F.substring("entry", 1, size).isin([s for s in stems if len(s) == size])
        whole = F.col("entry").endswith(EDGE) & begins
        in_toxic = _candidate_counts(sample.filter("toxic = 1")).filter(whole).withColumnRenamed("n", "toxic")
        forms = in_clean.filter(whole & (F.col("clean") >= EXCEPTION_TEXTS)).join(in_toxic, "entry", "left").na.fill(0, ["toxic"])
        # Rates, not counts: the samples of either label differ in size.
        spared = forms.filter(F.col("toxic") * F.lit(n_clean) <= F.col("clean") * F.lit(n_toxic))
        spared = spared.orderBy(F.desc("clean"), "entry").collect()
        lexicon.exceptions += tuple(r["entry"] for r in spared)
    lexicon.terms = _fit_terms(_measures(sample, lexicon).select("weight", "words", "toxic").toPandas())
    return lexicon


def _fit_terms(rows, rounds: int = 30, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method."""
    weight, words, y = (rows[c].to_numpy(dtype=float) for c in ("weight", "words", "toxic"))
    x = np.stack([np.ones(len(y)), np.log1p(weight), np.sqrt(weight / np.maximum(words, 1))], axis=1)
    b = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        b += np.linalg.solve(h, x.T @ (y - p) - ridge * b)
    return tuple(float(v) for v in b)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score, weight, words`` of each row, by its whole text alone.

    Null and empty texts weigh nothing and get the score of a text without a match; rows that repeat score alike; an
    empty table gives no rows.
    """
    scored = _measures(docs.select("doc_id", F.lit(None).cast("int").alias("toxic"), "text"), lexicon)
    a, b, c = lexicon.terms
    odds = F.lit(a) + F.lit(b) * F.log1p("weight") + F.lit(c) * F.sqrt(F.col("weight") / F.greatest("words", F.lit(1)))
    return scored.select("doc_id", (1 / (1 + F.exp(-odds))).alias("score"), "weight", "words")
