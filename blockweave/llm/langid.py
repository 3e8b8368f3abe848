"""Language ID by nearest centroid.

A text is a TF-IDF vector of hashed letter 1- to 3-grams, scaled to length one. Each language has several centroids,
found by spherical k-means over a bounded sample of its labelled texts. A text gets the language of the centroid with
the greatest cosine, and is rejected if that cosine is lower than texts of its length in the sample reach when they are
left out of the fit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import owned, stage
from .common import map_arrow

DIMS = 4096
CENTROIDS = 3
#: Labelled texts that a model is fitted on, at most, shared equally by the languages.
SAMPLE = 4000
#: A text is rejected below this part of the least cosine (0.5 % quantile) of sample texts of about its length, each
#: measured by centroids of the other parts of the sample; and the texts that a length class is judged by, at least.
SLACK = 0.8
FOLDS = 5
CLASS_TEXTS = 20
UNKNOWN = "und"
_HASHES = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def _letters() -> np.ndarray:
    """Code of each code point up to 0xFFFF: its lower case if it is a letter, else 0."""
    chars = [chr(i) for i in range(0x10000)]
    return np.array([ord(c.lower()[0]) if c.isalpha() else 0 for c in chars], dtype=np.uint32)


_TABLE: list[np.ndarray] = []


def letter_codes(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_letters())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rare = codes > 0xFFFF
    out = _TABLE[0][np.where(rare, 0, codes)]
    if rare.any():  # letters beyond the table stand for themselves
        out[rare] = [c if chr(c).isalpha() else 0 for c in codes[rare].tolist()]
    return out


def count_grams(text: str, dims: int = DIMS) -> tuple[np.ndarray, int]:
    """Counts of hashed 1- to 3-grams of letters (runs of others are one word border), and the number of letters."""
    codes = np.concatenate(([0], letter_codes(text), [0])).astype(np.uint32)
    letter = codes > 0
    keep = letter | np.concatenate(([True], letter[:-1]))  # of a run of others only the first
    codes, n = codes[keep], int(letter.sum())
    if n == 0:
        return np.zeros(dims, np.float32), 0
    one = codes * _HASHES[0]
    two = one[:-1] ^ (codes[1:] * _HASHES[1])
    three = two[:-1] ^ (codes[2:] * _HASHES[2])
    grams = np.concatenate((one[codes > 0], two, three))
    grams = (grams ^ (grams >> np.uint32(15))) * _HASHES[1]
    return np.bincount((grams >> np.uint32(8)) % np.uint32(dims), minlength=dims).astype(np.float32), n


def length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int32), 16)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit rows; starts from rows far from each other, so the same rows give the same centroids."""
    centers = [unit(x.mean(axis=0))]
    while len(centers) < min(k, len(x)):
        centers.append(x[np.argmin(np.max(x @ np.array(centers).T, axis=1))])
    c = np.array(centers)
    for _ in range(rounds):
        nearest = np.argmax(x @ c.T, axis=1)
        c = np.array([unit(x[nearest == i].sum(axis=0)) if (nearest == i).any() else c[i] for i in range(len(c))])
    return c.astype(np.float32)


def left_out_cosines(x: np.ndarray, lang: np.ndarray, k: int) -> np.ndarray:
    """Greatest cosine of unit rows to centroids of the other folds; only of languages with more than one row, if any."""
    fold = np.arange(len(x)) % min(FOLDS, len(x))
    best, alone = np.zeros(len(x)), np.zeros(len(x), bool)
    for f in range(fold.max() + 1 if len(x) > 1 else 0):
        out = fold == f
        names = np.unique(lang[~out])
        centroids = np.concatenate([spherical_kmeans(x[~out & (lang == name)], k) for name in names])
        best[out] = (x[out] @ centroids.T).max(axis=1)
        alone[out] = ~np.isin(lang[out], names)
    return np.where(alone, np.nan, best) if not alone.all() else best


def length_floors(best: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Least cosine accepted of each length class.

    A class takes shorter and longer neighbours in, as many as it needs to be judged by enough texts. A single text has
    no other to be measured by: its model accepts what shares a gram with it.
    """
    best, classes = best[~np.isnan(best)], classes[~np.isnan(best)]
    floors = []
    for i in range(17):
        away = np.abs(classes - i)
        width = next((w for w in range(1, 17) if (away <= w).sum() >= CLASS_TEXTS), 16)
        floors.append(SLACK * np.quantile(best[away <= width], 0.005))
    return np.maximum(floors, 1e-9)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    centroids: np.ndarray | None = None  # one row each
    owner: np.ndarray | None = None  # language of each centroid
    floors: np.ndarray | None = None  # least cosine accepted, by length class

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        """Greatest cosine to each language."""
        near = unit(np.log1p(counts) * self.idf) @ self.centroids.T
        return np.array([near[:, self.owner == i].max(axis=1) for i in range(len(self.languages))]).T


@owned()  # what is staged here is used up when the model is there
def fit(docs: DataFrame, sample: int = SAMPLE, dims: int = DIMS, k: int = CENTROIDS) -> Model:
    """A model of rows with text and lang, from at most ``sample`` of them (a hash of the id picks them).

    Each language has an equal part in the sample; of more than ``sample`` languages the rarest have none. Rows with a
    null text or lang, or without a letter, teach nothing; no usable row gives a model without languages.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # As many languages as the sample can hold one text of each; a table of such size is broadcast.
    sizes = stage(labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample), "languages")
    known = sizes.count()
    if not known:
        return Model()
    each = max(1, sample // known)
    # Enough more than are wanted that chance leaves no language short.
    chance = F.least(F.lit(1.0), F.lit(each + 4 * math.sqrt(each) + 8) / F.col("count"))
    u = F.xxhash64("doc_id", F.lit(11)).cast("double") / F.lit(float(1 << 64)) + 0.5
    drawn = labelled.select("doc_id", "lang", "text").join(F.broadcast(sizes), "lang").filter(u < chance).select("lang", u.alias("u"), "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [count_grams(t, dims) for t in batch.column("text").to_pylist()]
        packed = [np.minimum(c, 65535).astype(np.uint16).tobytes() for c, _ in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("u"), pa.array(packed, pa.binary()), pa.array([n for _, n in rows], pa.int64())],
            ["lang", "u", "counts", "letters"],
        )

    got = map_arrow(drawn, count, "lang string, u double, counts binary, letters bigint", "text").toPandas()
    # Somewhat more are drawn than are wanted; of each language those with the least hashes stay.
    got = got[got["letters"] > 0].sort_values(["lang", "u", "letters", "counts"]).groupby("lang").head(each)
    got = got.sort_values(["lang", "letters", "counts"])
    if got.empty:
        return Model()
    counts = np.stack([np.frombuffer(b, np.uint16) for b in got["counts"]])
    seen = (counts > 0).sum(axis=0)
    model = Model(languages=sorted(got["lang"].unique()))
    model.idf = (np.log((1 + len(got)) / (1 + seen)) + 0.05).astype(np.float32)
    x = unit(np.log1p(counts.astype(np.float32)) * model.idf)
    lang = got["lang"].to_numpy()
    found = [spherical_kmeans(x[lang == name], k) for name in model.languages]
    model.centroids = np.concatenate(found)
    model.owner = np.concatenate([np.full(len(c), i) for i, c in enumerate(found)])
    model.floors = length_floors(left_out_cosines(x, lang, k), length_class(got["letters"].to_numpy()))
    return model


def predict(docs: DataFrame, model: Model, sharpness: float = 25.0) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of each row; only the text is looked at, whole.

    A null text or one without a letter is ``und``, with score 0, and rejected; so is every text if the model knows no
    language. Equal cosines go to the language first by name. score: the softmax of the cosines at the predicted one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x centroids x dims, whatever the input

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        texts = batch.column("text").to_pylist()
        langs, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        for start in range(0, len(texts) if m.languages else 0, 256):
            rows = [count_grams(t or "", len(m.idf)) for t in texts[start:start + 256]]
            letters = np.array([n for _, n in rows])
            near = m.cosines(np.stack([c for c, _ in rows]))
            best = near.argmax(axis=1)
            top = near[np.arange(len(rows)), best]
            share = 1 / np.exp(sharpness * (near - top[:, None])).sum(axis=1)
            for i in np.flatnonzero(letters):
                langs[start + i] = m.languages[best[i]]
                scores[start + i] = share[i]
                rejected[start + i] = top[i] < m.floors[length_class(letters[i:i + 1])[0]]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)],
            ["doc_id", "lang_pred", "score", "rejected"],
        )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, lang_pred string, score double, rejected boolean", "text")


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text the model does not reject, unchanged.

    A model without languages (nothing in the table is labelled) has nothing to judge by: it rejects texts without a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(texts):
        import pandas as pd

        m, out = shared.value, np.zeros(len(texts), bool)
        for start in range(0, len(texts), 256):
            rows = [count_grams(t or "", len(m.idf) if m.languages else DIMS) for t in texts[start:start + 256]]
            letters = np.array([n for _, n in rows])
            fine = letters > 0
            if m.languages:
                fine &= m.cosines(np.stack([c for c, _ in rows])).max(axis=1) >= m.floors[length_class(letters)]
            out[start:start + 256] = fine
        return pd.Series(out)

    return docs.filter(accepted("text"))
