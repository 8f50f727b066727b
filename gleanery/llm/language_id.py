"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased letters (all else is one space), weighted by
relative frequency and inverse document frequency. The weights are learned by
follow-the-regularised-leader with an elastic-net penalty; a temperature, fitted on a fifth of
the sample that the weights don't see, calibrates the probabilities.

The classifier is fitted on a bounded sample: for each language the labelled documents of least hash of doc_id and text, PER_LANGUAGE
of them (fewer where there are so many languages that MOST_DOCUMENTS would be exceeded, but one at least), of which
at most the first LONGEST code points are learnt from. No language is left out. Every document is
then scored by its whole text, however long. Null texts and texts without a letter are `und`, score 0; so is
all, if there's nothing to learn from, as in an empty table. Null doc_ids hash as the empty string; repeated rows are scored alike, and count as
often as they are in the sample; languages of equal probability: the first by name. Extra columns play no part and may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import packed, unpacked

PER_LANGUAGE, LONGEST, MOST_DOCUMENTS = 400, 20_000, 160_000
DIMENSIONS, EPOCHS, SCALE = 1 << 16, 3, 30.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
#: The pipeline rejects documents below this probability.
LEAST_SCORE = 0.5
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def grams(text: str) -> np.ndarray | None:
    """Hashed n-grams of a text, repeats included; None if it has no letter."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    is_letter = _letter()[a]
    if not is_letter.any():
        return None
    a = np.where(is_letter, a, np.uint32(32))
    keep = np.ones(len(a), dtype=bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    a = np.concatenate([[32], a[keep], [32]]).astype(np.uint64)
    one = a * np.uint64(0x9E3779B97F4A7C15)
    two = one[:-1] + a[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] + a[2:] * np.uint64(0x165667B19E3779F9)
    shift = np.uint64(64 - (DIMENSIONS.bit_length() - 1))
    scramble = lambda x: ((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift
    return np.concatenate([scramble(one), scramble(two), scramble(three)]).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # DIMENSIONS x languages, the inverse document frequency multiplied in
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray | None:
        g = grams(text)
        return None if g is None else self.weights[g].sum(axis=0) * (SCALE / len(g)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if text and self.languages else None
        if z is None:
            return UNKNOWN, 0.0
        p = softmax(z / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(rows: list[tuple[str, str]], seed: int = 42) -> Model:
    """Learn from (text, language) pairs."""
    rows = [(g, y) for text, y in rows if (g := grams(text)) is not None]
    languages = sorted({y for _, y in rows})
    index = {y: i for i, y in enumerate(languages)}
    k = len(languages)
    counted = [(*np.unique(g, return_counts=True), len(g), index[y]) for g, y in rows]
    frequency = np.zeros(DIMENSIONS)
    for features, *_ in counted:
        frequency[features] += 1
    idf = np.log((1 + len(counted)) / (1 + frequency)) + 1
    z, n, w = (np.zeros((DIMENSIONS, k)) for _ in range(3))
    zb, nb, b = (np.zeros(k) for _ in range(3))
    order = np.random.default_rng(seed).permutation(len(counted))
    held = order[: len(order) // 5] if len(order) >= 10 else order
    seen = order[len(order) // 5 :] if len(order) >= 10 else order

    def leader(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in seen:
            features, counts, total, y = counted[i]
            x = counts / total * idf[features] * SCALE
            w[features] = leader(z[features], n[features], L1)
            b = leader(zb, nb, 0.0)
            error = softmax(x @ w[features] + b)
            error[y] -= 1
            g = np.outer(x, error)
            z[features] += g - (np.sqrt(n[features] + g * g) - np.sqrt(n[features])) / ALPHA * w[features]
            n[features] += g * g
            zb += error - (np.sqrt(nb + error * error) - np.sqrt(nb)) / ALPHA * b
            nb += error * error
    w, b = leader(z, n, L1), leader(zb, nb, 0.0)
    scored = [((counts / total * idf[f] * SCALE) @ w[f] + b, y) for f, counts, total, y in (counted[i] for i in held)]

    def loss(t: float) -> float:
        return -sum(float(np.log(softmax(s / t)[y] + 1e-12)) for s, y in scored)

    temperature = min(np.geomspace(0.5, 5, 24), key=loss) if scored else 1.0
    return Model(languages, (w * idf[:, None]).astype(np.float32), b.astype(np.float32), float(temperature))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the bounded sample of labelled documents that aren't held out."""
    pool = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    pool = pool.select("lang", F.substring("text", 1, LONGEST).alias("text"), F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("sample")).alias("h"))
    counts = {r["lang"]: r["count"] for r in pool.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((DIMENSIONS, 0), dtype=np.float32), np.zeros(0, dtype=np.float32))
    want = max(1, min(per_language, MOST_DOCUMENTS // len(counts)))
    # A share of the hash range that holds about twice what is wanted, so that little is sorted; the least of those are kept.
    # Repeated rows share a hash: where they fill or leave the share, the language is sorted whole.
    limit = F.lit(2**63 - 1)
    for lang, n in counts.items():
        if n > 4 * want:
            limit = F.when(F.col("lang") == lang, int(-(2**63) + 2 * want / n * 2**64)).otherwise(limit)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))

    def least(rows: DataFrame) -> list:
        return rows.withColumn("n", rank).filter(F.col("n") <= want).select("lang", "text").collect()

    rows = least(pool.filter(F.col("h") <= limit))
    held = Counter(r["lang"] for r in rows)
    if short := [x for x, n in counts.items() if held[x] < min(n, want)]:
        rows = [r for r in rows if r["lang"] not in short] + least(pool.filter(F.col("lang").isin(short)))
    return fit(sorted((r["text"], r["lang"]) for r in rows))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, which replace columns of these names; no column but text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS floats a language

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in batch], columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    d = packed(docs, found=predict("text"))
    return d.select(*[F.col("row").getField(c).alias(c) for c in kept], "found.*")


def confident(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is told with a probability of at least LEAST_SCORE, all columns as they are."""
    d = predicted(packed(docs, text=F.col("text")), model)
    return unpacked(d.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return predicted(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), train(docs)).select("doc_id", "held_out", "lang_pred", "score")
