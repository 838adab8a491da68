"""Toxicity by non-negative positive-unlabelled learning.

Only texts confirmed as toxic are labelled; all others are unlabelled and may be either. With the class prior p the risk of a classifier g is
p * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - p * E_pos[loss(-g)]): what the toxic texts among the unlabelled add is taken out, and
the rest is kept from going below zero, where a flexible model would only learn its positives by heart.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.llm.features import REMEMBERED

BITS = 18
#: Texts to learn from, the first by a hash of their ids: confirmed toxic ones and unlabelled ones.
POSITIVE_ROWS, UNLABELLED_ROWS = 8_192, 16_384
#: A word counts if it occurs in this many of the texts to learn from, and in the toxic and the unlabelled ones at rates that differ by so many
#: standard errors.
LEAST_TEXTS, LEAST_ERRORS = 5, 4.0
STEPS, BATCH, RATE, DECAY = 1_200, 4_096, 0.1, 2e-5
#: Lengths of the beginnings of words that count beside the words: inflected forms of one stem share them.
BEGINNINGS = (4, 5)
_WORDS = re.compile(r"[^\W\d_]+")


class Words:
    """The set of a text's hashed words and beginnings of words, whole texts of any length; with weights, of those that have one."""

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.seen: dict[str, tuple[int, ...]] = {}
        self.weights = weights

    def _hashed(self, word: str) -> tuple[int, ...]:
        low = word.lower()
        parts = [low, *[f"{low[:n]}*" for n in BEGINNINGS if len(low) > n]]
        found = (zlib.crc32(p.encode("utf-8", "surrogatepass")) >> (32 - BITS) for p in parts)
        return tuple(h for h in found if self.weights is None or self.weights[h])

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        out: set[int] = set()
        for w in set(_WORDS.findall(text or "")):
            h = self.seen.get(w)
            if h is None:
                h = self.seen[w] = self._hashed(w)
            if h:
                out.update(h)
        return np.array(sorted(out), np.int64)


def _risk_gradient(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the risk by the outputs of positive and unlabelled texts, for the logistic loss."""
    sp, su = 1 / (1 + np.exp(-np.clip(zp, -35, 35))), 1 / (1 + np.exp(-np.clip(zu, -35, 35)))
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    if negative < 0:  # step back from the negative part only
        return prior * sp / len(zp), -su / len(zu)
    return (prior * (sp - 1) - prior * sp) / len(zp), su / len(zu)


def learn(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> np.ndarray:
    """Weights of the words and, last, the constant term; mini-batches with per-coordinate step sizes (Adam)."""
    size = 1 << BITS
    if not positive or not unlabelled:
        return np.append(np.zeros(size), -5.0)
    p, u = (np.bincount(np.concatenate(side), minlength=size) for side in (positive, unlabelled))
    rate = (p + u) / (len(positive) + len(unlabelled))
    error = np.sqrt(rate * (1 - rate) * (1 / len(positive) + 1 / len(unlabelled)))
    allowed = (p + u >= LEAST_TEXTS) & (np.abs(p / len(positive) - u / len(unlabelled)) >= LEAST_ERRORS * error) & (error > 0)
    columns = np.flatnonzero(allowed)
    number = np.full(size, -1)
    number[columns] = np.arange(len(columns))
    rows = [[number[x[allowed[x]]] for x in side] for side in (positive, unlabelled)]
    w, m, v = np.zeros(len(columns) + 1), np.zeros(len(columns) + 1), np.zeros(len(columns) + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean = np.zeros_like(w)
    rng = np.random.default_rng(0)
    for step in range(1, STEPS + 1):
        parts = []
        for side in rows:
            pick = [side[i] for i in rng.integers(len(side), size=min(BATCH, len(side)))]
            n = np.array([len(x) for x in pick])
            flat, row = np.concatenate(pick).astype(np.int64), np.repeat(np.arange(len(pick)), n)
            parts.append((flat, row, np.bincount(row, w[flat], len(pick)) + w[-1]))
        slopes = _risk_gradient(parts[0][2], parts[1][2], prior)
        g = DECAY * w
        g[-1] = sum(s.sum() for s in slopes)
        for (flat, row, _), s in zip(parts, slopes):
            g[:-1] += np.bincount(flat, s[row], len(columns))
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-4)
        if step > STEPS // 2:
            mean += w / (STEPS - STEPS // 2)
    out = np.zeros(size + 1)
    out[columns], out[-1] = mean[:-1], mean[-1]
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id",
        positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> np.ndarray:
    """Weights from at most ``positive_rows`` confirmed toxic texts and ``unlabelled_rows`` texts of ``docs`` whatever their label.

    Both are the first by a hash of the key; the chosen keys are broadcast (bounded by these parameters) and their texts go to one task. The class
    prior is the share of label 1 among all rows of ``labels``. A key with differing labels counts as toxic. Without a confirmed text every score is near 0.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("__y"))
    prior = marked.agg(F.avg("__y")).first()[0] or 0.0
    prior = min(max(prior, 1e-4), 0.5)

    def first(keys: DataFrame, side: int, n: int) -> DataFrame:
        return keys.select(key).withColumn("__h", F.xxhash64(key)).orderBy("__h", key).limit(n).withColumn("__side", F.lit(side))

    chosen = first(marked.where("__y = 1"), 1, positive_rows).unionByName(first(docs.where(F.col(key).isNotNull()).select(key), 0, unlabelled_rows))
    sample = docs.select(key, F.col(text).alias("__t")).join(F.broadcast(chosen.distinct()), key)
    sample = sample.select("__t", "__side", "__h", F.xxhash64("__t").alias("__th")).repartition(1).sortWithinPartitions("__h", "__side", "__th")

    def train(batches):
        words, sides = Words(), ([], [])
        for batch in batches:
            for t, side in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sides[side].append(words(t))
        w = learn(sides[1], sides[0], prior).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])

    trained = sample.select("__t", "__side").mapInArrow(train, "weights binary").collect()
    return np.frombuffer(trained[0][0], "<f4") if trained else np.append(np.zeros(1 << BITS, "<f4"), np.float32(-5))


def score(text: Column, weights: np.ndarray, df: DataFrame) -> Column:
    """The probability, 0 to 1, that a text is toxic; null is scored like the empty text."""
    sent = df.sparkSession.sparkContext.broadcast(weights)
    words: list[Words] = []

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        w = sent.value
        if not words:
            words.append(Words(w))
        z = np.array([w[words[0](t)].sum() + w[-1] for t in texts], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -35, 35))))

    return scored(text)
