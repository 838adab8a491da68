"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text is a sparse vector of log counts, scaled to length one; its score is the logistic function of a sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.llm.features import Hasher

BITS = 18
#: Labelled rows to learn from, the first by a hash of their ids; the model's cost does not grow with the corpus.
TRAIN_ROWS = 16_384
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5


def vector(text: str | None, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values; the last bucket is the constant term."""
    at, n = hasher.counts(text)
    x = np.log1p(n)
    norm = np.sqrt((x * x).sum()) or 1.0
    return np.append(at, 1 << BITS), np.append(4 * x / norm, 1.0)


class Leader:
    """Per-coordinate follow-the-regularised-leader (proximal) for the logistic loss."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        was = self.n[at]
        now = was + g * g
        self.z[at] += g - (np.sqrt(now) - np.sqrt(was)) / ALPHA * w
        self.n[at] = now


def _train(batches):
    hasher, model, rows = Hasher(BITS), Leader((1 << BITS) + 1), []
    for batch in batches:
        rows += [(*vector(t, hasher), y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    for _ in range(EPOCHS):
        for at, x, y in rows:
            model.learn(at, x, y)
    w = model.weights(slice(None)).astype("<f4")
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id",
        rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learnt from at most ``rows`` labelled keys, the first by a hash; labels other than 0 and 1, or without a key, are left out.

    One row per key counts (the smaller label, if they differ). The labelled keys (bounded by ``rows``) are broadcast; their texts go to one task.
    With no labelled row all weights are 0, and every score 0.5.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.min(label).cast("int").alias("__y"))
    chosen = chosen.withColumn("__h", F.xxhash64(key)).orderBy("__h", key).limit(rows)
    sample = docs.select(key, F.col(text).alias("__t")).join(F.broadcast(chosen), key)
    sample = sample.select("__t", "__y", "__h", F.xxhash64("__t").alias("__th")).repartition(1).sortWithinPartitions("__h", "__th")
    trained = sample.select("__t", "__y").mapInArrow(_train, "weights binary").collect()
    return np.frombuffer(trained[0][0], "<f4") if trained else np.zeros((1 << BITS) + 1, "<f4")


def learnt(weights: np.ndarray) -> bool:
    """Whether ``fit`` found any labelled row."""
    return bool(weights.any())


def score(text: Column, weights: np.ndarray, df: DataFrame) -> Column:
    """The probability, 0 to 1, that a text is of label 1; null is scored like the empty text."""
    sent = df.sparkSession.sparkContext.broadcast(weights)
    hasher: list[Hasher] = []

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not hasher:
            hasher.append(Hasher(BITS))
        w = sent.value
        dots = np.empty(len(texts))
        for i, t in enumerate(texts):
            at, x = vector(t, hasher[0])
            dots[i] = w[at].astype(float) @ x
        return pd.Series(1 / (1 + np.exp(-np.clip(dots, -35, 35))))

    return scored(text)


def held_out(key: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))
