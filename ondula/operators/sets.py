"""Set operations on recordings, meshes, edges and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concat_sessions(*sessions: DataFrame) -> DataFrame:
    out = sessions[0]
    for s in sessions[1:]:
        out = out.unionByName(s)
    return out


def face_edges(faces: DataFrame, key: str = "mesh") -> DataFrame:
    """Every edge of every triangle in both directions, once, without self-edges."""
    pair = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    six = F.array(*[pair(a, b) for a, b in (("v0", "v1"), ("v1", "v0"), ("v1", "v2"), ("v2", "v1"), ("v0", "v2"), ("v2", "v0"))])
    return faces.select(key, F.inline(six)).where("src <> dst").distinct().orderBy(key, "src", "dst")


def symmetrise(edges: DataFrame, key: str = "graph") -> DataFrame:
    """max(A, A^T)."""
    return edges.select(key, "src", "dst", "weight").unionByName(
        edges.select(key, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy(
        key, "src", "dst").agg(F.max("weight").alias("weight"))


def fold_ids(rows: DataFrame, k: int, row: str = "row", total: int | None = None) -> DataFrame:
    """Contiguous, unshuffled folds; the last one takes the remainder. ``row`` counts from 0."""
    n = rows.count() if total is None else total
    return rows.withColumn("fold", F.least(F.floor(F.col(row) / max(n // k, 1)), F.lit(k - 1)).cast("int"))


def train_rows(folds: DataFrame, fold: int) -> DataFrame:
    return folds.where(F.col("fold") != fold)


def common_keys(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.select(*on).intersect(b.select(*on))


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))
