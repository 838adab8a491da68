"""Arg-max, thresholds by rank and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ondula.operators.quantiles import quantiles


def hard_states(gamma: DataFrame, keys: Sequence[str] = ("recording", "t")) -> DataFrame:
    """Most probable state per time; the lowest index on ties."""
    return gamma.groupBy(*keys).agg(F.max_by("state", F.struct("p", -F.col("state"))).alias("state"))


def density_threshold(edges: DataFrame, density: float, key: str = "graph") -> DataFrame:
    """Edges whose magnitude reaches the (1 - density) quantile of the positive off-diagonal magnitudes."""
    e = edges.where("src <> dst").withColumn("_w", F.abs("weight"))
    level = quantiles(e.where("_w > 0"), [key], "_w", {"_q": 1 - density})
    return e.join(level, key).where(F.col("_w") >= F.col("_q")).select(key, "src", "dst", F.lit(1.0).alias("weight"))


def best_lag(correlations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lag of the largest absolute cross-correlation, the first one on ties."""
    best = F.max_by(F.struct("lag", "cc"), F.struct(F.abs("cc"), -F.col("lag"))).alias("_b")
    return correlations.groupBy(*keys).agg(best).select(*keys, "_b.lag", "_b.cc")


def order_modes(modes: DataFrame, keys: Sequence[str], freq: str = "freq") -> DataFrame:
    """Rank modes of a window by frequency magnitude, largest first."""
    return modes.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.abs(freq)), "mode")))


def peak_in(spectra: DataFrame, keys: Sequence[str], target: float, window: float) -> DataFrame:
    """Position and height of the highest magnitude inside target ± window."""
    inside = spectra.where(F.col("ppm").between(target - window, target + window))
    best = F.max_by(F.struct("ppm", "magnitude"), F.struct("magnitude", -F.col("ppm"))).alias("_b")
    return inside.groupBy(*keys).agg(best).select(*keys, "_b.ppm", "_b.magnitude")


def order_by_window_energy(components: DataFrame, low: float, high: float) -> DataFrame:
    """Components by the share of their energy inside a time window, largest first."""
    inside = F.sum(F.when(F.col("t").between(low, high), F.col("value") ** 2))
    return components.groupBy("component").agg(
        (F.coalesce(inside, F.lit(0.0)) / (F.sum(F.col("value") ** 2) + 1e-9)).alias("ratio")).orderBy(F.desc("ratio"), "component")
