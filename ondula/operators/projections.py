"""Row-wise projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.operators.attach import attach, sized_broadcast
from ondula.operators.quantiles import quantiles


def pick_channels(samples: DataFrame, channels: DataFrame, kinds: Sequence[str] | None = None,
                  names: Sequence[str] | None = None, on: Sequence[str] = ("recording", "channel")) -> DataFrame:
    """Samples of the channels of the given kinds or names that are not marked bad."""
    keep = channels.where(~F.coalesce("bad", F.lit(False)))
    if kinds is not None:
        keep = keep.where(F.col("kind").isin(list(kinds)))
    if names is not None:
        keep = keep.where(F.col("channel").isin(list(names)))
    return samples.join(keep.select(*on).distinct(), list(on), "left_semi")


def crop(samples: DataFrame, start: float = 0.0, stop: float | None = None, fs: float = 1.0, order: str = "t") -> DataFrame:
    """Samples between two times in seconds, both ends included."""
    out = samples.where(F.col(order) >= start * fs)
    return out if stop is None else out.where(F.col(order) <= stop * fs)


def trim_to_shortest(samples: DataFrame, trial: Sequence[str], order: str = "t") -> DataFrame:
    """Cut all trials to the length of the shortest."""
    shortest = samples.groupBy(*trial).agg((F.max(order) + 1).alias("_n")).agg(F.min("_n").alias("_len"))
    return samples.join(F.broadcast(shortest), F.col(order) < F.col("_len")).drop("_len")


def standardise(samples: DataFrame, keys: Sequence[str] = ("recording", "channel"), value: str = "value") -> DataFrame:
    """(x - mean) / population deviation per key, deviation 0 taken as 1.

    Two statistics per key are joined back, so a long channel is not gathered
    into one window partition.
    """
    keys = list(keys)
    s = samples.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = (F.col(value) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return attach(samples, s, keys, [value]).withColumn(value, z).drop("_m", "_s")


def log_standardise(features: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return standardise(features.withColumn(value, F.log(F.col(value) + 1e-6)), keys, value)


def flip_signs(samples: DataFrame, signs: DataFrame, on: Sequence[str] = ("recording", "channel")) -> DataFrame:
    return attach(samples, signs, list(on), ["t"]).withColumn("value", F.col("value") * F.col("sign")).drop("sign")


def soft_threshold(x: Column, level) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - level, F.lit(0.0))


def soft_threshold_complex(s: Column, level) -> Column:
    """Shrink the modulus, keep the angle."""
    mod = F.hypot(s["re"], s["im"])
    scale = F.when(mod > 0, F.greatest(mod - level, F.lit(0.0)) / mod).otherwise(0.0)
    return F.struct((s["re"] * scale).alias("re"), (s["im"] * scale).alias("im"))


def binarise(gamma: DataFrame, level: float = 0.5, p: str = "p") -> DataFrame:
    return gamma.withColumn("active", (F.col(p) >= level).cast("double"))


def lesion(edges: DataFrame, regions: Sequence[int], strength: float = 0.0) -> DataFrame:
    """Scale rows, then columns, of the chosen regions; an edge inside gets strength squared."""
    end = lambda c: F.when(F.col(c).isin(list(regions)), F.lit(float(strength))).otherwise(1.0)
    return edges.withColumn("weight", F.col("weight") * end("src") * end("dst"))


# The two editing contrasts of the four conditions A, B, C, D.
EDIT_CONTRASTS = {"first": (1, 1, -1, -1), "second": (1, -1, 1, -1)}


def edit_contrasts(fids: DataFrame, keys: Sequence[str], conditions: Sequence = ("A", "B", "C", "D")) -> DataFrame:
    """Signed sums of the four condition means: A+B-(C+D) and A+C-(B+D)."""
    mean = lambda c, p: F.avg(F.when(F.col("condition") == c, F.col(f"s.{p}")))
    cols = [sum(k * mean(c, p) for k, c in zip(signs, conditions)).alias(f"{name}_{p}")
            for name, signs in EDIT_CONTRASTS.items() for p in ("re", "im")]
    return fids.groupBy(*keys).agg(*cols)


def intensity_mask(voxels: DataFrame, percentile: float, keys: Sequence[str] = ("subject",), value: str = "value") -> DataFrame:
    """Voxels above the given percentile of the positive voxels."""
    level = quantiles(voxels.where(F.col(value) > 0), keys, value, {"_level": percentile / 100})
    return attach(voxels, level, keys, [value]).where(F.col(value) > F.col("_level")).drop("_level")


def tissue_rule(t1: str = "t1", bpf: str = "bpf") -> Column:
    """Tissue from T1 (s) and bound-pool fraction; fixed thresholds."""
    return (F.when((F.col(t1) > 0.3) & (F.col(t1) < 1.0) & (F.col(bpf) > 0.01), "WM")
            .when((F.col(t1) >= 1.0) & (F.col(t1) < 2.5) & (F.col(bpf) > 0.01), "GM"))


def in_range(values: DataFrame, ranges: DataFrame, on: str = "map") -> DataFrame:
    """Scale each parameter by its unit and keep the open range of its row in ``ranges``."""
    j = values.join(sized_broadcast(ranges), on).withColumn("value", F.col("value") * F.col("scale"))
    return j.where((F.col("value") > F.col("low")) & (F.col("value") < F.col("high"))).drop("scale", "low", "high")


def normalise_weights(edges: DataFrame, key: str = "graph") -> DataFrame:
    """Divide by the largest weight of the graph when that is positive."""
    top = edges.groupBy(key).agg(F.max("weight").alias("_top"))
    return edges.join(top, key).withColumn("weight", F.when(F.col("_top") > 0, F.col("weight") / F.col("_top")).otherwise(
        F.col("weight"))).drop("_top")


def resolve_delays(edges: DataFrame, velocity: float = 7.0) -> DataFrame:
    """Delay as given, else length / velocity (mm per ms), else 0."""
    return edges.withColumn("delay", F.coalesce("delay", F.col("length") / velocity, F.lit(0.0)))


def select_volumes(voxels: DataFrame, volumes: Sequence[int]) -> DataFrame:
    return voxels.where(F.col("vol").isin(list(volumes)))


def reorient(voxels: DataFrame, affine: DataFrame) -> DataFrame:
    """Permute i, j, k so that they follow the world axes.

    ``affine`` has nine rows ``world, axis, a``; every voxel axis goes to the
    world axis of its largest entry.
    """
    best = affine.groupBy("axis").agg(F.max_by("world", F.struct(F.abs("a"), -F.col("world"))).alias("world"))
    at = lambda w: F.max(F.when(F.col("world") == w, F.col("axis"))).alias(f"_a{w}")
    perm = best.agg(at(0), at(1), at(2))
    src = F.array("i", "j", "k")
    out = voxels.join(F.broadcast(perm), how="inner").withColumn("_s", src)
    for w, c in enumerate(("i", "j", "k")):
        out = out.withColumn(c, F.get("_s", F.col(f"_a{w}")))
    return out.drop("_s", "_a0", "_a1", "_a2")


