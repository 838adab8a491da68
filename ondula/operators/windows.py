"""Window operators over series: embeddings, runs, sliding windows, references."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ondula.operators import ordered
from ondula.operators.aggregates import connectivity, ks_statistic
from ondula.operators.attach import attach
from ondula.operators.gram import Rows
from ondula.operators.quantiles import quantiles
from ondula.operators.tiles import pack, squares
from ondula.session import cut

PI = 3.141592653589793


def instantaneous_frequency(phase: DataFrame, fs: float, keys: Sequence[str] = ("recording", "channel"),
                            block: int = ordered.BLOCK) -> DataFrame:
    """Wrapped phase step to the next sample times fs / 2 pi; the last value repeats the one before."""
    d = ordered.neighbour(phase, keys, "t", {"phase": "_next"}, ahead=True, block=block)
    step = F.pmod(F.col("_next") - F.col("phase") + PI, F.lit(2 * PI)) - PI
    d = d.withColumn("freq", step * fs / (2 * PI))
    d = ordered.neighbour(d, keys, "t", {"freq": "_last"}, block=block)
    return d.select(*keys, "t", F.coalesce("freq", "_last").alias("freq"))


def embed(frames: DataFrame, width: int, n_t: int | None = None, key: str = "recording", block: int = ordered.BLOCK) -> DataFrame:
    """Row t becomes [x_t, ..., x_(t+width-1)] over all channels; the last width - 1 rows have no full window."""
    if width < 1 or (n_t is not None and width >= n_t):
        raise ValueError("the embedding must be at least 1 and shorter than the recording")
    out = ordered.frame(frames, [key], "t", 0, width - 1, {"_x": F.collect_list("x")}, block=block)
    return out.where(F.size("_x") == width).select(key, "t", F.flatten("_x").alias("x"))


def delay_tensor(samples: DataFrame, width: int, key: str = "recording") -> DataFrame:
    """The same embedding as a long tensor ``t, lag, channel``."""
    last = samples.groupBy(key).agg(F.max("t").alias("_last"))
    out = samples.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("t", F.col("t") - F.col("lag"))
    return out.join(last, key).where((F.col("t") >= 0) & (F.col("t") + width - 1 <= F.col("_last"))).drop("_last")


def embed_channel(samples: DataFrame, dim: int, tau: int = 1, keys: Sequence[str] = ("recording", "channel"),
                  block: int = ordered.BLOCK) -> DataFrame:
    """One-channel embedding [x_t, x_(t+tau), ...] of ``dim`` values; incomplete rows are dropped."""
    span = (dim - 1) * tau
    out = ordered.frame(samples, keys, "t", 0, span, {"_x": F.collect_list("value")}, block=block)
    pick = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.get("_x", k * tau))
    return out.where(F.size("_x") == span + 1).select(*keys, "t", pick.alias("x"))


# ------------------------------------------------------------------ state runs


def run_lengths(states: DataFrame, key: str = "recording", block: int = ordered.BLOCK) -> DataFrame:
    return ordered.runs(states, [key], "t", "state", block=block)


def _all_states(df: DataFrame, key: str, n_states: int) -> DataFrame:
    return df.select(key).distinct().withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))))


def mean_lifetime(states: DataFrame, n_states: int, fs: float = 1.0, key: str = "recording", block: int = ordered.BLOCK) -> DataFrame:
    """Mean run length per state in seconds; 0 for a state never visited."""
    r = run_lengths(states, key, block).groupBy(key, "state").agg((F.avg("length") / fs).alias("lifetime"))
    return _all_states(states, key, n_states).join(r, [key, "state"], "left").fillna(0.0, ["lifetime"])


def mean_interval(states: DataFrame, n_states: int, fs: float = 1.0, key: str = "recording", block: int = ordered.BLOCK) -> DataFrame:
    """Mean gap between successive visits of a state in seconds; 0 with fewer than two visits."""
    r = run_lengths(states, key, block)
    nxt = ordered.neighbour(r, [key, "state"], "first", {"first": "_next"}, ahead=True, block=block)
    g = nxt.groupBy(key, "state").agg((F.avg(F.col("_next") - F.col("last") - 1) / fs).alias("interval"))
    return _all_states(states, key, n_states).join(g, [key, "state"], "left").fillna(0.0, ["interval"])


def transitions(states: DataFrame, key: str = "recording", block: int = ordered.BLOCK) -> DataFrame:
    """Last index before each state change."""
    n = ordered.neighbour(states, [key], "t", {"state": "_next"}, ahead=True, block=block)
    return n.where("_next IS NOT NULL AND _next <> state").select(key, "t")


# ------------------------------------------------------------- sliding windows


def window_ids(t: Column, width: int, step: int) -> Column:
    """Windows of ``width`` samples every ``step`` that contain sample ``t``."""
    first = F.greatest(F.ceil((t - width + 1) / F.lit(step)), F.lit(0)).cast("bigint")
    last = F.floor(t / F.lit(step)).cast("bigint")
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def slide(df: DataFrame, width: int, step: int, key: str = "recording", order: str = "t") -> DataFrame:
    """Copy each sample to its windows; windows that run past the end are dropped.

    A group of ``(key, win)`` never holds more than ``width`` times.
    """
    last = df.groupBy(key).agg(F.max(order).alias("_last"))
    out = attach(df, last, [key], [order]).withColumn("win", F.explode(window_ids(F.col(order), width, step)))
    out = out.where(F.col("win") * step + width - 1 <= F.col("_last")).drop("_last")
    return out.withColumn("centre", F.col("win") * step + width // 2)


def window_connectivity(frames: DataFrame, width: int, step: int, key: str = "recording") -> DataFrame:
    return connectivity(slide(frames, width, step, key), [key, "win"]).where("i < j")


WINDOWS_PER_TILE = 32
HELD = 64  # tiles that a task holds


def connectivity_dynamics(frames: DataFrame, width: int, step: int, key: str = "recording") -> DataFrame:
    """Pearson between the connectivity patterns of every two windows: ``key, w1, w2, r``.

    Patterns are scaled to unit vectors and packed into tiles of windows. Tiles meet in squares, so a recording is not one key. A task holds the ``HELD`` tiles at
    most of one side of a square while those of the other stream by, so no row holds two tiles; each pair of tiles is one matrix product, and the pairs of a tile
    above the diagonal give those below it too.
    """
    fc = cut(window_connectivity(frames, width, step, key))
    stat = fc.groupBy(key, "win").agg(F.avg("r").alias("_m"), (F.stddev_pop("r") * F.sqrt(F.count("*"))).alias("_n"))
    unit = (F.col("r") - F.col("_m")) / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0)
    rows = fc.join(stat, [key, "win"]).groupBy(key, "win").agg(
        F.sort_array(F.collect_list(F.struct("i", "j", unit.alias("r")))).alias("_c")).select(key, F.col("win").alias("t"), F.col("_c.r").alias("x"))
    tiles = cut(pack(rows, [key], F.floor(F.col("t") / WINDOWS_PER_TILE).cast("int")))  # windows x pairs; read twice below
    side, every = squares(tiles, "blk", HELD)
    kept = [F.col("blk"), F.col("t"), F.col("x")]
    copies = tiles.select(key, side.alias("_row"), every.alias("_col"), F.lit(0).alias("_second"), *kept).unionByName(
        tiles.select(key, every.alias("_row"), side.alias("_col"), F.lit(1).alias("_second"), *kept))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, held = None, []
        for batch in batches:
            places = list(zip(*[batch.column(c).to_pylist() for c in range(5)]))
            times, values = (Rows(batch.column(c)) for c in (5, 6))
            for n, (*here, second, blk) in enumerate(places):
                if here != square:
                    square, held = here, []
                u = times[n]
                y = values[n].reshape(len(u), -1)
                if not second:
                    held.append((blk, u.copy(), y.copy()))
                    continue
                out = []
                for other, t, x in held:
                    if other > blk:
                        break
                    left, right, r = np.repeat(t, len(u)), np.tile(u, len(t)), (x @ y.T).ravel()
                    out += [(left, right, r)] if other == blk else [(left, right, r), (right, left, r)]
                if out:
                    w1, w2, r = (np.concatenate(c) for c in zip(*out))
                    keys = pa.repeat(pa.scalar(here[0], batch.schema.field(0).type), len(r))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(w1), pa.array(w2), pa.array(r)], names=[key, "w1", "w2", "r"])

    by = [key, "_row", "_col"]
    dealt = copies.where(F.col(key).isNotNull()).repartition(*by).sortWithinPartitions(*by, "_second", "blk")
    return dealt.mapInArrow(products, f"`{key}` {tiles.schema[key].dataType.simpleString()}, w1 bigint, w2 bigint, r double")


def dynamics_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """KS distance between the upper triangles of two connectivity-dynamics tables."""
    up = F.col("w1") < F.col("w2")
    return ks_statistic(a.where(up), b.where(up), "r")


def centre_mixing(windows: DataFrame, gamma: DataFrame, key: str = "recording") -> DataFrame:
    """State mixing at the centre sample of each window, clipped to the recording."""
    w = windows.select(key, "win", "centre").distinct()
    last = gamma.groupBy(key).agg(F.max("t").alias("_last"))
    w = w.join(last, key).withColumn("t", F.least("centre", "_last"))
    return w.join(gamma, [key, "t"]).select(key, "win", "state", "p")


# -------------------------------------------------------------------- smoothing


def moving_average(samples: DataFrame, width: int, keys: Sequence[str] = ("recording", "channel"), value: str = "value",
                   block: int = ordered.BLOCK) -> DataFrame:
    """Moving average of the same length with zero padding."""
    before, after = (width - 1) - (width - 1) // 2, (width - 1) // 2
    out = ordered.frame(samples, keys, "t", before, after, {"smooth": F.sum(value)}, block=block)
    return out.withColumn("smooth", F.col("smooth") / width)


def local_network_transition(contributions: DataFrame, target: int, width: int = 5, block: int = ordered.BLOCK) -> DataFrame:
    """First time at which the smoothed sum of the other regions exceeds the target region, else T."""
    is_target = F.col("region") == target
    both = contributions.groupBy("graph", "t").agg(
        F.coalesce(F.sum(F.when(is_target, F.col("value"))), F.lit(0.0)).alias("local"),
        F.coalesce(F.sum(F.when(~is_target, F.col("value"))), F.lit(0.0)).alias("network"))
    if width > 1:
        # same kernel length as a centred convolution with an odd or even window
        before, after = (width - 1) - (width - 1) // 2, (width - 1) // 2
        both = ordered.frame(both, ["graph"], "t", before, after,
                             {"_l": F.sum("local"), "_n": F.sum("network")}, block=block)
    else:
        both = both.withColumn("_l", F.col("local")).withColumn("_n", F.col("network"))
    return both.groupBy("graph").agg(F.coalesce(F.min(F.when(F.col("_n") > F.col("_l"), F.col("t"))),
                                                F.max("t") + 1).alias("transition"))


def baseline_correct(epochs: DataFrame, keys: Sequence[str], time: str = "rel", value: str = "value") -> DataFrame:
    """Subtract the mean of the samples up to time 0 of each epoch and channel."""
    base = F.avg(F.when(F.col(time) <= 0, F.col(value))).over(W.partitionBy(*keys))
    return epochs.withColumn(value, F.col(value) - base)


def global_rank(df: DataFrame, keys: Sequence[str], by: Sequence, name: str = "rank") -> DataFrame:
    """Zero-based rank inside ``keys`` in the order ``by``.

    Range partitions are sorted separately and offset by the sizes of the
    partitions before them, so one key may fill any number of tasks. The
    partitioned rows are written once to keep the range bounds fixed.
    """
    keys = list(keys)
    cols = [F.col(c) if isinstance(c, str) else c for c in by]
    tmp = [f"_o{i}" for i in range(len(cols))]
    tagged = df.select(*df.columns, *[c.alias(n) for c, n in zip(cols, tmp)])
    # no fixed number: adaptive execution merges small neighbouring ranges, which keeps their order
    placed = cut(tagged.repartitionByRange(*keys, *tmp).withColumn("_pid", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "_pid").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(*keys, "_pid", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy(*keys, "_pid").orderBy(*tmp))
    return placed.withColumn("_r", local).join(sizes, [*keys, "_pid"]).select(
        *df.columns, (F.col("_r") - 1 + F.col("_before")).alias(name))


def rank_transform(samples: DataFrame, keys: Sequence[str] = ("recording", "channel"), value: str = "value") -> DataFrame:
    """Rank of each value inside its channel; equal values rank in time order."""
    return global_rank(samples, keys, [value, "t"])


def explained_variance(spectrum: DataFrame, target: float, n_modes: int | None = None) -> DataFrame:
    """Cumulative share of squared singular values and the smallest k that reaches ``target``."""
    w = W.partitionBy("id").orderBy("k")
    whole = W.partitionBy("id")
    share = F.try_divide(F.sum(F.col("s") ** 2).over(w), F.sum(F.col("s") ** 2).over(whole))
    c = spectrum.withColumn("explained", share)
    k = c.groupBy("id").agg((F.coalesce(F.min(F.when(F.col("explained") >= target, F.col("k"))), F.max("k")) + 1).alias("n_keep"))
    return k if n_modes is None else k.withColumn("n_keep", F.least("n_keep", F.lit(n_modes)))


def artifact_times(envelope: DataFrame, threshold: float = 4.0, keys: Sequence[str] = ("recording", "channel")) -> DataFrame:
    """Times at which the envelope of any channel is further than ``threshold`` deviations from its mean."""
    s = envelope.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = (F.col("value") - F.col("_m")) / F.greatest("_s", F.lit(1e-10))
    return attach(envelope, s, keys, ["t"]).groupBy(keys[0], "t").agg(F.bool_or(F.abs(z) > threshold).alias("artifact"))


def robust_reference(samples: DataFrame, key: str = "recording") -> DataFrame:
    """Subtract the mean over channels whose deviation is below three times the median deviation (one pass)."""
    ref = samples.groupBy(key, "t").agg(F.avg("value").alias("_ref"))
    std = samples.join(ref, [key, "t"]).groupBy(key, "channel").agg(F.stddev_pop(F.col("value") - F.col("_ref")).alias("_s"))
    good = std.join(quantiles(std, [key], "_s", {"_med": 0.5}), key).where(F.col("_s") < 3 * F.col("_med")).select(key, "channel")
    clean = samples.join(good, [key, "channel"], "left_semi").groupBy(key, "t").agg(F.avg("value").alias("_g"))
    return samples.join(clean, [key, "t"]).withColumn("value", F.col("value") - F.col("_g")).drop("_g")


def average_reference(frames: DataFrame) -> DataFrame:
    """Subtract the channel mean of each frame."""
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    # the repeated mean is built once per row; inside the lambda it would be summed again per value
    return frames.withColumn("x", F.zip_with("x", F.array_repeat(mean, F.size("x")), lambda v, m: v - m))


def change_points(features: DataFrame, k: float = 2.0, key: str = "recording", order: str = "win",
                  block: int = ordered.BLOCK) -> DataFrame:
    """Distance of each window's feature array to the next and a flag above mean + k deviations."""
    n = ordered.neighbour(features, [key], order, {"x": "_next"}, ahead=True, block=block).where("_next IS NOT NULL")
    sq = F.aggregate(F.zip_with("x", "_next", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    d = n.select(key, order, F.sqrt(sq).alias("distance"))
    s = d.groupBy(key).agg(F.avg("distance").alias("_m"), F.stddev_pop("distance").alias("_s"))
    return d.join(s, key).select(key, order, "distance", (F.col("distance") > F.col("_m") + k * F.col("_s")).alias("change"))


def hann(n: Column, length: int, periodic: bool = False) -> Column:
    return 0.5 * (1 - F.cos(2 * PI * n / (length if periodic else length - 1)))


def overlap_add(windows: DataFrame, width: int, step: int, keys: Sequence[str] = ("recording", "channel"),
                value: str = "value") -> DataFrame:
    """Hann-weighted mean of overlapping windows: sum(w x) / max(sum(w), 1e-10)."""
    w = hann(F.col("t") - F.col("win") * step, width)
    return windows.groupBy(*keys, "t").agg((F.sum(w * F.col(value)) / F.greatest(F.sum(w), F.lit(1e-10))).alias(value))
