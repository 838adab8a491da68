"""Aggregations over samples, frames, voxels, edges and matrices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ondula.operators import ordered
from ondula.operators.attach import attach, sized_broadcast
from ondula.operators.gram import gram, partial_sums
from ondula.operators.quantiles import part_of, quantiles, small_median_mad, splitters
from ondula.session import cut

# ---------------------------------------------------------------- connectivity

FLAT = 1e-26  # a centred variance below this share of the mean square is rounding noise of a constant channel


def correlation_of(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pearson cells from covariance cells; constant channels give 0, their diagonal too."""
    keys = list(keys)
    var = F.when((F.col("i") == F.col("j")) & (F.col("cov") > FLAT * F.col("s2")), F.col("cov"))
    v = moments.withColumn("_vi", F.max(var).over(W.partitionBy(*keys, "i")))
    v = v.withColumn("_vj", F.max(var).over(W.partitionBy(*keys, "j")))
    return v.select(*keys, "i", "j", F.coalesce(
        F.col("cov") / F.sqrt(F.col("_vi") * F.col("_vj")), F.lit(0.0)).alias("r"))


def connectivity(frames: DataFrame, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Pearson matrix over time as cells ``keys, i, j, r``."""
    return correlation_of(gram(frames, keys), keys)


def static_connectivity(sessions: Sequence[DataFrame]) -> DataFrame:
    """Pearson matrix over concatenated sessions."""
    whole = sessions[0]
    for s in sessions[1:]:
        whole = whole.unionByName(s)
    return connectivity(whole.withColumn("recording", F.lit("static")))


def channel_summary(frames: DataFrame, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Mean, population deviation and mean absolute connectivity per channel, from one pass."""
    keys = list(keys)
    m = gram(frames, keys)
    r = correlation_of(m, keys).where("i <> j").groupBy(*keys, "i").agg(F.avg(F.abs("r")).alias("mean_abs_r"))
    d = m.where("i = j").select(*keys, "i", F.col("mean_i").alias("mean"), F.sqrt(F.greatest("cov", F.lit(0.0))).alias("std"))
    return d.join(r, [*keys, "i"])


def matrix_correlation(a: DataFrame, b: DataFrame, value: str = "r") -> DataFrame:
    """Pearson between the upper triangles of two matrices."""
    up = F.col("i") < F.col("j")
    left = a.where(up).select("i", "j", F.col(value).alias("_a"))
    right = b.where(up).select("i", "j", F.col(value).alias("_b"))
    return left.join(right, ["i", "j"]).agg(F.coalesce(F.corr("_a", "_b"), F.lit(0.0)).alias("r"))


def sample_covariance(frames: DataFrame, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Centred covariance divided by n - 1."""
    return gram(frames, keys).withColumn("cov", F.col("cov") * F.col("n") / (F.col("n") - 1))


def second_moment_template(frames: DataFrame, subject: str = "recording") -> DataFrame:
    """Mean over subjects of the uncentred second moment."""
    return gram(frames, [subject]).groupBy("i", "j").agg(F.avg("s2").alias("v"))


# ---------------------------------------------------------- mutual information


def _bin_codes(frames: DataFrame, keys: list[str], bins: int) -> DataFrame:
    per = frames.select(*keys, F.posexplode("x").alias("c", "v")).groupBy(*keys, "c").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"))
    edges = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("c", "lo", "hi"))).alias("_e"))

    def code(v: Column, e: Column) -> Column:
        width = e["hi"] - e["lo"]
        return F.when(width > 0, F.least(F.floor((v - e["lo"]) / width * bins), F.lit(bins - 1))).otherwise(
            F.lit(bins // 2)).cast("double")

    return attach(frames, edges, keys, ["x"]).select(*keys, F.zip_with("x", "_e", code).alias("code"))


def joint_histograms(frames: DataFrame, keys: Sequence[str] = ("recording",), bins: int = 16) -> DataFrame:
    """Counts of every pair of channels in equal-width bins, the last bin closed."""
    keys = list(keys)

    def kernel(codes: np.ndarray) -> np.ndarray:
        n, c = codes.shape
        hot = np.zeros((n, c * bins))
        hot[np.arange(n)[:, None], np.arange(c) * bins + codes.astype(int)] = 1.0
        return hot.T @ hot

    cells = partial_sums(_bin_codes(frames, keys, bins), keys, ["code"], kernel).where("v > 0")
    return cells.select(*keys, F.floor(F.col("i") / bins).cast("int").alias("i"),
                        F.floor(F.col("j") / bins).cast("int").alias("j"),
                        (F.col("i") % bins).alias("a"), (F.col("j") % bins).alias("b"), F.col("v").alias("n"))


def mutual_information(frames: DataFrame, keys: Sequence[str] = ("recording",), bins: int = 16) -> DataFrame:
    """Histogram mutual information of all channel pairs, the pair with itself included (nats)."""
    keys = list(keys)
    pair = [*keys, "i", "j"]
    h = joint_histograms(frames, keys, bins)
    tot = F.sum("n").over(W.partitionBy(*pair))
    pa, pb = F.sum("n").over(W.partitionBy(*pair, "a")), F.sum("n").over(W.partitionBy(*pair, "b"))
    h = h.withColumn("_n", tot).withColumn("_a", pa).withColumn("_b", pb)
    term = F.col("n") / F.col("_n") * F.log(F.col("n") * F.col("_n") / (F.col("_a") * F.col("_b")))
    return h.groupBy(*pair).agg(F.sum(term).alias("mi"))


def labeling_nmi(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information of two labelings (arithmetic mean of the entropies)."""
    c = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    one = F.lit(1)
    tot = F.sum("n").over(W.partitionBy(one))
    c = c.withColumn("_n", tot).withColumn("_a", F.sum("n").over(W.partitionBy(a))).withColumn(
        "_b", F.sum("n").over(W.partitionBy(b)))
    p = F.col("n") / F.col("_n")
    out = c.agg(F.sum(p * F.log(F.col("n") * F.col("_n") / (F.col("_a") * F.col("_b")))).alias("mi"),
                (-F.sum(p * F.log(F.col("_a") / F.col("_n")))).alias("ha"),
                (-F.sum(p * F.log(F.col("_b") / F.col("_n")))).alias("hb"))
    h = F.col("ha") + F.col("hb")
    return out.select(F.when(h > 0, 2 * F.col("mi") / h).otherwise(F.lit(1.0)).alias("nmi"))


# ------------------------------------------------------------ region statistics


def valid_values(df: DataFrame, value: str = "value", low: float | None = None, high: float | None = None) -> DataFrame:
    """Finite, non-zero values inside ``[low, high]``."""
    v = F.col(value)
    ok = v.isNotNull() & ~F.isnan(v) & (v != 0) & (F.abs(v) != float("inf"))
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    return df.where(ok)


def region_stats(values: DataFrame, keys: Sequence[str], value: str = "value", least: int = 5) -> DataFrame:
    """Mean, median, population deviation, 5th and 95th percentile and count per region."""
    keys = list(keys)
    values = cut(values.select(*keys, value))  # read twice; the joins before it are run once
    return quantiles(values, keys, value, {"p5": 0.05, "median": 0.5, "p95": 0.95}, also=_basic(value)).where(F.col("n") >= least)


def _basic(value: str) -> list[Column]:
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n")]


def tissue_stats(values: DataFrame, tissues: DataFrame, keys: Sequence[str], value: str = "value",
                 least: int = 10) -> DataFrame:
    """Statistics per tissue; a tissue with fewer than ``least`` values keeps NULLs and n = 0."""
    keys = list(keys)
    values = cut(values.select(*keys, value))
    got = quantiles(values, keys, value, {"median": 0.5}, also=_basic(value))
    out = tissues.select(*keys).distinct().join(got, keys, "left")
    enough = F.col("n") >= least
    return out.select(*keys, *[F.when(enough, F.col(c)).alias(c) for c in ("mean", "median", "std")],
                      F.when(enough, F.col("n")).otherwise(F.lit(0)).alias("n"))


def tool_comparison(stats: DataFrame, tissue: str, tool: str, tools: Sequence[str]) -> DataFrame:
    """Tissue x tool statistics side by side."""
    return stats.groupBy(tissue).pivot(tool, list(tools)).agg(F.first("mean").alias("mean"), F.first("n").alias("n"))


def segmentation_summary(seg: DataFrame, dim: DataFrame, voxel_mm3: float = 1.0) -> DataFrame:
    """Voxels, volume, name and conductivity per label; labels without a name stay."""
    counts = seg.groupBy("label_id").agg(F.count("*").alias("voxels"))
    return counts.join(dim, "label_id", "left").select(
        "label_id", "voxels", (F.col("voxels") * voxel_mm3).alias("volume_mm3"),
        F.coalesce("name", F.concat(F.lit("label_"), F.col("label_id"))).alias("name"),
        F.coalesce("sigma", F.lit(0.0)).alias("sigma"))


def surface_means(vertices: DataFrame, roi: str, value: str, more: int = 10, valid: int = 5) -> DataFrame:
    """Mean, deviation and count of the non-zero vertices of a region; region 0 is skipped."""
    v = F.when((F.col(value) != 0) & ~F.isnan(value), F.col(value))
    return vertices.where(F.col(roi) != 0).groupBy(roi).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"),
        F.count("*").alias("_all")).where((F.col("_all") > more) & (F.col("n") > valid)).drop("_all")


def tissue_snr(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return values.groupBy(*keys).agg(
        F.round(F.avg(value) / F.greatest(F.stddev_pop(value), F.lit(1e-10)), 2).alias("snr"))


def euler_number(vertices: DataFrame, faces: DataFrame, key: str = "mesh") -> DataFrame:
    """V - E + F with E = 3F / 2 (integer part)."""
    v = vertices.groupBy(key).agg(F.count("*").alias("_v"))
    f = faces.groupBy(key).agg(F.count("*").alias("_f"))
    return v.join(f, key).select(key, (F.col("_v") - F.floor(3 * F.col("_f") / 2) + F.col("_f")).alias("euler"))


# ------------------------------------------------------------- state statistics


def occupancy(states: DataFrame, key: str, state: str, n_states: int) -> DataFrame:
    """Share of time in each of the states 0 .. n_states - 1; a state never visited has 0."""
    n = states.groupBy(key, state).agg(F.count("*").alias("_n"))
    total = n.groupBy(key).agg(F.sum("_n").alias("_t"))
    full = total.withColumn(state, F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))))
    return full.join(n, [key, state], "left").select(
        key, state, (F.coalesce("_n", F.lit(0)) / F.col("_t")).alias("occupancy"))


def soft_occupancy(gamma: DataFrame, keys: Sequence[str]) -> DataFrame:
    return gamma.groupBy(*keys).agg(F.avg("p").alias("occupancy"))


def switching_rate(states: DataFrame, key: str = "recording", order: str = "t", state: str = "state",
                   fs: float = 1.0, block: int = ordered.BLOCK) -> DataFrame:
    """State changes per second: changes / (T - 1) * fs."""
    prev = ordered.neighbour(states, [key], order, {state: "_prev"}, block=block)
    moved = F.when(F.col("_prev").isNotNull(), (F.col("_prev") != F.col(state)).cast("int"))
    return prev.groupBy(key).agg((F.coalesce(F.avg(moved), F.lit(0.0)) * fs).alias("switching_rate"))


# ------------------------------------------------------------- evoked responses


def population_std(x: str | Column) -> Column:
    """Population deviation of an array column in one fold over its values."""
    x = F.col(x) if isinstance(x, str) else x
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def step(a: Column, v: Column) -> Column:
        mean = a["m"] + (v - a["m"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("m"), (a["q"] + (v - a["m"]) * (v - mean)).alias("q"))

    return F.aggregate(x, zero, step, lambda a: F.sqrt(a["q"] / a["n"]))


def field_power(frames: DataFrame) -> DataFrame:
    """Deviation across channels at each time."""
    return frames.select("recording", "t", population_std("x").alias("gfp"))


def waveform_loss(a: DataFrame, b: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    left = a.select(*on, F.col(value).alias("_a"))
    right = b.select(*on, F.col(value).alias("_b"))
    return left.join(right, list(on)).agg(F.avg(F.pow(F.col("_a") - F.col("_b"), 2)).alias("loss"))


def evoked_loss(a: DataFrame, b: DataFrame, channel: str = "channel", order: str = "t",
                w_wave: float = 1.0, w_power: float = 0.5) -> DataFrame:
    """Weighted waveform and field-power loss of two evoked tables, from one join."""
    j = a.select(channel, order, F.col("value").alias("_a")).join(
        b.select(channel, order, F.col("value").alias("_b")), [channel, order])
    per = j.groupBy(order).agg(F.avg(F.pow(F.col("_a") - F.col("_b"), 2)).alias("_m"), F.count("*").alias("_n"),
                               F.stddev_pop("_a").alias("_ga"), F.stddev_pop("_b").alias("_gb"))
    out = per.agg((F.sum(F.col("_m") * F.col("_n")) / F.sum("_n")).alias("waveform"),
                  F.avg(F.pow(F.col("_ga") - F.col("_gb"), 2)).alias("field_power"))
    return out.withColumn("loss", w_wave * F.col("waveform") + w_power * F.col("field_power"))


def contrast(samples: DataFrame, keys: Sequence[str], condition: str, a, b, value: str = "value") -> DataFrame:
    """Condition mean A - B."""
    m = lambda c: F.avg(F.when(F.col(condition) == c, F.col(value)))
    return samples.groupBy(*keys).agg((m(a) - m(b)).alias("contrast"))


# --------------------------------------------------------- two samples, p-values


def ks_statistic(a: DataFrame, b: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Largest gap between two empirical distributions on the pooled points.

    Counts per distinct value first, then running counts in parts of about equal numbers of values, so ties and large samples never meet in one
    task, however the values are spread.
    """
    part = ["_k", *keys]
    v = a.select(*keys, F.col(value).alias("_v"), F.lit(1).alias("_na"), F.lit(0).alias("_nb")).unionByName(
        b.select(*keys, F.col(value).alias("_v"), F.lit(0).alias("_na"), F.lit(1).alias("_nb")))
    v = v.withColumn("_k", F.lit(0))
    c = cut(v.groupBy(*part, "_v").agg(F.sum("_na").alias("_na"), F.sum("_nb").alias("_nb")))
    span = c.groupBy(*part).agg(F.sum("_na").alias("_ta"), F.sum("_nb").alias("_tb"))
    c = attach(c, span.join(splitters(c, part, "_v"), part), part, ["_v"]).withColumn("_blk", part_of(F.col("_v"), F.col("_splits"))).drop("_splits")
    before = W.partitionBy(*part).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    tot = c.groupBy(*part, "_blk").agg(F.sum("_na").alias("_a"), F.sum("_nb").alias("_b")).select(
        *part, "_blk", F.coalesce(F.sum("_a").over(before), F.lit(0)).alias("_pa"),
        F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_pb"))
    w = W.partitionBy(*part, "_blk").orderBy("_v")
    c = c.withColumn("_ca", F.sum("_na").over(w)).withColumn("_cb", F.sum("_nb").over(w)).join(tot, [*part, "_blk"])
    gap = F.abs((F.col("_ca") + F.col("_pa")) / F.col("_ta") - (F.col("_cb") + F.col("_pb")) / F.col("_tb"))
    return c.groupBy(*part).agg(F.max(gap).alias("ks")).drop("_k")


def permutation_p(null: DataFrame, observed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of null values at or above the observed one (no +1)."""
    keys = list(keys)
    one = F.lit(0).alias("_k")
    j = attach(null.select(*keys, one, F.col("value").alias("_null")), observed.select(*keys, one, F.col("value").alias("observed")), ["_k", *keys], ["_null"])
    return j.groupBy("_k", *keys).agg(
        F.first("observed").alias("observed"),
        F.avg((F.col("_null") >= F.col("observed")).cast("double")).alias("p")).drop("_k")


def run_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("optimizer").agg(
        F.avg("fitness").alias("mean_fitness"), F.stddev_pop("fitness").alias("std_fitness"),
        F.max("fitness").alias("max_fitness"), F.avg("wall_time").alias("mean_time"),
        F.avg("evals").alias("mean_evals"), F.count("*").alias("n"))


# ------------------------------------------------------------------- transients


def average_edits(fids: DataFrame, keys: Sequence[str] = ("acq",)) -> DataFrame:
    """Mean transient per edit condition, their difference and sum; ``n_used`` is the smaller count."""
    keys = list(keys)
    m = lambda part, e: F.avg(F.when(F.col("edit") == e, F.col(f"s.{part}")))
    n = lambda e: F.count_distinct(F.when(F.col("edit") == e, F.col("dyn")))
    per = fids.groupBy(*keys, "n").agg(m("re", 1).alias("on_re"), m("im", 1).alias("on_im"),
                                       m("re", 0).alias("off_re"), m("im", 0).alias("off_im"),
                                       F.least(n(1), n(0)).alias("n_used"))
    return per.select(*keys, "n", "on_re", "on_im", "off_re", "off_im", "n_used",
                      *[(F.col(f"on_{p}") - F.col(f"off_{p}")).alias(f"diff_{p}") for p in ("re", "im")],
                      *[(F.col(f"on_{p}") + F.col(f"off_{p}")).alias(f"sum_{p}") for p in ("re", "im")])


def transient_outliers(fids: DataFrame, keys: Sequence[str] = ("acq", "edit"), threshold: float = 3.0) -> DataFrame:
    """Robust z of each transient's residual to the mean transient, and the reject flag."""
    keys = list(keys)
    flat = fids.select(*keys, "dyn", "n", F.col("s.re").alias("re"), F.col("s.im").alias("im"))
    mean = flat.groupBy(*keys, "n").agg(F.avg("re").alias("_mr"), F.avg("im").alias("_mi"))
    res = flat.join(mean, [*keys, "n"]).groupBy(*keys, "dyn").agg(
        F.sqrt(F.avg(F.pow(F.col("re") - F.col("_mr"), 2) + F.pow(F.col("im") - F.col("_mi"), 2))).alias("residual"))
    mm = small_median_mad(res, keys, "residual")
    z = 0.6745 * (F.col("residual") - F.col("med")) / (F.col("mad") + 1e-10)
    return res.join(mm, keys).select(*keys, "dyn", "residual", z.alias("z"), (F.abs(z) > threshold).alias("rejected"))


# -------------------------------------------------------------- quality control


def channel_std(samples: DataFrame, keys: Sequence[str] = ("recording",)) -> DataFrame:
    return samples.groupBy(*keys, "channel").agg(F.stddev_pop("value").alias("std"))


def variance_outliers(samples: DataFrame, keys: Sequence[str] = ("recording",), k: float = 5.0) -> DataFrame:
    """Channels with variance above median + k * 1.4826 * MAD of the recording."""
    keys = list(keys)
    v = samples.groupBy(*keys, "channel").agg(F.var_pop("value").alias("variance"))
    mm = small_median_mad(v, keys, "variance")
    return v.join(mm, keys).where(F.col("variance") > F.col("med") + k * 1.4826 * F.col("mad")).select(
        *keys, "channel", "variance")


def std_quality(stds: DataFrame, key: str = "recording", k: float = 3.0) -> DataFrame:
    """Noisy and flat channels of each recording. One recording has few channels, so names are listed."""
    agg = stds.groupBy(key).agg(F.avg("std").alias("std_mean"), F.stddev_pop("std").alias("std_std"))
    mm = small_median_mad(stds, [key], "std")
    base = stds.join(agg, key).join(mm, key)
    noisy = F.col("std") > F.col("std_mean") + k * F.col("std_std")
    floor = F.greatest(F.col("med") - k * F.greatest(F.col("mad"), 0.01 * F.col("med")), F.lit(0.0))
    flat = F.col("std") < floor
    return base.groupBy(key).agg(
        F.first("std_mean").alias("std_mean"), F.first("std_std").alias("std_std"),
        F.sort_array(F.collect_list(F.when(noisy, F.col("channel")))).alias("noisy_channels"),
        F.sort_array(F.collect_list(F.when(flat, F.col("channel")))).alias("flat_channels"),
        F.count(F.when(noisy, 1)).alias("n_noisy"), F.count(F.when(flat, 1)).alias("n_flat"))


def line_noise(spectra: DataFrame, key: str, lines: Sequence[float] = (50.0, 60.0), width: float = 2.0) -> DataFrame:
    """Share of channel-mean power around the line frequencies, the strongest line and the 5 % flag."""
    psd = spectra.groupBy(key, "freq").agg(F.avg("power").alias("power"))
    share = lambda f: F.try_divide(F.sum(F.when(F.col("freq").between(f - width / 2, f + width / 2), F.col("power"))), F.sum("power"))
    best = F.array_max(F.array(*[F.struct(share(f).alias("s"), F.lit(-f).alias("f")) for f in lines]))
    out = psd.groupBy(key).agg(best.alias("_b"))
    s = F.coalesce(F.col("_b.s"), F.lit(0.0))
    return out.select(key, F.when(s > 0, -F.col("_b.f")).otherwise(F.lit(0.0)).alias("line_freq"),
                      s.alias("line_power"), (s > 0.05).alias("has_line_noise"))


def artifact_share(annotations: DataFrame, durations: DataFrame, key: str, text: str = "BAD_muscle") -> DataFrame:
    """Annotated time over total time, 0 for an empty recording."""
    a = annotations.where(F.col("description").contains(text)).groupBy(key).agg(F.sum("duration").alias("_d"))
    return durations.join(a, key, "left").select(key, F.when(
        F.col("total") > 0, F.coalesce("_d", F.lit(0.0)) / F.col("total")).otherwise(F.lit(0.0)).alias("muscle_fraction"))


def event_rate(events: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """Events per minute, 0 for an empty recording; durations in seconds."""
    n = events.groupBy(key).agg(F.count("*").alias("n_events"))
    return durations.join(n, key, "left").select(
        key, F.coalesce("n_events", F.lit(0)).alias("n_events"),
        F.when(F.col("total") > 0, F.coalesce("n_events", F.lit(0)) / (F.col("total") / 60)).otherwise(
            F.lit(0.0)).alias("rate_per_min"))


def quality_index() -> Column:
    """Mean of the channel, line, heart and muscle scores."""
    channels = 1.0 - F.least(F.col("n_noisy") + F.col("n_flat"), F.lit(30)) / 30.0
    line = F.when(F.col("has_line_noise"), 0.0).otherwise(1.0)
    rate = F.col("heart_rate")
    heart = F.when((rate > 50) & (rate < 100), 1.0).otherwise(0.5)
    muscle = F.greatest(F.lit(0.0), 1.0 - F.col("muscle_fraction") * 5)
    return (channels + line + heart + muscle) / 4


def quality_report(stds: DataFrame, line: DataFrame, heart: DataFrame, muscle: DataFrame, key: str) -> DataFrame:
    """All quality measures of a recording in one row."""
    out = std_quality(stds, key).join(line, key, "left").join(
        heart.select(key, F.col("rate_per_min").alias("heart_rate")), key, "left").join(muscle, key, "left")
    out = out.fillna({"has_line_noise": False, "muscle_fraction": 0.0, "heart_rate": 0.0})
    return out.withColumn("quality", quality_index())


# ------------------------------------------------------------- signals and bands


def recovery(clean: DataFrame, original: DataFrame, injected: DataFrame, scenario: Sequence[str] = (),
             on: Sequence[str] = ("recording", "channel", "t")) -> DataFrame:
    """How well an injected signal survives: correlation, SNR, error, amplitude ratio, distortion.

    Tables meet on the columns of ``on`` that they have: an ``injected`` signal
    without a recording goes into every recording. A series is what ``clean``
    has of ``on`` but its last; correlations are averaged over series.
    """
    sc, on = list(scenario), [c for c in on if c in clean.columns]
    inj_keys = [c for c in [*sc, *on] if c in injected.columns]
    j = clean.select(*sc, *on, F.col("value").alias("_c")).join(
        original.select(*[c for c in [*sc, *on] if c in original.columns], F.col("value").alias("_o")),
        [c for c in [*sc, *on] if c in original.columns]).join(
        injected.select(*inj_keys, F.col("value").alias("inj")), inj_keys)
    j = j.withColumn("rec", F.col("_c") - F.col("_o")).withColumn("_k", F.lit(0))
    ch = j.groupBy("_k", *sc, *on[:-1]).agg(
        F.when((F.stddev_pop("inj") > 0) & (F.stddev_pop("rec") > 0), F.corr("inj", "rec")).alias("r"),
        F.sum(F.col("inj") ** 2).alias("pi"), F.sum(F.col("rec") ** 2).alias("pr"),
        F.sum((F.col("rec") - F.col("inj")) ** 2).alias("pn"), F.count("*").alias("n"))
    g = ch.groupBy("_k", *sc).agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("correlation"),
                                  *[(F.sum(c) / F.sum("n")).alias(c) for c in ("pi", "pr", "pn")])
    return g.select(*sc, "correlation",
                    (10 * F.log10(F.col("pi") / F.greatest("pn", F.lit(1e-30)))).alias("snr_db"),
                    F.sqrt("pn").alias("rmse"),
                    F.sqrt(F.col("pr") / F.greatest("pi", F.lit(1e-30))).alias("amplitude_ratio"),
                    (1 - F.col("correlation")).alias("distortion"))


def band_power(spectra: DataFrame, bands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trapezoid integral of the channel-mean spectrum inside each ``(band, fmin, fmax)``."""
    keys = list(keys)
    psd = spectra.groupBy(*keys, "freq").agg(F.avg("power").alias("p"))
    inside = psd.join(sized_broadcast(bands), (F.col("freq") >= F.col("fmin")) & (F.col("freq") <= F.col("fmax")))
    w = W.partitionBy(*keys, "band").orderBy("freq")
    area = (F.col("p") + F.lag("p").over(w)) / 2 * (F.col("freq") - F.lag("freq").over(w))
    return inside.withColumn("_a", area).groupBy(*keys, "band").agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("power"))


def band_mean_power(logs: DataFrame, key: str, fmin: float, fmax: float) -> DataFrame:
    """Mean of 10^(log power) inside the band."""
    return logs.where(F.col("freq").between(fmin, fmax)).groupBy(key).agg(
        F.avg(F.pow(F.lit(10.0), F.col("logp"))).alias("power"))


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Smallest value at which the cumulative weight reaches half of the total."""
    keys = ["_k", *keys]
    c = cut(df.withColumn("_k", F.lit(0)).groupBy(*keys, value).agg(F.sum(weight).alias("_w")))
    span = c.groupBy(*keys).agg(F.sum("_w").alias("_t")).join(splitters(c, keys, value), keys)
    c = attach(c, span, keys, [value]).withColumn("_blk", part_of(F.col(value), F.col("_splits"))).drop("_splits")
    tot = c.groupBy(*keys, "_blk").agg(F.sum("_w").alias("_b")).select(*keys, "_blk", F.coalesce(F.sum("_b").over(
        W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.sum("_w").over(W.partitionBy(*keys, "_blk").orderBy(value))
    c = c.withColumn("_c", inner).join(tot, [*keys, "_blk"])
    return c.where(F.col("_c") + F.col("_before") >= F.col("_t") / 2).groupBy(*keys).agg(
        F.min(value).alias("weighted_median")).drop("_k")


def block_average(series: DataFrame, key: str, order: str = "t", value: str = "value",
                  block: int = ordered.BLOCK) -> DataFrame:
    """Split frames at gaps over 1.5 median steps and average the equal-length blocks frame by frame."""
    prev = ordered.neighbour(series, [key], order, {order: "_pt"}, block=block).withColumn("_d", F.col(order) - F.col("_pt"))
    prev = cut(prev)  # read by every step of the quantile and again below
    med = quantiles(prev, [key], "_d", {"_med": 0.5})
    gap = F.coalesce((F.col("_d") > 1.5 * F.col("_med")).cast("int"), F.lit(0))
    marked = prev.join(med, key, "left").withColumn("_gap", gap)
    ids = ordered.running(marked, [key], order, "_gap", "_b", block=block)
    ids = cut(ordered.running(ids, [key, "_b"], order, F.lit(1), "frame", block=block))
    length = ids.groupBy(key, "_b").agg(F.count("*").alias("_len"))
    first = length.where("_b = 0").select(key, F.col("_len").alias("_first"))
    same = length.join(first, key).where("_len = _first").select(key, "_b")
    return ids.join(same, [key, "_b"]).groupBy(key, (F.col("frame") - 1).alias("frame")).agg(
        F.avg(value).alias("value"), F.count("*").alias("blocks"))


def circular_stats(angles: DataFrame, keys: Sequence[str], phase: str = "phase") -> DataFrame:
    """Circular mean, circular variance and Rayleigh z."""
    a = angles.groupBy(*keys).agg(F.avg(F.cos(phase)).alias("_c"), F.avg(F.sin(phase)).alias("_s"), F.count("*").alias("n"))
    r = F.hypot("_c", "_s")
    return a.select(*keys, F.atan2("_s", "_c").alias("circular_mean"), (1 - r).alias("circular_variance"),
                    (F.col("n") * r * r).alias("rayleigh_z"))


def normal_loglik(residuals: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Log-likelihood of residuals under N(0, their own deviation), per group."""
    s = residuals.groupBy(*keys).agg(F.count(value).alias("n"), F.stddev_pop(value).alias("sd"),
                                     F.sum(F.col(value) ** 2).alias("rss"))
    ll = -0.5 * F.col("n") * F.log(2 * np.pi * F.col("sd") ** 2) - F.try_divide(F.col("rss"), 2 * F.col("sd") ** 2)
    return s.select(*keys, ll.alias("loglik"))


def state_fit_vector(fits: DataFrame, key: str = "state") -> DataFrame:
    """Mean and deviation of positive exponents and peak frequencies, mean power and fit quality."""
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return fits.groupBy(key).agg(
        z(F.avg(pos("exponent"))).alias("mean_exponent"), z(F.stddev_pop(pos("exponent"))).alias("std_exponent"),
        z(F.avg(pos("peak_freq"))).alias("mean_peak"), z(F.stddev_pop(pos("peak_freq"))).alias("std_peak"),
        F.avg("peak_power").alias("mean_power"), F.avg("r_squared").alias("mean_r2"))


def band_peaks(peaks: DataFrame, key: str) -> DataFrame:
    """Strongest peak in 7-13 and in (13, 30]."""
    alpha = F.col("freq").between(7, 13)
    beta = (F.col("freq") > 13) & (F.col("freq") <= 30)
    pick = lambda cond: F.max_by(F.when(cond, F.col("freq")), F.when(cond, F.struct("power", -F.col("freq"))))
    return peaks.groupBy(key).agg(pick(alpha).alias("alpha_peak"), pick(beta).alias("beta_peak"))


def imaginary_coherence(series: DataFrame, reference, channel: str = "channel", order: str = "t",
                        key: str = "recording") -> DataFrame:
    """Im(mean(x conj ref)) / sqrt(Px Pref + 1e-12) of complex series ``s``."""
    ref = series.where(F.col(channel) == reference).select(key, order, F.col("s.re").alias("_r"), F.col("s.im").alias("_i"))
    j = series.select(key, channel, order, F.col("s.re").alias("re"), F.col("s.im").alias("im")).join(ref, [key, order])
    p = lambda a, b: F.avg(F.col(a) ** 2 + F.col(b) ** 2)
    return j.groupBy(key, channel).agg(
        (F.avg(F.col("im") * F.col("_r") - F.col("re") * F.col("_i")) /
         F.sqrt(p("re", "im") * p("_r", "_i") + 1e-12)).alias("icoh"))


def common_correlation(a: DataFrame, b: DataFrame, on: Sequence[str], least: int, value: str = "value",
                       clean: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson over the rows both tables have; nothing when fewer than ``least``."""
    fine = (lambda d: valid_values(d, value)) if clean else (lambda d: d)
    on, keys = list(on), list(keys)
    j = fine(a).select(*on, F.col(value).alias("_a")).join(fine(b).select(*on, F.col(value).alias("_b")), on)
    return j.groupBy(*keys).agg(F.corr("_a", "_b").alias("r"), F.count("*").alias("n")).where(F.col("n") >= least)


def component_regressor_correlation(components: DataFrame, regressors: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Pearson of each component with each regressor, and the largest magnitude, strongest first.

    Time courses of several recordings meet within their recording; regressors without one hold for all.
    """
    at = _shared(components, regressors, ["recording", "t"])
    j = components.select("component", *at, "value").join(regressors.select("condition", *at, F.col("value").alias("_x")), at)
    r = j.groupBy("component", "condition").agg(F.round(F.corr("value", "_x"), 4).alias("r"))
    best = r.groupBy("component").agg(F.max(F.abs("r")).alias("max_abs_corr"))
    wide = r.groupBy("component").pivot("condition", list(conditions)).agg(F.first("r"))
    for c in conditions:
        wide = wide.withColumnRenamed(c, f"corr_{c}")
    return wide.join(best, "component").orderBy(F.desc("max_abs_corr"), "component")


def _shared(a: DataFrame, b: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if c in a.columns and c in b.columns]


def best_component(components: DataFrame, target: DataFrame, on: str) -> DataFrame:
    """Component with the largest absolute correlation to a map or time course, within recordings where both tables have them."""
    at = _shared(components, target, ["recording", on])
    j = components.select("component", *at, "value").join(target.select(*at, F.col("value").alias("_x")), at)
    r = j.groupBy("component").agg(F.corr("value", "_x").alias("r"))
    return r.agg(F.max_by(F.struct("component", "r"), F.struct(F.abs("r"), -F.col("component"))).alias("_b")).select("_b.*")


def best_component_by_band(spectra: DataFrame, freq: float, width: float = 2.0) -> DataFrame:
    """Component with the largest share of power inside ``freq`` ± ``width``."""
    band = F.sum(F.when(F.col("freq").between(freq - width, freq + width), F.col("power")))
    r = spectra.groupBy("component").agg((F.coalesce(band, F.lit(0.0)) / (F.sum("power") + 1e-12)).alias("ratio"))
    return r.agg(F.max_by(F.struct("component", "ratio"), F.struct("ratio", -F.col("component"))).alias("_b")).select("_b.*")


# ---------------------------------------------------------------- matrix tables


def multiply(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Matrix product of two cell tables ``keys, i, j, v``."""
    keys = list(keys)
    left = a.select(*keys, "i", F.col("j").alias("_k"), F.col("v").alias("_a"))
    right = b.select(*keys, F.col("i").alias("_k"), "j", F.col("v").alias("_b"))
    return left.join(right, [*keys, "_k"]).groupBy(*keys, "i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def resolution_metrics(m: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Diagonal, peak shift of each column and off-diagonal energy by column and row."""
    keys = list(keys)
    off = F.when(F.col("i") != F.col("j"), F.col("v") ** 2).otherwise(0.0)
    col = m.groupBy(*keys, F.col("j").alias("source")).agg(
        F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("amplitude"),
        F.max_by("i", F.struct(F.abs("v"), -F.col("i"))).alias("_peak"), F.sum(off).alias("spread"))
    row = m.groupBy(*keys, F.col("i").alias("source")).agg(F.sum(off).alias("leakage"))
    return col.join(row, [*keys, "source"]).select(
        *keys, "source", "amplitude", F.abs(F.col("_peak") - F.col("source")).alias("peak_error"), "spread", "leakage")


def source_power(w: DataFrame, cov: DataFrame) -> DataFrame:
    """diag(W C W^T) for given weights; ``cov`` has cells ``i, j, v``."""
    a = w.select(F.col("i").alias("source"), F.col("j").alias("_a"), F.col("v").alias("_wa"))
    b = w.select(F.col("i").alias("source"), F.col("j").alias("_b"), F.col("v").alias("_wb"))
    c = cov.select(F.col("i").alias("_a"), F.col("j").alias("_b"), F.col("v").alias("_c"))
    half = a.join(c, "_a").groupBy("source", "_b").agg(F.sum(F.col("_wa") * F.col("_c")).alias("_h"))
    return half.join(b, ["source", "_b"]).groupBy("source").agg(F.sum(F.col("_h") * F.col("_wb")).alias("power"))


def noise_norm(w: DataFrame, noise: DataFrame) -> DataFrame:
    return source_power(w, noise).select("source", F.sqrt(F.greatest("power", F.lit(1e-20))).alias("norm"))


def unit_noise_gain(w: DataFrame, noise: DataFrame) -> DataFrame:
    return w.join(noise_norm(w, noise).withColumnRenamed("source", "i"), "i").select(
        "i", "j", (F.col("v") / F.col("norm")).alias("v"))


def power_contrast(w: DataFrame, active: DataFrame, control: DataFrame) -> DataFrame:
    """(P_active - P_control) / max(P_control, 1e-20)."""
    a = source_power(w, active).withColumnRenamed("power", "_a")
    c = source_power(w, control).withColumnRenamed("power", "_c")
    return a.join(c, "source").select(
        "source", ((F.col("_a") - F.col("_c")) / F.greatest("_c", F.lit(1e-20))).alias("contrast"))


def depth_weights(gain: DataFrame, depth: float = 0.8, exp: float = 0.8) -> DataFrame:
    """Column norm to the power -exp*depth, scaled to mean 1; gain cells are (sensor i, source j)."""
    n = gain.groupBy(F.col("j").alias("source")).agg(F.greatest(F.sqrt(F.sum(F.col("v") ** 2)), F.lit(1e-10)).alias("_n"))
    n = n.withColumn("_w", F.pow("_n", F.lit(-exp * depth)))
    return n.select("source", (F.col("_w") / F.avg("_w").over(W.partitionBy(F.lit(0)))).alias("weight"))


# -------------------------------------------------------------------- features


def connectome_features(edges: DataFrame, nodes: DataFrame, clustering: DataFrame, key: str = "graph") -> DataFrame:
    """Strength, density, clustering, asymmetry and entropy of each weighted graph.

    ``clustering`` holds the local clustering of the graph binarised above its
    median positive weight. The asymmetry mean runs over the full N x N grid,
    of which absent edges are zeros.
    """
    e = edges.where("src <> dst").select(key, "src", "dst", "weight")
    n = nodes.groupBy(key).agg(F.count("*").alias("_n"))
    s = nodes.join(e.groupBy(key, F.col("src").alias("node")).agg(F.sum("weight").alias("s")), [key, "node"], "left")
    s = s.select(key, "node", F.coalesce("s", F.lit(0.0)).alias("s"))
    s = s.withColumn("_p", F.col("s") / (F.sum("s").over(W.partitionBy(key)) + 1e-10))
    st = s.groupBy(key).agg(
        F.avg("s").alias("mean_strength"), F.stddev_pop("s").alias("strength_std"), F.max("s").alias("max_strength"),
        F.coalesce(-F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.log("_p"))), F.lit(0.0)).alias("strength_entropy"))
    both = e.select(key, "src", "dst", F.col("weight").alias("_w")).unionByName(
        e.select(key, F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("weight")).alias("_w")))
    asym = both.groupBy(key, "src", "dst").agg(F.abs(F.sum("_w")).alias("_d")).groupBy(key).agg(F.sum("_d").alias("_a"))
    dens = e.groupBy(key).agg(F.count(F.when(F.col("weight") > 0, 1)).alias("_e"))
    cc = clustering.groupBy(key).agg(F.avg("clustering").alias("clustering_coeff"), F.stddev_pop("clustering").alias("clustering_std"))
    out = st.join(n, key).join(asym, key).join(dens, key).join(cc, key)
    nn = F.col("_n")
    return out.select(key, "mean_strength", "strength_std", F.coalesce(F.try_divide(F.col("_e"), nn * (nn - 1)), F.lit(0.0)).alias("density"),
                      "clustering_coeff", "clustering_std", (F.col("_a") / (nn * nn)).alias("asymmetry"),
                      "max_strength", "strength_entropy")


def dynamics_features(occ: DataFrame, life: DataFrame, rate: DataFrame, n_states: int, key: str = "recording") -> DataFrame:
    """One row per subject: fo_state k, lifetime_state k and switching_rate."""
    cell = lambda df, v, p: df.groupBy(key).agg(*[
        F.max(F.when(F.col("state") == k, F.col(v))).alias(f"{p}_state{k}") for k in range(n_states)])
    return cell(occ, "occupancy", "fo").join(cell(life, "lifetime", "lifetime"), key).join(
        rate.select(key, "switching_rate"), key)


def subject_vector(*long_features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long feature tables ``subject, name, value`` to one row per subject; NaN is left out of means."""
    whole = long_features[0].select("subject", "name", "value")
    for f in long_features[1:]:
        whole = whole.unionByName(f.select("subject", "name", "value"))
    return whole.groupBy("subject").pivot("name", list(names)).agg(F.avg(F.when(~F.isnan("value"), F.col("value"))))
