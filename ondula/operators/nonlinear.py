"""Recurrence, entropy, surrogates and windowed dynamics."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ondula.functions.signature import log_signature, signature, with_time
from ondula.operators import fourier, ordered
from ondula.operators.aggregates import permutation_p
from ondula.operators.attach import attach
from ondula.operators.gram import gram
from ondula.operators.lines import DIAGONAL, VERTICAL, lines_of_pairs
from ondula.operators.quantiles import quantiles
from ondula.operators.ranking import order_modes
from ondula.operators.tiles import distance_quantile, pairs_within, template_counts
from ondula.operators.windows import change_points, embed_channel, global_rank, slide
from ondula.session import cut

KEY = ("recording", "channel")

# -------------------------------------------------------------------- recurrence


def distance_pairs(frames: DataFrame, metric: str | Sequence[str] = "euclidean", key: str = "recording", block: int = 512) -> DataFrame:
    """Distances ``d`` of all pairs i < j, or a column for each of several metrics; the matrix is symmetric with a zero diagonal."""
    return pairs_within(frames, None, metric, key, block)


def recurrence(frames: DataFrame, threshold: float | None = None, rate: float | None = None, metric: str = "euclidean",
               key: str = "recording", block: int = 512) -> DataFrame:
    """Recurrent pairs i < j (``key, i, j``) at a threshold or at the threshold that gives a target rate.

    The diagonal is always recurrent and the lower triangle mirrors the upper.
    """
    if rate is None:
        if threshold is None:
            raise ValueError("give a threshold or a recurrence rate")
        return pairs_within(frames, threshold, metric, key, block, distance=False)
    level = cut(distance_quantile(frames, rate, metric, key, block))
    return pairs_within(attach(frames, level, [key], ["t"], written=True), F.col("_q"), metric, key, block, distance=False)


def recurrence_rate(pairs: DataFrame, frames: DataFrame, key: str = "recording") -> DataFrame:
    """Off-diagonal share of recurrent points."""
    return rate_of_counts(pairs.groupBy(key).agg(F.count("*").alias("pairs")), frames, key)


def rate_of_counts(counts: DataFrame, frames: DataFrame, key: str = "recording") -> DataFrame:
    """``recurrence_rate`` from the number of recurrent ``pairs`` i < j, as ``count_within`` gives it."""
    n = frames.groupBy(key).agg(F.count("*").alias("n"))
    c = counts.select(key, (2 * F.col("pairs")).alias("_c"))
    return n.join(c, key, "left").select(key, "n", F.coalesce("_c", F.lit(0)).alias("points"),
                                         F.coalesce(F.try_divide(F.col("_c"), F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("recurrence_rate"))


def rate_of_lines(lines: DataFrame, frames: DataFrame, key: str = "recording") -> DataFrame:
    """``recurrence_rate`` from the histogram of lines: diagonal runs hold every recurrent point above the main diagonal."""
    n = frames.groupBy(key).agg(F.count("*").alias("n"))
    c = lines.where(F.col("kind") == DIAGONAL).groupBy(key).agg((2 * F.sum(F.col("length") * F.col("n"))).alias("_c"))
    return n.join(c, key, "left").select(key, "n", F.coalesce("_c", F.lit(0)).alias("points"),
                                         F.coalesce(F.try_divide(F.col("_c"), F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("recurrence_rate"))


def diagonal_measures(lines: DataFrame, rate: DataFrame, l_min: int = 2, key: str = "recording") -> DataFrame:
    """Determinism, mean and largest length, entropy of the length histogram; both triangles are alike, so each run counts twice."""
    h = lines.where(F.col("kind") == DIAGONAL).select(key, "length", (2 * F.col("n")).alias("_n"))
    ok = F.col("length") >= l_min
    p = F.when(ok, F.col("_n") / F.sum(F.when(ok, F.col("_n"))).over(W.partitionBy(key)))
    m = h.withColumn("_p", p).groupBy(key).agg(
        F.sum(F.when(ok, F.col("_n") * F.col("length"))).alias("_points"), F.sum(F.when(ok, F.col("_n"))).alias("_lines"),
        F.max("length").alias("max_diagonal_length"), (-F.sum(F.col("_p") * F.log("_p"))).alias("_ent"))
    j = rate.join(m, key, "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(key, z(F.when(F.col("points") > 0, F.col("_points") / F.col("points"))).alias("determinism"),
                    z(F.try_divide("_points", "_lines")).alias("average_diagonal_length"),
                    F.coalesce("max_diagonal_length", F.lit(0)).alias("max_diagonal_length"), z(F.col("_ent")).alias("diagonal_entropy"))


def vertical_measures(lines: DataFrame, rate: DataFrame, v_min: int = 2, key: str = "recording") -> DataFrame:
    """Laminarity (diagonal points in the denominator), trapping time, largest length."""
    ok = F.col("length") >= v_min
    m = lines.where(F.col("kind") == VERTICAL).groupBy(key).agg(
        F.sum(F.when(ok, F.col("length") * F.col("n"))).alias("_points"), F.sum(F.when(ok, F.col("n"))).alias("_lines"),
        F.max("length").alias("max_vertical_length"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return rate.join(m, key, "left").select(
        key, z(F.try_divide(F.col("_points"), F.col("points") + F.col("n"))).alias("laminarity"),
        z(F.when(F.col("_lines") > 0, F.col("_points") / F.col("_lines"))).alias("trapping_time"),
        F.coalesce("max_vertical_length", F.lit(0)).alias("max_vertical_length"))


def recurrence_measures(lines: DataFrame, frames: DataFrame, l_min: int = 2, v_min: int = 2, key: str = "recording") -> DataFrame:
    """All measures of a histogram of lines, as ``recurrence_lines`` or ``lines_of_pairs`` give it."""
    lines = cut(lines)
    rate = rate_of_lines(lines, frames, key)
    return rate.select(key, "recurrence_rate").join(diagonal_measures(lines, rate, l_min, key), key).join(vertical_measures(lines, rate, v_min, key), key)


def recurrence_summary(pairs: DataFrame, frames: DataFrame, l_min: int = 2, v_min: int = 2, key: str = "recording", block: int = 512) -> DataFrame:
    """All measures of given pairs; from frames, ``recurrence_measures`` of ``recurrence_lines`` needs no pairs."""
    return recurrence_measures(lines_of_pairs(pairs, frames, key, block), frames, l_min, v_min, key)


# ----------------------------------------------------------------------- entropy


def templates(samples: DataFrame, dim: int = 2, keys: Sequence[str] = KEY, block: int = ordered.BLOCK) -> DataFrame:
    """Templates of ``dim`` + 1 values (the last one has ``dim``) with the tolerance r = 0.2 sample deviations."""
    r = samples.groupBy(*keys).agg((0.2 * F.stddev_samp("value")).alias("r"))
    x = ordered.frame(samples, keys, "t", 0, dim, {"x": F.collect_list("value")}, block=block)
    return attach(x.where(F.size("x") >= dim).select(*keys, "t", "x"), r, keys, ["t"])


def sample_entropy(counts: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """-ln(phi1 / phi0) from the template counts, floored at 1e-10."""
    full = F.col("full")
    s = counts.groupBy(*keys).agg(F.count(F.when(full, 1)).alias("_n"), F.sum(F.when(full, F.col("c_full") - 1)).alias("_a"),
                                  F.sum(F.when(full, F.col("c_next") - 1)).alias("_b"))
    pairs = F.col("_n") * (F.col("_n") - 1)
    floor = lambda c: F.greatest(c, F.lit(1e-10))
    return s.select(*keys, (-F.log(floor(F.try_divide(F.col("_b"), pairs) / floor(F.try_divide(F.col("_a"), pairs))))).alias("sample_entropy"))


def approximate_entropy(counts: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Mean ln(match share) at dim minus at dim + 1."""
    c = counts.groupBy(*keys).agg(F.count("*").alias("_n"), F.count(F.when(F.col("full"), 1)).alias("_m"),
                                  F.avg(F.log("c_all")).alias("_a"), F.avg(F.when(F.col("full"), F.log("c_next"))).alias("_b"))
    return c.select(*keys, ((F.col("_a") - F.log("_n")) - (F.col("_b") - F.log("_m"))).alias("approximate_entropy"))


def svd_entropy(samples: DataFrame, dim: int = 10, tau: int = 2, keys: Sequence[str] = KEY, block: int = ordered.BLOCK) -> DataFrame:
    """log2 entropy of the normalised singular values of the delay embedding, from its dim x dim Gram."""
    keys = list(keys)
    g = gram(embed_channel(samples, dim, tau, keys, block), keys)
    ddl = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys)

    def entropy(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((dim, dim))
        m[pdf["i"], pdf["j"]] = pdf["s2"] * pdf["n"]
        s = np.sqrt(np.maximum(np.linalg.eigvalsh(m), 0))
        p = s / s.sum()
        out = pd.DataFrame({"svd_entropy": [-np.sum(p * np.log2(np.maximum(p, 1e-10)))]})
        for k, v in zip(keys, key):
            out[k] = v
        return out

    return g.groupBy(*keys).applyInPandas(entropy, f"{ddl}, svd_entropy double")


def spectral_entropy(samples: DataFrame, keys: Sequence[str] = KEY, limit: int = fourier.LIMIT) -> DataFrame:
    """log2 entropy of the one-sided power without DC."""
    f = fourier.dft(fourier.real_rows(samples, keys), keys, limit=limit).where((F.col("k") > 0) & (F.col("k") <= F.floor(F.col("n") / 2)))
    f = f.select(*keys, (F.col("re") ** 2 + F.col("im") ** 2).alias("_p"))
    total = f.groupBy(*keys).agg(F.sum("_p").alias("_t"))
    p = F.try_divide("_p", "_t")  # NULL for a constant series
    return f.join(total, list(keys)).groupBy(*keys).agg((-F.sum(p * F.log2(F.greatest(p, F.lit(1e-10))))).alias("spectral_entropy"))


def all_entropies(samples: DataFrame, dim: int = 2, keys: Sequence[str] = KEY, block: int = ordered.BLOCK) -> DataFrame:
    counts = cut(template_counts(templates(samples, dim, keys, block), keys, dim))
    on = list(keys)
    return sample_entropy(counts, keys).join(approximate_entropy(counts, keys), on).join(
        svd_entropy(samples, keys=keys, block=block), on).join(spectral_entropy(samples, keys), on)


# --------------------------------------------------------------------- surrogates


def _uniform(seed: int, *cols) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def shuffle(samples: DataFrame, seed: int = 0, keys: Sequence[str] = KEY) -> DataFrame:
    """Random permutation of each series, ordered by a hash of seed, key and time."""
    keys = list(keys)
    start = samples.groupBy(*keys).agg(F.min("t").alias("_t0"))
    r = global_rank(samples, keys, [F.xxhash64(F.lit(seed), *keys, "t"), "t"], "_r")
    return r.join(start, keys).withColumn("t", F.col("_t0") + F.col("_r")).select(*samples.columns)


def block_shuffle(samples: DataFrame, size: int = 50, seed: int = 0, keys: Sequence[str] = KEY) -> DataFrame:
    """Permute fixed blocks of a series from t = 0, the short last one included."""
    keys = list(keys)
    b = F.floor(F.col("t") / size)
    sizes = samples.groupBy(*keys, b.alias("_b")).agg(F.count("*").alias("_n"))
    placed = global_rank(sizes, keys, [F.xxhash64(F.lit(seed), *keys, "_b"), "_b"], "_r")
    placed = ordered.running(placed, keys, "_r", "_n", "_at", inclusive=False)
    return samples.withColumn("_b", b).join(placed, [*keys, "_b"]).withColumn(
        "t", F.col("_at") + F.col("t") - F.col("_b") * size).select(*samples.columns)


def phase_randomise(samples: DataFrame, seed: int = 0, keys: Sequence[str] = KEY, limit: int = fourier.LIMIT) -> DataFrame:
    """Keep the amplitudes, draw the phases; DC and Nyquist phases are 0, channels are independent."""
    keys = list(keys)
    rows = fourier.real_rows(samples, keys)
    known = fourier.lengths(rows, keys, limit)
    f = fourier.dft(rows, keys, limit=limit, known=known)
    k, n = F.col("k"), F.col("n")
    half = F.least(k, n - k)
    draw = 2 * math.pi * _uniform(seed, *keys, half)
    phi = F.when((k == 0) | (2 * k == n), 0.0).when(2 * k < n, draw).otherwise(-draw)
    amp = F.hypot("re", "im")
    g = f.select(*keys, "n", "k", (amp * F.cos(phi)).alias("re"), (amp * F.sin(phi)).alias("im"))
    return fourier.dft(g, keys, inverse=True, limit=limit, known=known).select(*keys, "t", F.col("re").alias("value"))


def amplitude_adjusted(samples: DataFrame, seed: int = 0, keys: Sequence[str] = KEY, limit: int = fourier.LIMIT) -> DataFrame:
    """Rank-map to a Gaussian, randomise phases, rank-map the original values back."""
    keys = list(keys)
    rank = cut(global_rank(samples.select(*keys, "t", "value"), keys, ["value", "t"]))
    normal = F.sqrt(-2 * F.log(_uniform(seed + 1, *keys, "t"))) * F.cos(2 * math.pi * _uniform(seed + 2, *keys, "t"))
    noise = global_rank(samples.select(*keys, "t", normal.alias("_g")), keys, ["_g", "t"]).select(*keys, "rank", "_g")
    shaped = rank.join(noise, [*keys, "rank"]).select(*keys, "t", F.col("_g").alias("value"))
    mixed = global_rank(phase_randomise(shaped, seed, keys, limit), keys, ["value", "t"]).select(*keys, "t", "rank")
    return mixed.join(rank.select(*keys, "rank", "value"), [*keys, "rank"]).select(*keys, "t", "value")


def surrogate_test(samples: DataFrame, surrogate: Callable[[DataFrame, Sequence[str]], DataFrame],
                   statistic: Callable[[DataFrame, Sequence[str]], DataFrame], n: int = 100, keys: Sequence[str] = KEY) -> DataFrame:
    """Observed statistic, its p against ``n`` surrogates and the p < 0.05 flag.

    All surrogates are made in one plan with the surrogate id as a further
    key; ``statistic`` returns ``keys, value``.
    """
    keys = list(keys)
    copies = samples.withColumn("surrogate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    null = statistic(surrogate(copies, [*keys, "surrogate"]), [*keys, "surrogate"])
    return permutation_p(null, statistic(samples, keys), keys).withColumn("significant", F.col("p") < 0.05)


def lag_one_correlation(samples: DataFrame, keys: Sequence[str], block: int = ordered.BLOCK) -> DataFrame:
    nxt = ordered.neighbour(samples, keys, "t", {"value": "_next"}, ahead=True, block=block)
    return nxt.where("_next IS NOT NULL").groupBy(*keys).agg(F.coalesce(F.corr("value", "_next"), F.lit(0.0)).alias("value"))


def user_statistic(windows: DataFrame, function: Callable[[np.ndarray, int], float], keys: Sequence[str]) -> DataFrame:
    """A user function of one bounded series and a seed: ``keys`` name the window, the last one is the seed."""
    keys = list(keys)
    ddl = ", ".join(f"`{k}` {windows.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["value"].to_numpy()
        return pd.DataFrame([[*key, float(function(x, int(key[-1])))]], columns=[*keys, "value"])

    return windows.groupBy(*keys).applyInPandas(run, f"{ddl}, value double")


# ------------------------------------------------------------- windowed dynamics


def _per_window(frames: DataFrame, width: int, step: int, kernel: Callable[[np.ndarray], pd.DataFrame], fields: str) -> DataFrame:
    """One kernel call per window of ``width`` frames."""
    packed = slide(frames, width, step).groupBy("recording", "win", "centre").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("_c")).select(
        "recording", "win", "centre", F.col("_c.x").alias("x"))
    names = [f.strip().split(" ")[0] for f in fields.split(",")]

    def run(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                out = kernel(np.stack([np.asarray(v, dtype=float) for v in r.x]))
                yield out.assign(recording=r.recording, win=r.win, centre=r.centre)[["recording", "win", "centre", *names]]

    return packed.mapInPandas(run, f"recording string, win bigint, centre bigint, {fields}")


def _leading(x: np.ndarray, n: int) -> np.ndarray:
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    u = u[:, :n] * s[:n]
    top = u[np.argmax(np.abs(u), axis=0), np.arange(u.shape[1])]
    return u * np.where(top < 0, -1.0, 1.0)  # fixed sign, so that windows compare


def path_signatures(frames: DataFrame, width: int, step: int, depth: int = 3) -> DataFrame:
    """Signature of the time-augmented path of each window as one array."""
    one = lambda x: pd.DataFrame({"x": [np.concatenate(signature(with_time(x), depth))]})
    return _per_window(frames, width, step, one, "x array<double>")


def log_signature_changes(frames: DataFrame, width: int, step: int, n_pca: int = 5, depth: int = 3, k: float = 2.0) -> DataFrame:
    """Log-signature of the leading components per window, distance to the next window and the change flag."""
    one = lambda x: pd.DataFrame({"x": [log_signature(with_time(_leading(x, n_pca)), depth)]})
    sig = cut(_per_window(frames, width, step, one, "x array<double>"))
    return sig.join(change_points(sig, k), ["recording", "win"], "left")


def dynamic_modes(frames: DataFrame, width: int, step: int, rank: int, dt: float) -> DataFrame:
    """Exact DMD per window: ``mode, freq, growth, re, im``, ranked by frequency magnitude."""

    def one(x: np.ndarray) -> pd.DataFrame:
        a, b = x[:-1].T, x[1:].T
        u, s, vt = np.linalg.svd(a, full_matrices=False)
        r = min(rank, int(np.sum(s > s[0] * 1e-12)))
        lam = np.linalg.eigvals(u[:, :r].T @ b @ vt[:r].T / s[:r])
        om = np.log(lam + 0j) / dt
        return pd.DataFrame({"mode": np.arange(r), "freq": np.abs(om.imag) / (2 * np.pi), "growth": om.real, "re": lam.real, "im": lam.imag})

    m = _per_window(frames, width, step, one, "mode int, freq double, growth double, re double, im double")
    return order_modes(m, ["recording", "win"])


def _library(x: np.ndarray, degree: int) -> np.ndarray:
    cols = [np.ones(len(x))]
    for d in range(1, degree + 1):
        cols += [np.prod(x[:, list(c)], axis=1) for c in combinations_with_replacement(range(x.shape[1]), d)]
    return np.column_stack(cols)


def sparse_dynamics(frames: DataFrame, width: int, step: int, n_pca: int = 3, degree: int = 2, threshold: float = 0.05,
                    dt: float = 1.0, n_iter: int = 10) -> DataFrame:
    """Thresholded least squares of the derivative on a polynomial library per window; eigenvalues of the linear block."""

    def one(x: np.ndarray) -> pd.DataFrame:
        p = _leading(x, n_pca)
        dp = np.gradient(p, dt, axis=0)
        th = _library(p, degree)
        xi = np.linalg.lstsq(th, dp, rcond=None)[0]
        for _ in range(n_iter):
            small = np.abs(xi) < threshold
            xi[small] = 0.0
            for c in range(dp.shape[1]):
                use = ~small[:, c]
                if use.any():
                    xi[use, c] = np.linalg.lstsq(th[:, use], dp[:, c], rcond=None)[0]
        eig = np.linalg.eigvals(xi[1:n_pca + 1].T)
        return pd.DataFrame({"max_real": [eig.real.max()], "eig_re": [eig.real], "eig_im": [eig.imag], "coefficients": [xi.ravel()]})

    return _per_window(frames, width, step, one, "max_real double, eig_re array<double>, eig_im array<double>, coefficients array<double>")


def stability_share(dynamics: DataFrame, modes: DataFrame, key: str = "recording") -> DataFrame:
    """Share of windows whose largest real part is below 0, and the median leading frequency."""
    s = dynamics.groupBy(key).agg(F.avg((F.col("max_real") < 0).cast("double")).alias("stable_share"))
    return s.join(quantiles(modes.where("rank = 1"), [key], "freq", {"median_freq": 0.5}), key)
