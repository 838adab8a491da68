"""Filters, spectra, time-frequency and coupling operators."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ondula.functions import complex as cx
from ondula.functions.types import doubles
from ondula.operators import fourier, ordered
from ondula.operators.attach import attach
from ondula.operators.aggregates import average_edits, transient_outliers
from ondula.operators.gram import partial_rows, partial_sums
from ondula.operators.windows import slide
from ondula.session import cut

KEY = ("recording", "channel")
DENSE = 1024  # up to this length tapers come from the dense eigenproblem, beyond from its leading vectors alone

# ----------------------------------------------------------------- FFT filters


def band_filter(samples: DataFrame, fs: float, low: float | None = None, high: float | None = None,
                keys: Sequence[str] = KEY, limit: int = fourier.LIMIT) -> DataFrame:
    """Keep the bins inside [low, high]."""
    f = fourier.bin_frequency(fs)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (f >= low)
    if high is not None:
        ok = ok & (f <= high)
    return _real(samples, keys, ok, limit)


def notch_filter(samples: DataFrame, fs: float, freq: float = 60.0, width: float = 1.0, keys: Sequence[str] = KEY,
                 limit: int = fourier.LIMIT) -> DataFrame:
    f = fourier.bin_frequency(fs)
    return _real(samples, keys, ~f.between(freq - width / 2, freq + width / 2), limit)


def _real(samples: DataFrame, keys: Sequence[str], ok: Column, limit: int) -> DataFrame:
    return fourier.spectral_map(samples, keys, ok.cast("double"), limit).select(*keys, "t", F.col("re").alias("value"))


def _one_sided() -> Column:
    """1 at DC and Nyquist, 2 at positive and 0 at negative bins."""
    k, n = F.col("k"), F.col("n")
    return F.when((k == 0) | (2 * k == n), 1.0).when(2 * k < n, 2.0).otherwise(0.0)


def analytic(samples: DataFrame, keys: Sequence[str] = KEY, limit: int = fourier.LIMIT) -> DataFrame:
    """Analytic signal ``re, im`` with envelope and phase."""
    return _polar(fourier.spectral_map(samples, keys, _one_sided(), limit))


def narrowband(samples: DataFrame, fs: float, low: float, high: float, keys: Sequence[str] = KEY,
               limit: int = fourier.LIMIT) -> DataFrame:
    """Band mask and analytic signal in one transform."""
    inside = fourier.bin_frequency(fs).between(low, high).cast("double")
    return _polar(fourier.spectral_map(samples, keys, _one_sided() * inside, limit))


def _polar(z: DataFrame) -> DataFrame:
    return z.withColumn("envelope", F.hypot("re", "im")).withColumn("phase", F.atan2("im", "re"))


def spectrum(samples: DataFrame, fs: float, keys: Sequence[str] = KEY, limit: int = fourier.LIMIT) -> DataFrame:
    """One-sided spectrum of each series: ``k, freq, re, im``."""
    f = fourier.dft(fourier.real_rows(samples, keys), keys, limit=limit).where(F.col("k") <= F.floor(F.col("n") / 2))
    return f.select(*keys, "n", "k", (F.col("k") * fs / F.col("n")).alias("freq"), "re", "im")


def decay_spectrum(fids: DataFrame, dwell: float, broadening: float = 0.0, keys: Sequence[str] = ("acq", "edit", "dyn")) -> DataFrame:
    """Shifted spectrum of a decay signal after optional line broadening: ``bin`` counts from the lowest frequency."""
    t = F.col("n") * dwell
    damped = cx.scale(F.col("s"), F.exp(-math.pi * broadening * t)) if broadening else F.col("s")
    rows = fids.select(*keys, F.col("n").alias("t"), damped.alias("s")).select(*keys, "t", "s.re", "s.im")
    f = fourier.dft(rows, keys)
    low = F.floor(F.col("n") / 2)
    shifted = F.pmod(F.col("k") + low, F.col("n"))
    return f.select(*keys, "n", shifted.alias("bin"), ((shifted - low) / (F.col("n") * dwell)).alias("freq"), "re", "im")


# --------------------------------------------------------------- window spectra


@F.pandas_udf(doubles("re", "im"))
def _rfft(x: pd.Series, nfft: pd.Series) -> pd.DataFrame:
    f = [np.fft.rfft(np.asarray(v, dtype=float), n=int(n)) for v, n in zip(x, nfft)]
    return pd.DataFrame({"re": [v.real for v in f], "im": [v.imag for v in f]})


def _window_arrays(samples: DataFrame, width: int, step: int, channel: str = "channel") -> DataFrame:
    w = slide(samples, width, step)
    packed = w.groupBy("recording", channel, "win", "centre").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("_c"))
    return packed.select("recording", channel, "win", "centre", F.col("_c.value").alias("x"))


def _bins(df: DataFrame, keep: Sequence[str], x: Column, nfft: int) -> DataFrame:
    f = df.select(*keep, _rfft(x, F.lit(nfft)).alias("_f"))
    return f.select(*keep, F.posexplode(F.arrays_zip("_f.re", "_f.im")).alias("k", "_z")).select(
        *keep, "k", F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))


def spectrogram(samples: DataFrame, fs: float, width: int, step: int | None = None, nfft: int | None = None) -> DataFrame:
    """|X|^2 / (fs nfft) of periodic-Hann windows, bins not doubled, time at the window centre."""
    step, nfft = step or width // 2, nfft or width
    hann = F.array(*[F.lit(0.5 * (1 - math.cos(2 * math.pi * i / width))) for i in range(width)])
    w = _window_arrays(samples, width, step)
    keep = ["recording", "channel", "win"]
    f = _bins(w, keep, F.zip_with("x", hann, lambda a, b: a * b), nfft)
    return f.select(*keep, "k", (F.col("k") * fs / nfft).alias("freq"), ((F.col("win") * step + width / 2) / fs).alias("time"),
                    ((F.col("re") ** 2 + F.col("im") ** 2) / (fs * nfft)).alias("power"))


def leading_vectors(diag: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """Eigenvectors (rows) of the ``count`` largest eigenvalues of a symmetric tridiagonal matrix, in time and space linear in its size.

    Intervals of the eigenvalues are cut into 32 parts at a time by the signs of
    the pivots of T - x; inverse iteration with partial pivoting gives the vectors.
    """
    n = len(diag)
    radius = np.abs(np.concatenate([off, [0.0]])) + np.abs(np.concatenate([[0.0], off]))
    lo, hi = np.full(count, (diag - radius).min()), np.full(count, (diag + radius).max())
    tiny, square = np.finfo(float).tiny, off ** 2
    while (hi - lo > 4e-16 * np.maximum(np.abs(lo), np.abs(hi))).any():
        grid = lo[:, None] + (hi - lo)[:, None] * np.linspace(0, 1, 33)[1:-1]
        q, below = diag[0] - grid, np.zeros(grid.shape, dtype=np.int64)
        for i in range(n):
            if i:
                q = diag[i] - grid - square[i - 1] / q
            q = np.where(np.abs(q) < tiny, -tiny, q)
            below += q < 0
        more = n - below > np.arange(count)[:, None]  # the eigenvalue lies above this point
        edges = np.column_stack([lo, grid, hi])
        k = more.sum(axis=1)
        new_lo, new_hi = edges[np.arange(count), k], edges[np.arange(count), k + 1]
        if (new_lo == lo).all() and (new_hi == hi).all():
            break
        lo, hi = new_lo, new_hi
    v = np.random.default_rng(0).standard_normal((n, count))
    for _ in range(3):
        v = _tridiagonal_solve(diag[:, None] - (lo + hi) / 2, off, v)
        v, _ = np.linalg.qr(v)
    return v.T


def _tridiagonal_solve(diag: np.ndarray, off: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solve as many symmetric tridiagonal systems as ``diag`` and ``rhs`` have columns, with row exchanges."""
    n, b = len(diag), rhs.copy()
    main, upper, second = diag.copy(), np.zeros_like(diag), np.zeros_like(diag)
    upper[:-1] = off[:, None]
    small = np.finfo(float).eps * np.abs(off).max()
    for i in range(n - 1):
        a, c = main[i].copy(), np.full(main.shape[1], off[i])
        swap = np.abs(c) > np.abs(a)
        row, nxt = (a, upper[i].copy(), second[i].copy()), (c, main[i + 1].copy(), upper[i + 1].copy())
        main[i], upper[i], second[i] = (np.where(swap, y, x) for x, y in zip(row, nxt))
        low = [np.where(swap, x, y) for x, y in zip(row, nxt)]
        main[i] = np.where(main[i] == 0, small, main[i])
        f = low[0] / main[i]
        main[i + 1], upper[i + 1] = low[1] - f * upper[i], low[2] - f * second[i]
        bi, bn = np.where(swap, b[i + 1], b[i]), np.where(swap, b[i], b[i + 1])
        b[i], b[i + 1] = bi, bn - f * bi
    main[-1] = np.where(np.abs(main[-1]) < small, small, main[-1])
    x = np.zeros_like(b)
    for i in range(n - 1, -1, -1):
        x[i] = b[i]
        if i + 1 < n:
            x[i] -= upper[i] * x[i + 1]
        if i + 2 < n:
            x[i] -= second[i] * x[i + 2]
        x[i] /= main[i]
    return x


@lru_cache(maxsize=32)
def tapers(length: int, bandwidth: float = 4.0, count: int | None = None) -> np.ndarray:
    """Orthonormal DPSS tapers (count, length), largest concentration first, positive at the centre."""
    count = count or int(2 * bandwidth - 1)
    i = np.arange(length)
    diag = ((length - 1) / 2 - i) ** 2 * np.cos(2 * np.pi * bandwidth / length)
    off = i[1:] * (length - i[1:]) / 2
    if length > DENSE:
        t = leading_vectors(diag, off, count)
    else:
        _, v = np.linalg.eigh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
        t = v[:, ::-1][:, :count].T
    return t * np.where(t[:, [length // 2]] < 0, -1.0, 1.0)


def tapered(samples: DataFrame, width: int, step: int, bandwidth: float = 4.0) -> DataFrame:
    """Spectra of every taper of every window: ``recording, channel, win, taper, k, re, im``."""
    w = _window_arrays(samples, width, step)
    rows = [F.struct(F.lit(i).alias("taper"), F.array(*[F.lit(float(v)) for v in t]).alias("w")) for i, t in enumerate(tapers(width, bandwidth))]
    w = w.select("recording", "channel", "win", "x", F.inline(F.array(*rows)))
    return _bins(w, ["recording", "channel", "win", "taper"], F.zip_with("x", "w", lambda a, b: a * b), width)


def _doubling(width: int) -> Column:
    return F.when((F.col("k") > 0) & (F.col("k") < width // 2), 2.0).otherwise(1.0)


def multitaper_psd(samples: DataFrame, fs: float, width: int, step: int | None = None, bandwidth: float = 4.0) -> DataFrame:
    """Mean over tapers of |X|^2 / (fs nfft), bins 1 .. -2 doubled, then the mean over windows."""
    f = tapered(samples, width, step or width, bandwidth)
    p = (F.col("re") ** 2 + F.col("im") ** 2) / (fs * width) * _doubling(width)
    return f.groupBy("recording", "channel", "k").agg(F.avg(p).alias("power")).withColumn("freq", F.col("k") * fs / width)


def static_power(samples: DataFrame, fs: float, width: int, bandwidth: float = 4.0) -> DataFrame:
    """Multitaper power averaged over recordings."""
    return multitaper_psd(samples, fs, width, bandwidth=bandwidth).groupBy("channel", "k", "freq").agg(F.avg("power").alias("power"))


def cross_spectrum(samples: DataFrame, fs: float, width: int, step: int | None = None, bandwidth: float = 4.0) -> DataFrame:
    """Cross-spectra over tapers and windows, and squared coherence in [0, 1]: ``recording, k, i, j``.

    The tapered spectra of one (window, taper, bin) form one complex vector
    over channels; their outer products are summed per partition.
    """
    f = tapered(samples, width, step or width, bandwidth)
    v = f.groupBy("recording", "win", "taper", "k").agg(F.sort_array(F.collect_list(F.struct("channel", "re", "im"))).alias("_c")).select(
        "recording", "k", F.col("_c.re").alias("re"), F.col("_c.im").alias("im"))
    n = f.select("recording", "win", "taper").distinct().groupBy("recording").agg(F.count("*").alias("_n"))
    g = complex_gram(v, ["recording", "k"]).join(n, "recording")
    s = _doubling(width) / (fs * width) / F.col("_n")
    return coherence(g.select("recording", "k", "i", "j", (F.col("re") * s).alias("re"), (F.col("im") * s).alias("im")), ["recording", "k"])


def coherence(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds |S_ij|^2 / max(S_ii S_jj, 1e-20), clipped to [0, 1]."""
    keys = list(keys)
    d = F.when(F.col("i") == F.col("j"), F.col("re"))
    c = cells.withColumn("_i", F.max(d).over(W.partitionBy(*keys, "i"))).withColumn("_j", F.max(d).over(W.partitionBy(*keys, "j")))
    coh = (F.col("re") ** 2 + F.col("im") ** 2) / F.greatest(F.col("_i") * F.col("_j"), F.lit(1e-20))
    return c.withColumn("coherence", F.least(F.greatest(coh, F.lit(0.0)), F.lit(1.0))).drop("_i", "_j")


def complex_gram(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of z z^H over rows with arrays ``re`` and ``im``: ``keys, i, j, re, im``."""
    keys = list(keys)

    def kernel(re: np.ndarray, im: np.ndarray) -> np.ndarray:
        z = re + 1j * im
        g = z.T @ z.conj()
        return np.column_stack([g.real, g.imag])

    cells = partial_sums(rows, keys, ["re", "im"], kernel)
    width = F.max("j").over(W.partitionBy(*keys)) + 1
    c = cells.withColumn("_w", (width / 2).cast("int"))
    return c.groupBy(*keys, "i", (F.col("j") % F.col("_w")).alias("j")).agg(
        F.sum(F.when(F.col("j") < F.col("_w"), F.col("v"))).alias("re"), F.sum(F.when(F.col("j") >= F.col("_w"), F.col("v"))).alias("im"))


# -------------------------------------------------------------- time-domain filters


def iir_filter(samples: DataFrame, b: Sequence[float], a: Sequence[float], keys: Sequence[str] = KEY, block: int = 1 << 15) -> DataFrame:
    """Recursive filter from zero state, exact across blocks.

    Inside a block the output is the zero-state response plus the response to
    the state at its start. The states are chained over one small row per
    block, so only block summaries of a series meet in one task.
    """
    keys = list(keys)
    b, a = np.asarray(b, dtype=float) / a[0], np.asarray(a, dtype=float) / a[0]
    size = max(len(a), len(b))
    b, a = np.pad(b, (0, size - len(b))), np.pad(a, (0, size - len(a)))
    order = size - 1
    if order == 0:
        return samples.withColumn("value", F.col("value") * float(b[0]))
    step = np.diag(np.ones(order - 1), 1)
    step[:, 0] -= a[1:]
    drive = b[1:] - a[1:] * b[0]
    states = np.empty((block, order))  # A^t B
    free = np.empty((block, order))  # C A^t
    s, row = drive.copy(), np.eye(order)[0]
    for t in range(block):
        states[t], free[t] = s, row
        s, row = step @ s, row @ step
    impulse = np.concatenate([[b[0]], states[:-1, 0]])
    power = np.linalg.matrix_power(step, block)
    nfft = 1 << (2 * block - 1).bit_length()
    transfer = np.fft.rfft(impulse, nfft)
    ddl = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys)

    blocks = samples.withColumn("_blk", F.floor(F.col("t") / block)).groupBy(*keys, "_blk").agg(
        F.sort_array(F.collect_list(F.struct("t", "value"))).alias("_c")).select(
        *keys, "_blk", F.col("_c.t").alias("t"), F.col("_c.value").alias("x"))

    @F.pandas_udf("array<double>")
    def end_state(x: pd.Series) -> pd.Series:
        return pd.Series([states[:len(v)][::-1].T @ np.asarray(v, dtype=float) for v in x])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        state, starts = np.zeros(order), []
        for own in pdf["_end"]:
            starts.append(state)
            state = power @ state + np.asarray(own)
        return pdf[[*keys, "_blk"]].assign(_start=starts)

    @F.pandas_udf("array<double>")
    def respond(x: pd.Series, start: pd.Series) -> pd.Series:
        out = []
        for v, s0 in zip(x, start):
            v = np.asarray(v, dtype=float)
            y = np.fft.irfft(np.fft.rfft(v, nfft) * transfer, nfft)[:len(v)]
            out.append(y + free[:len(v)] @ np.asarray(s0))
        return pd.Series(out)

    ends = blocks.select(*keys, "_blk", end_state("x").alias("_end"))
    starts = ends.groupBy(*keys).applyInPandas(chain, f"{ddl}, _blk bigint, _start array<double>")
    y = blocks.join(starts, [*keys, "_blk"]).select(*keys, "t", respond("x", "_start").alias("y"))
    return y.select(*keys, F.explode(F.arrays_zip("t", "y")).alias("_z")).select(*keys, "_z.t", F.col("_z.y").alias("value"))


def kaiser_taps(up: int, down: int) -> np.ndarray:
    """Low-pass taps for a rate change: cutoff 1 / max(up, down), Kaiser 5.0, unit sum times ``up``."""
    top = max(up, down)
    half = 10 * top
    m = np.arange(-half, half + 1)
    h = np.sinc(m / top) * np.kaiser(2 * half + 1, 5.0)
    return h / h.sum() * up


def resample(samples: DataFrame, old_rate: int, new_rate: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Polyphase resampling; each input sample adds to the outputs its taps reach, partial sums first."""
    g = math.gcd(old_rate, new_rate)
    up, down = new_rate // g, old_rate // g
    if up == down:
        return samples
    taps = kaiser_taps(up, down)
    half = len(taps) // 2
    keys = list(keys)
    last = samples.groupBy(*keys).agg(F.max("t").alias("_last"))
    pos = F.col("t") * up
    first = F.greatest(F.ceil((pos - half) / down), F.lit(0))
    end = F.least(F.floor((pos + half) / down), F.floor(((F.col("_last") + 1) * up - 1) / down))
    hit = attach(samples, last, keys, ["t"]).withColumn("_m", F.explode(F.sequence(first.cast("bigint"), end.cast("bigint"))))
    h = F.get(F.array(*[F.lit(float(v)) for v in taps]), (F.col("_m") * down + half - pos).cast("int"))
    return hit.groupBy(*keys, F.col("_m").alias("t")).agg(F.sum(F.col("value") * h).alias("value"))


def drift_filter(samples: DataFrame, fs: float, cutoff: float, keys: Sequence[str] = KEY) -> DataFrame:
    """Remove the projection on the slowest cosines: the first max(1, int(2 T cutoff)) + 1 of the DCT basis."""
    keys = list(keys)
    n = samples.groupBy(*keys).agg((F.max("t") + 1).alias("_n"))
    j = attach(samples, n, keys, ["t"]).withColumn("_k", F.greatest(F.lit(1), F.floor(2 * F.col("_n") / fs * cutoff)).cast("int"))
    basis = lambda k: F.cos((2 * F.col("t") + 1) * k * math.pi / (2 * F.col("_n"))) * F.when(k == 0, F.sqrt(1 / F.col("_n"))).otherwise(F.sqrt(2 / F.col("_n")))
    rows = j.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_k"))))
    coef = rows.groupBy(*keys, "k").agg(F.sum(F.col("value") * basis(F.col("k"))).alias("_w"))
    coef = coef.groupBy(*keys).agg(F.collect_list(F.struct("k", "_w")).alias("_c"))
    trend = F.aggregate("_c", F.lit(0.0), lambda s, c: s + c["_w"] * basis(c["k"]))
    return attach(j, coef, keys, ["t"]).select(*keys, "t", (F.col("value") - trend).alias("value"))


def _wavelets(fs: float, freqs: Sequence[float], low: float, high: float, zero_mean: bool) -> np.ndarray:
    cycles = np.linspace(low, high, len(freqs))
    half = int(3 * low / (2 * np.pi * min(freqs)) * fs)
    t = np.arange(-half, half + 1) / fs
    sigma = cycles / (2 * np.pi * np.asarray(freqs, dtype=float))
    w = np.exp(2j * np.pi * np.outer(freqs, t)) * np.exp(-t ** 2 / (2 * sigma[:, None] ** 2))
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    return w - w.mean(axis=1, keepdims=True) if zero_mean else w


def _convolve(samples: DataFrame, bank: list[np.ndarray], fields: str, finish, keys: Sequence[str], block: int) -> DataFrame:
    keys = list(keys)
    half = max(w.shape[1] // 2 for w in bank)
    block = max(block, half + 1)
    ddl = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys)
    pieces = ordered.halo(samples.select(*keys, "t", "value"), keys, "t", half, half, block=block)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(key[-1]) * block
        x = np.zeros(block + 2 * half)
        x[pdf["t"].to_numpy() - start + half] = pdf["value"].to_numpy()
        t = np.sort(pdf.loc[pdf["_own"], "t"].to_numpy())
        outs = []
        for w in bank:
            # correlation without a flip, zero padding at the ends of the series
            n = 1 << (len(x) + w.shape[1]).bit_length()
            full = np.fft.ifft(np.fft.fft(x, n) * np.fft.fft(w[:, ::-1], n, axis=1), axis=1)
            outs.append(full[:, half + w.shape[1] // 2:][:, t - start])
        frame = finish(outs)
        nf = len(bank[0])
        res = pd.DataFrame({"f": np.repeat(np.arange(nf), len(t)), "t": np.tile(t, nf), **{c: v.ravel() for c, v in frame.items()}})
        for k, v in zip(keys, key):
            res[k] = v
        return res

    return pieces.groupBy(*keys, "_blk").applyInPandas(run, f"{ddl}, f int, t bigint, {fields}")


def morlet(samples: DataFrame, fs: float, freqs: Sequence[float], low: float = 3.0, high: float = 7.0, zero_mean: bool = True,
           keys: Sequence[str] = KEY, block: int = 1 << 14) -> DataFrame:
    """Complex Morlet transform, cycles from ``low`` to ``high`` over the frequencies, same length as the input."""
    bank = [_wavelets(fs, freqs, low, high, zero_mean)]
    return _convolve(samples, bank, "re double, im double", lambda o: {"re": o[0].real, "im": o[0].imag}, keys, block)


def superlet(samples: DataFrame, fs: float, freqs: Sequence[float], base: float = 3.0, order: int = 3, keys: Sequence[str] = KEY,
             block: int = 1 << 14) -> DataFrame:
    """Geometric mean of the Morlet magnitudes with base x 1 .. order cycles."""
    bank = [_wavelets(fs, freqs, base * i, base * i, True) for i in range(1, order + 1)]
    geo = lambda o: {"magnitude": np.exp(np.mean([np.log(np.abs(z) + 1e-9) for z in o], axis=0))}
    return _convolve(samples, bank, "magnitude double", geo, keys, block)


# --------------------------------------------------------------------- coupling


def phase_locking(phases: DataFrame, keys: Sequence[str] = ("recording",)) -> DataFrame:
    """Phase locking of all channel pairs from phase frames ``x``: value and imaginary part, one pass."""
    n = phases.groupBy(*keys).agg(F.count("*").alias("_n"))
    unit = phases.select(*keys, F.transform("x", lambda v: F.cos(v)).alias("re"), F.transform("x", lambda v: F.sin(v)).alias("im"))
    g = complex_gram(unit, keys).join(n, list(keys))
    return g.select(*keys, "i", "j", (F.hypot("re", "im") / F.col("_n")).alias("plv"), (F.abs("im") / F.col("_n")).alias("imaginary"))


def to_frames(samples: DataFrame, value: str = "value") -> DataFrame:
    """Long samples to frames; a frame has one value per channel."""
    return samples.groupBy("recording", "t").agg(F.sort_array(F.collect_list(F.struct("channel", F.col(value).alias("v")))).alias("_c")).select(
        "recording", "t", F.col("_c.v").alias("x"))


def envelope_correlation(samples: DataFrame) -> DataFrame:
    """Pearson of the envelopes of two channels over the times that both have: ``recording, i, j, r``, channels numbered in their order.

    An envelope is not negative and about as large as its deviation, so plain sums do.
    """
    names = [r[0] for r in samples.select("channel").distinct().orderBy("channel").collect()]  # channel-sized
    c = len(names)
    at = F.map_from_entries(F.collect_list(F.struct("channel", "envelope")))
    frames = analytic(samples).groupBy("recording", "t").agg(at.alias("_m")).select(
        "recording", F.array(*[F.coalesce(F.try_element_at("_m", F.lit(n)), F.lit(float("nan"))) for n in names]).alias("x"))

    def kernel(m: np.ndarray) -> np.ndarray:
        have = ~np.isnan(m)
        z = np.where(have, m, 0.0)
        return np.hstack([have.T.astype(float) @ have, z.T @ have, (z * z).T @ have, z.T @ z])

    cells = partial_sums(frames, ["recording"], ["x"], kernel).withColumn("k", F.floor(F.col("j") / c)).withColumn("j", F.col("j") % c)
    part = [F.max(F.when(F.col("k") == k, F.col("v"))).alias(n) for k, n in enumerate(("n", "s", "q", "p"))]
    one = cells.groupBy("recording", "i", "j").agg(*part)
    other = one.select("recording", F.col("j").alias("i"), F.col("i").alias("j"), F.col("s").alias("_s"), F.col("q").alias("_q"))
    var = lambda s, q: F.col("n") * F.col(q) - F.col(s) ** 2
    scale = F.sqrt(var("s", "q") * var("_s", "_q"))
    r = F.when(scale > 0, (F.col("n") * F.col("p") - F.col("s") * F.col("_s")) / scale).otherwise(0.0)
    return one.join(other, ["recording", "i", "j"]).select("recording", "i", "j", r.alias("r"))


def phase_amplitude(phase: DataFrame, amplitude: DataFrame, on: Sequence[str] = ("recording", "channel", "t"),
                    keys: Sequence[str] = KEY) -> DataFrame:
    """|mean(A e^(i phi))| / mean(A)."""
    j = phase.select(*on, "phase").join(amplitude.select(*on, "envelope"), list(on))
    a = F.col("envelope")
    s = j.groupBy(*keys).agg(F.avg(a * F.cos("phase")).alias("_c"), F.avg(a * F.sin("phase")).alias("_s"), F.avg(a).alias("_a"))
    return s.select(*keys, F.try_divide(F.hypot("_c", "_s"), F.col("_a")).alias("pac"))


def lagged_correlation(x: DataFrame, y: DataFrame, max_lag: int, key: str = "recording", block: int = 1 << 14) -> DataFrame:
    """Cross-correlation at lags -max_lag .. max_lag, centred, over the product of the full norms.

    Blocks of the first series meet the matching stretch of the second and
    send one sum per lag.
    """
    stat = lambda d, p: d.groupBy(key).agg(F.avg("value").alias(f"m{p}"), (F.stddev_pop("value") * F.sqrt(F.count("*"))).alias(f"n{p}"))
    sx, sy = cut(stat(x, "x")), cut(stat(y, "y"))
    left = attach(x, sx, [key], ["t"]).select(key, "t", (F.col("value") - F.col("mx")).alias("v"), F.lit(0).alias("side"))
    right = attach(y, sy, [key], ["t"]).select(key, "t", (F.col("value") - F.col("my")).alias("v"), F.lit(1).alias("side"))
    block = max(block, max_lag)
    own = left.withColumn("_blk", F.floor(F.col("t") / block)).unionByName(
        ordered.halo(right, [key], "t", max_lag, max_lag, block=block).drop("_own"))

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(k[1]) * block
        a, b = np.zeros(block), np.zeros(block + 2 * max_lag)
        p, q = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        a[p["t"].to_numpy() - start] = p["v"].to_numpy()
        b[q["t"].to_numpy() - start + max_lag] = q["v"].to_numpy()
        lags = np.arange(-max_lag, max_lag + 1)
        return pd.DataFrame({key: k[0], "lag": lags, "s": [a @ b[l + max_lag:l + max_lag + block] for l in lags]})

    kind = x.schema[key].dataType.simpleString()
    sums = own.groupBy(key, "_blk").applyInPandas(run, f"`{key}` {kind}, lag int, s double").groupBy(key, "lag").agg(F.sum("s").alias("s"))
    return sums.join(sx, key).join(sy, key).select(key, "lag", (F.col("s") / F.greatest(F.col("nx") * F.col("ny"), F.lit(1e-12))).alias("cc"))


BAND_ROWS, BAND_BINS = 1024, 256  # frames and bins whose waves are made at once


def band_csd(frames: DataFrame, targets: Sequence[float], fs: float, bandwidth: float = 4.0, key: str = "recording") -> DataFrame:
    """Mean of X X^H over the bins within bandwidth / 2 of each target, / (bins x T).

    Only the wanted bins are summed, inside each partition of the frames; the
    frames are not shuffled. Waves are made for ``BAND_ROWS`` frames and ``BAND_BINS`` bins at a time.
    """
    n = frames.groupBy(key).agg((F.max("t") + 1).alias("_n"))
    rows = attach(frames, n, [key], ["t"]).select(key, F.array(F.col("t").cast("double"), F.col("_n").cast("double")).alias("tn"), "x")

    def kernel(tn: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, c = tn[0, 1], x.shape[1]
        f = np.arange(int(size) // 2 + 1) * fs / size
        ks = np.flatnonzero(np.any([np.abs(f - target) < bandwidth / 2 for target in targets], axis=0))
        out = np.zeros((len(ks), 2 * c))
        for lo in range(0, len(x), BAND_ROWS):
            t, y = tn[lo:lo + BAND_ROWS, 0], x[lo:lo + BAND_ROWS]
            for at in range(0, len(ks), BAND_BINS):
                angle = np.mod(np.outer(ks[at:at + BAND_BINS], t), size) * (2 * np.pi / size)
                out[at:at + BAND_BINS, :c] += np.cos(angle) @ y
                out[at:at + BAND_BINS, c:] -= np.sin(angle) @ y
        return ks, out

    width = F.col("_w")
    per = partial_rows(rows, [key], ["tn", "x"], kernel).join(n, key).withColumn("_w", (F.size("row") / 2).cast("int"))
    per = per.select(key, "_n", F.col("i").alias("k"), F.slice("row", F.lit(1), width).alias("re"), F.slice("row", width + 1, width).alias("im"))
    want = F.array(*[F.lit(float(t)) for t in targets])
    per = per.withColumn("freq", F.explode(want)).where(F.abs(F.col("k") * fs / F.col("_n") - F.col("freq")) < bandwidth / 2)
    bins = per.groupBy(key, "freq", "_n").agg(F.count("*").alias("_b"))
    g = complex_gram(per, [key, "freq"]).join(bins, [key, "freq"])
    s = F.col("_b") * F.col("_n")
    return g.select(key, "freq", "i", "j", (F.col("re") / s).alias("re"), (F.col("im") / s).alias("im"))


# ---------------------------------------------------------------- state spectra


def autocovariance(cov: DataFrame, n_channels: int, keys: Sequence[str] = ()) -> DataFrame:
    """Lag-k mean of the blocks of an embedded covariance: ``keys, lag, c1, c2, v``."""
    c = F.lit(n_channels)
    lag = F.floor(F.col("j") / c) - F.floor(F.col("i") / c)
    return cov.withColumn("lag", lag.cast("int")).where("lag >= 0").groupBy(
        *keys, "lag", (F.col("i") % c).alias("c1"), (F.col("j") % c).alias("c2")).agg(F.avg("v").alias("v"))


def autocov_spectrum(autocov: DataFrame, n_lags: int, fs: float, keys: Sequence[str] = (), shifted: bool = False) -> DataFrame:
    """Cross-spectra of an autocovariance: ``keys, k, freq, i, j, re, im, coherence``.

    By default the two-sided sequence is transformed from its first element,
    which leaves a linear phase; ``shifted`` puts lag 0 first instead.
    """
    keys = list(keys)
    size = 2 * n_lags - 1
    back = autocov.where("lag > 0").select(*keys, (-F.col("lag")).alias("lag"), F.col("c2").alias("c1"), F.col("c1").alias("c2"), "v")
    full = autocov.select(*keys, "lag", "c1", "c2", "v").unionByName(back)
    full = full.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size // 2))))
    pos = F.col("lag") if shifted else F.col("lag") + (n_lags - 1)
    phi = 2 * math.pi * F.col("k") * pos / size
    s = full.groupBy(*keys, "k", F.col("c1").alias("i"), F.col("c2").alias("j")).agg(
        (F.sum(F.col("v") * F.cos(phi)) / fs).alias("re"), (-F.sum(F.col("v") * F.sin(phi)) / fs).alias("im"))
    return coherence(s, [*keys, "k"]).withColumn("freq", F.col("k") * fs / size)


def state_spectra(state_cov: DataFrame, components: DataFrame, n_channels: int, n_lags: int, fs: float) -> DataFrame:
    """Per state: covariance back from component space, autocovariance, spectra. ``components`` has cells (component i, dimension j)."""
    comp = components.select(F.col("i").alias("_p"), F.col("j").alias("_d"), F.col("v").alias("_v"))
    left = state_cov.join(comp.select(F.col("_p").alias("i"), F.col("_d").alias("a"), F.col("_v").alias("_a")), "i").groupBy(
        "state", "a", "j").agg(F.sum(F.col("v") * F.col("_a")).alias("v"))
    full = left.join(comp.select(F.col("_p").alias("j"), F.col("_d").alias("b"), F.col("_v").alias("_b")), "j").groupBy(
        "state", F.col("a").alias("i"), F.col("b").alias("j")).agg(F.sum(F.col("v") * F.col("_b")).alias("v"))
    s = autocov_spectrum(autocovariance(full, n_channels, ["state"]), n_lags, fs, ["state"])
    return s.withColumn("psd", F.when(F.col("i") == F.col("j"), F.greatest("re", F.lit(0.0))))


def regression_spectra(power: DataFrame, mixing: DataFrame, key: str = "recording") -> DataFrame:
    """Per-state spectra (A^T A + 1e-6 I)^-1 A^T S; ``mixing`` has ``win, state, p``, ``power`` has ``win, channel, k, power``."""
    a = mixing.select(key, "win", F.col("state").alias("i"), F.col("p").alias("_a"))
    b = mixing.select(key, "win", F.col("state").alias("j"), F.col("p").alias("_b"))
    ata = a.join(b, [key, "win"]).groupBy(key, "i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))
    kind = mixing.schema[key].dataType.simpleString()

    def invert(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf["i"])
        m = pdf.pivot(index="i", columns="j", values="v").fillna(0.0).to_numpy()
        inv = np.linalg.inv(m + 1e-6 * np.eye(len(ids)))
        return pd.DataFrame({key: k[0], "state": np.repeat(ids, len(ids)), "i": np.tile(ids, len(ids)), "_g": inv.ravel()})

    inv = ata.groupBy(key).applyInPandas(invert, f"`{key}` {kind}, state int, i int, _g double")
    aty = power.join(a, [key, "win"]).groupBy(key, "channel", "k", "i").agg(F.sum(F.col("_a") * F.col("power")).alias("_y"))
    return aty.join(inv, [key, "i"]).groupBy(key, "state", "channel", "k").agg(F.sum(F.col("_g") * F.col("_y")).alias("psd"))


# --------------------------------------------------------- decay-signal spectra


def _arrays(fids: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    p = fids.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", F.col("s.re").alias("re"), F.col("s.im").alias("im")))).alias("_c"))
    return p.select(*keys, F.col("_c.re").alias(f"{prefix}re"), F.col("_c.im").alias(f"{prefix}im"))


def spectral_registration(fids: DataFrame, reference: DataFrame, dwell: float, low: float = 1.8, high: float = 4.2,
                          centre_hz: float = 123.0e6, keys: Sequence[str] = ("acq", "edit", "dyn"), on: Sequence[str] = ("acq",)) -> DataFrame:
    """Frequency and phase correction of each transient against the reference: ``keys, df, dp``.

    201 shifts within ±20 Hz are tried; the phase of each comes from the cross
    spectrum in the ppm range and the smallest residual wins.
    """
    pair = _arrays(fids, keys).join(_arrays(reference, on, "ref_"), list(on))
    grid = np.linspace(-20, 20, 201)

    @F.pandas_udf("df double, dp double")
    def best(re: pd.Series, im: pd.Series, rr: pd.Series, ri: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c, d in zip(re, im, rr, ri):
            z, ref = np.asarray(a) + 1j * np.asarray(b), np.asarray(c) + 1j * np.asarray(d)
            n = len(z)
            ppm = np.fft.fftfreq(n, dwell) / (centre_hz / 1e6) + 4.65
            mask = (ppm >= low) & (ppm <= high)
            r = np.fft.fft(ref)[mask]
            s = np.fft.fft(z * np.exp(2j * np.pi * np.outer(grid, np.arange(n) * dwell)), axis=1)[:, mask]
            phi = -np.angle(s @ r.conj())
            cost = np.sum(np.abs(r - s * np.exp(1j * phi)[:, None]) ** 2, axis=1)
            w = int(np.argmin(cost))
            out.append((grid[w], phi[w]))
        return pd.DataFrame(out, columns=["df", "dp"])

    return pair.select(*keys, best("re", "im", "ref_re", "ref_im").alias("_b")).select(*keys, "_b.df", "_b.dp")


def zero_order_phase(spectra: DataFrame, keys: Sequence[str], start: float = -math.pi, step: float = math.pi / 180) -> DataFrame:
    """Phase (radians) on a grid of one turn that maximises the summed real part.

    The sum over bins is rotated, not the bins, and a rotated sum is largest at
    the grid point nearest to minus its angle. ``start=0`` gives the 0 - 359 degree grid.
    """
    s = spectra.groupBy(*keys).agg(F.sum("re").alias("_r"), F.sum("im").alias("_i"))
    turns = round(2 * math.pi / step)
    index = F.pmod(F.round(F.pmod(-F.atan2("_i", "_r") - start, F.lit(2 * math.pi)) / step), F.lit(turns))
    return s.select(*keys, (start + index * step).alias("phase"))


def first_order_phase(spectra: DataFrame, keys: Sequence[str], pivot: float = 2.02) -> DataFrame:
    """Zero-order phase, then the slope (degrees per ppm, 721 steps) with the flattest baseline."""
    keys = list(keys)
    packed = spectra.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "ppm", "re", "im"))).alias("_c"))
    alphas = np.arange(-180, 180.5, 0.5)

    @F.pandas_udf("phase0 double, phase1 double")
    def fit(ppm: pd.Series, re: pd.Series, im: pd.Series) -> pd.DataFrame:
        out = []
        for p, a, b in zip(ppm, re, im):
            p, z = np.asarray(p, dtype=float), np.asarray(a) + 1j * np.asarray(b)
            turn = np.deg2rad(np.arange(360))
            best = int(np.argmax((z.sum() * np.exp(1j * turn)).real))
            z = z * np.exp(1j * turn[best])
            base = (p < 0.5) | (p > 8.0)
            if base.sum() < 5:
                i = np.arange(len(p))
                base = (i < int(0.05 * len(p))) | (i > int(0.95 * len(p)))
            ramp = np.exp(-1j * np.outer(np.deg2rad(alphas), (p - pivot)[base]))
            spread = (z[base] * ramp).real.std(axis=1)
            out.append((float(best), float(alphas[int(np.argmin(spread))])))
        return pd.DataFrame(out, columns=["phase0", "phase1"])

    return packed.select(*keys, fit("_c.ppm", "_c.re", "_c.im").alias("_f")).select(*keys, "_f.phase0", "_f.phase1")


def sensitivity_combine(fids: DataFrame, acq: Sequence[str] = ("acq",)) -> DataFrame:
    """Coils weighted by their mean first point and phased to coil 0; ``fids`` has ``coil``."""
    acq = list(acq)
    m = fids.where("n = 0").groupBy(*acq, "coil").agg(F.avg("s.re").alias("_r"), F.avg("s.im").alias("_i"))
    w = W.partitionBy(*acq)
    mod, ang = F.hypot("_r", "_i"), F.atan2("_i", "_r")
    ref = F.min_by(ang, F.col("coil")).over(w)
    m = m.select(*acq, "coil", (mod / F.sum(mod).over(w)).alias("_w"), (-(ang - ref)).alias("_p"))
    j = fids.join(m, [*acq, "coil"]).withColumn("s", cx.scale(cx.multiply(F.col("s"), cx.unit(F.col("_p"))), F.col("_w")))
    return _sum_coils(j)


def svd_combine(fids: DataFrame, acq: Sequence[str] = ("acq",), first_only: bool = True) -> DataFrame:
    """Coils weighted by the leading singular vector of the coil Gram, phased to coil 0.

    ``first_only`` takes the Gram of the first transient, else of all.
    """
    acq = list(acq)
    src = fids
    if first_only:
        head = fids.groupBy(*acq).agg(F.min(F.struct("edit", "dyn")).alias("_h"))
        src = fids.join(head, acq).where((F.col("edit") == F.col("_h.edit")) & (F.col("dyn") == F.col("_h.dyn"))).drop("_h")
    rows = src.groupBy(*acq, "edit", "dyn", "n").agg(F.sort_array(F.collect_list(F.struct("coil", "s"))).alias("_c")).select(
        *acq, F.col("_c.s.re").alias("re"), F.col("_c.s.im").alias("im"))
    g = complex_gram(rows, acq)
    ddl = ", ".join(f"`{k}` {fids.schema[k].dataType.simpleString()}" for k in acq)

    def lead(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["i"].max()) + 1
        m = np.zeros((n, n), dtype=complex)
        m[pdf["i"], pdf["j"]] = pdf["re"] + 1j * pdf["im"]
        u = np.linalg.eigh(m)[1][:, -1].conj()
        u = u * np.exp(-1j * np.angle(u[0]))
        out = pd.DataFrame({"coil": np.arange(n, dtype=np.int32), "_wr": u.real, "_wi": u.imag})
        for k, v in zip(acq, key):
            out[k] = v
        return out

    w = g.groupBy(*acq).applyInPandas(lead, f"{ddl}, coil int, _wr double, _wi double")
    j = fids.join(w, [*acq, "coil"]).withColumn("s", cx.multiply(F.col("s"), cx.pack(F.col("_wr"), F.col("_wi"))))
    return _sum_coils(j)


def _sum_coils(j: DataFrame) -> DataFrame:
    keys = [c for c in j.columns if c in ("acq", "edit", "dyn", "n")]
    return j.groupBy(*keys).agg(F.sum("s.re").alias("_re"), F.sum("s.im").alias("_im")).select(
        *keys, cx.pack(F.col("_re"), F.col("_im")).alias("s"))


def edited_spectroscopy(fids: DataFrame, dwell: float, threshold: float = 3.0, combine: bool = True) -> DataFrame:
    """Combine coils, align every OFF transient, share its correction with the ON partner, drop outliers, average and subtract."""
    from ondula.operators.joins import correct_pairs
    one = cut(svd_combine(fids) if combine else fids)
    ref = one.where("edit = 0").groupBy("acq", "n").agg(F.avg("s.re").alias("re"), F.avg("s.im").alias("im")).select(
        "acq", "n", cx.pack(F.col("re"), F.col("im")).alias("s"))
    shifts = spectral_registration(one.where("edit = 0"), ref, dwell, keys=("acq", "dyn"))
    aligned = cut(correct_pairs(one, shifts, ["acq"], dwell))
    bad = transient_outliers(aligned, ["acq", "edit"], threshold).where("rejected").select("acq", "edit", "dyn")
    return average_edits(aligned.join(bad, ["acq", "edit", "dyn"], "left_anti"))


def split_components(frames: DataFrame, level_wave: float = 0.5, level_spike: float = 0.5, n_iter: int = 50, x: str = "x") -> DataFrame:
    """Split each array into an oscillating and a transient part by alternating soft thresholds.

    An odd length loses its last sample, as the half spectrum must be exact.
    """

    @F.pandas_udf("wave array<double>, spike array<double>")
    def solve(rows: pd.Series) -> pd.DataFrame:
        waves, spikes = [], []
        for v in rows:
            d = np.asarray(v, dtype=float)
            d = d[:len(d) // 2 * 2]
            spike = np.zeros_like(d)
            for _ in range(n_iter):
                c = np.fft.rfft(d - spike, norm="ortho")
                wave = np.fft.irfft(c * np.maximum(0.0, 1 - level_wave / (np.abs(c) + 1e-12)), n=len(d), norm="ortho")
                r = d - wave
                spike = r * np.maximum(0.0, 1 - level_spike / (np.abs(r) + 1e-12))
            waves.append(wave)
            spikes.append(spike)
        return pd.DataFrame({"wave": waves, "spike": spikes})

    return frames.withColumn("_p", solve(x)).select(*[c for c in frames.columns if c != x], "_p.wave", "_p.spike")


