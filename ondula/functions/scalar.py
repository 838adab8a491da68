"""Column expressions for spectra, relaxometry, perfusion and statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.functions import complex as cx
from ondula.operators.attach import attach
from ondula.operators.quantiles import quantiles

# ------------------------------------------------------------ decay signals, ppm


def exponential_window(s: Column, t: Column, hz: float) -> Column:
    return s if hz == 0 else cx.scale(s, F.exp(-math.pi * hz * t))


def gaussian_window(s: Column, t: Column, hz: float) -> Column:
    return s if hz == 0 else cx.scale(s, F.exp(-(math.pi * hz) ** 2 * t * t / (4 * math.log(2))))


def eddy_correction(fids: DataFrame, water: DataFrame, on: Sequence[str]) -> DataFrame:
    """Take the water phase off each point."""
    w = water.select(*on, F.col("s").alias("_w"))
    return fids.join(w, list(on)).withColumn("s", cx.multiply(F.col("s"), cx.unit(-cx.angle(F.col("_w"))))).drop("_w")


def bin_hz(k: Column, n: Column, dwell: float) -> Column:
    """Frequency of shifted bin k of n."""
    low = F.floor(n / 2)
    return (k - low) / (n * dwell)


def ppm_up(k: Column, n: Column, dwell: float, centre_hz: float) -> Column:
    """4.65 + f / centre: the quantification axis."""
    return bin_hz(k, n, dwell) / (centre_hz / 1e6) + 4.65


def ppm_down(k: Column, n: Column, dwell: float, centre_mhz: float) -> Column:
    """4.7 - f / centre: the display axis, of opposite sign."""
    return 4.7 - bin_hz(k, n, dwell) / centre_mhz


# Water content and relaxation times (T1, T2 in s) per tissue below and from 5 T.
WATER_CONTENT = {"gm": 0.78, "wm": 0.65, "csf": 0.97}
WATER_TIMES = {
    "low": {"gm": (1.33, 0.110), "wm": (0.83, 0.080), "csf": (4.16, 1.650)},
    "high": {"gm": (2.13, 0.045), "wm": (1.22, 0.027), "csf": (4.43, 0.800)},
}
PURE_WATER_MM = 55556.0


def water_concentration(metabolite: Column, water: Column, gm: Column, wm: Column, csf: Column, te: float, tr: float,
                        t1: float, t2: float, field: float = 3.0) -> Column:
    """Metabolite concentration (mM) against the tissue water; no water or no tissue is an error."""
    times = WATER_TIMES["low" if field < 5 else "high"]
    seen = lambda f, name: f * WATER_CONTENT[name] * (1 - math.exp(-tr / times[name][0])) * math.exp(-te / times[name][1])
    visible = seen(gm, "gm") + seen(wm, "wm") + seen(csf, "csf")
    relaxed = (1 - math.exp(-tr / t1)) * math.exp(-te / t2)
    value = metabolite / water * (visible / relaxed) * PURE_WATER_MM / (gm + wm)
    return F.when(water == 0, F.raise_error(F.lit("water area must not be zero")).cast("double")).when(
        gm + wm == 0, F.raise_error(F.lit("no tissue fraction")).cast("double")).otherwise(value)


def spectral_snr(spectra: DataFrame, keys: Sequence[str], signal=(2.8, 3.2), noise=(8.0, 10.0)) -> DataFrame:
    """Largest real part in the signal range over the deviation in the noise range.

    A spectrum without bins in one of the ranges uses the middle half and the
    first eighth instead; a flat noise range gives infinity.
    """
    sig, noi = F.col("ppm").between(*signal), F.col("ppm").between(*noise)
    mid = (F.col("bin") >= F.floor(F.col("n") / 4)) & (F.col("bin") < F.floor(3 * F.col("n") / 4))
    head = F.col("bin") < F.floor(F.col("n") / 8)
    top = lambda c: F.max(F.when(c, F.abs("re")))
    dev = lambda c: F.stddev_pop(F.when(c, F.col("re")))
    s = spectra.groupBy(*keys).agg(top(sig).alias("_s"), dev(noi).alias("_n"), top(mid).alias("_fs"), dev(head).alias("_fn"))
    whole = F.col("_s").isNotNull() & F.col("_n").isNotNull()
    num, den = F.when(whole, F.col("_s")).otherwise(F.col("_fs")), F.when(whole, F.col("_n")).otherwise(F.col("_fn"))
    return s.select(*keys, F.when(den == 0, float("inf")).otherwise(num / den).alias("snr"))


# ------------------------------------------------------------------ MR signals


def relaxed(time, tau: Column) -> Column:
    """exp(-time / tau), 0 for the empty voxels with tau = 0."""
    return F.coalesce(F.exp(F.try_divide(-time if isinstance(time, Column) else F.lit(-float(time)), tau)), F.lit(0.0))


def spgr(m0: Column, t1: Column, flip: Column, tr: float) -> Column:
    e1 = relaxed(tr, t1)
    return m0 * F.sin(flip) * (1 - e1) / (1 - e1 * F.cos(flip))


def bssfp(m0: Column, t1: Column, t2: Column, flip: Column, tr: float) -> Column:
    e1, e2 = relaxed(tr, t1), relaxed(tr, t2)
    return F.abs(m0 * F.sin(flip) * (1 - e1) * F.sqrt(e2) / (1 - (e1 - e2) * F.cos(flip) - e1 * e2))


def ir_spgr(m0: Column, t1: Column, flip: Column, tr: float, ti: Column, efficiency: float = 1.0) -> Column:
    e_tr, e_ti = relaxed(tr, t1), relaxed(ti, t1)
    return m0 * F.sin(flip) * F.abs(1 - (1 + efficiency) * e_ti + e_tr) / (1 - e_tr * F.cos(flip))


def echo_decay(s0: Column, t2s: Column, te: Column) -> Column:
    return s0 * relaxed(te, t2s)


def uniform_image(t1: Column, ti1: float, ti2: float, flip1: float, flip2: float) -> Column:
    s1 = math.sin(flip1) * (1 - 2 * relaxed(ti1, t1))
    s2 = math.sin(flip2) * (1 - 2 * relaxed(ti2, t1))
    return s1 * s2 / (s1 * s1 + s2 * s2 + 1e-10)


def oxygen_decay(s0: Column, r2: Column, r2p: Column, te: Column) -> Column:
    return s0 * F.exp(-te * (r2 + r2p))


# Proton gyromagnetic ratio (rad/s/T), susceptibility difference, field (T), haematocrit.
GAMMA, DELTA_CHI, B0, HAEMATOCRIT = 267.522e6, 0.264e-6, 3.0, 0.42


def extraction_fraction(r2p: Column, dbv: float = 0.03, hct: float = HAEMATOCRIT, b0: float = B0) -> Column:
    k = 4 / 3 * math.pi * GAMMA * DELTA_CHI * hct * dbv * b0
    return F.least(F.greatest(r2p / max(k, 1e-10), F.lit(0.0)), F.lit(1.0))


def oxygen_metabolism(cbf: Column, oef: Column, hb: float = 15.0, sao2: float = 0.98, clip: bool = False) -> Column:
    """CBF x OEF x arterial oxygen content; the map form is clipped to 0 - 500."""
    v = cbf * oef * (hb * 1.34 * sao2 / 100 / 0.0224)
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(500.0)) if clip else v


def corrected_flip(flip: Column, b1: Column) -> Column:
    return flip * b1


def corrected_t1(t1: Column, b1: Column, flip_deg: float = 10.0) -> Column:
    a = math.radians(flip_deg)
    return t1 * F.least(F.greatest(F.try_divide(F.lit(math.tan(a)), F.tan(a * b1)), F.lit(0.5)), F.lit(2.0))


def transfer_ratio(off: Column, on: Column, mask: Column) -> Column:
    ok = mask & (off > 10)
    return F.when(ok, F.least(F.greatest((off - on) / off, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def g_ratio(bpf: Column) -> Column:
    mvf = F.least(F.greatest(bpf * 1.86, F.lit(0.0)), F.lit(0.5))
    return F.when(mvf > 0.01, F.least(F.greatest(F.sqrt(1 - mvf), F.lit(0.5)), F.lit(1.0))).otherwise(0.0)


# 1/T2 = A + B (1 - Y) + C (1 - Y)^2 for blood, arterial saturation, default extraction fraction.
BLOOD_A, BLOOD_B, BLOOD_C = 4.50, 47.1, 55.5
ARTERIAL, DEFAULT_OEF = 0.98, 0.35


def venous_oxygen(t2: Column) -> Column:
    """Venous saturation and extraction fraction from blood T2 (s); defaults when the quadratic has no root."""
    disc = BLOOD_B ** 2 - 4 * BLOOD_C * (BLOOD_A - F.try_divide(F.lit(1.0), t2))
    svo2 = 1 - (-BLOOD_B + F.sqrt(disc)) / (2 * BLOOD_C)
    oef = (ARTERIAL - svo2) / ARTERIAL
    return F.struct(F.when(disc >= 0, svo2).otherwise(ARTERIAL * (1 - DEFAULT_OEF)).alias("svo2"),
                    F.when(disc >= 0, oef).otherwise(DEFAULT_OEF).alias("oef"))


# Conductivity (S/m) of head tissues and structures by label.
CONDUCTIVITY = {
    0: ("Unknown", 0.0), 911: ("Skin", 0.465), 907: ("Other-Tissues", 0.25), 915: ("Bone-Cortical", 0.006),
    916: ("Bone-Cancellous", 0.025), 24: ("CSF", 1.654), 914: ("Vein", 0.7), 902: ("Artery", 0.7), 126: ("Spinal-Cord", 0.126),
    262: ("Sinus", 1.0), 909: ("Mucosa", 0.35), 908: ("Rectus-Muscles", 0.35), 259: ("Eye-Fluid", 1.5), 930: ("Optic-Nerve", 0.126),
    2: ("Left-Cerebral-WM", 0.126), 41: ("Right-Cerebral-WM", 0.126), 3: ("Left-Cerebral-Cortex", 0.276),
    42: ("Right-Cerebral-Cortex", 0.276), 7: ("Left-Cerebellum-WM", 0.126), 46: ("Right-Cerebellum-WM", 0.126),
    8: ("Left-Cerebellum-Cortex", 0.276), 47: ("Right-Cerebellum-Cortex", 0.276), 16: ("Brain-Stem", 0.126),
    10: ("Left-Thalamus", 0.276), 49: ("Right-Thalamus", 0.276), 11: ("Left-Caudate", 0.276), 50: ("Right-Caudate", 0.276),
    12: ("Left-Putamen", 0.276), 51: ("Right-Putamen", 0.276), 13: ("Left-Pallidum", 0.126), 52: ("Right-Pallidum", 0.126),
    17: ("Left-Hippocampus", 0.276), 53: ("Right-Hippocampus", 0.276), 18: ("Left-Amygdala", 0.276), 54: ("Right-Amygdala", 0.276),
    26: ("Left-Accumbens", 0.276), 58: ("Right-Accumbens", 0.276), 28: ("Left-VentralDC", 0.276), 60: ("Right-VentralDC", 0.276),
    4: ("Left-Lateral-Ventricle", 1.654), 43: ("Right-Lateral-Ventricle", 1.654), 5: ("Left-Inf-Lat-Vent", 1.654),
    44: ("Right-Inf-Lat-Vent", 1.654), 14: ("3rd-Ventricle", 1.654), 15: ("4th-Ventricle", 1.654), 192: ("Corpus-Callosum", 0.126),
    77: ("WM-hypointensities", 0.126), 85: ("Optic-Chiasm", 0.126), 30: ("Left-vessel", 0.7), 62: ("Right-vessel", 0.7),
    31: ("Left-choroid-plexus", 1.0), 63: ("Right-choroid-plexus", 1.0), 34: ("Left-WMCrowns", 0.126), 66: ("Right-WMCrowns", 0.126),
    183: ("Left-Vermis-Area", 0.276), 184: ("Right-Vermis-Area", 0.276), 267: ("Pons-Belly-Area", 0.126),
    11300: ("ctx_lh_high_myelin", 0.276), 12300: ("ctx_rh_high_myelin", 0.276), 80: ("non-WM-hypointensities", 0.276),
}


def conductivity_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, n, s) for k, (n, s) in CONDUCTIVITY.items()], "label_id int, name string, sigma double")


# ------------------------------------------------------------- spectra and statistics


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def spectral_model(freq: Column, offset: Column, exponent: Column, peaks: Column, knee: Column | None = None) -> Column:
    """Aperiodic part plus Gaussian peaks ``array<struct<cf,pw,bw>>`` in log10 power.

    Without a knee: offset - exponent log10 f. With one: offset - log10(knee + f^exponent)
    on softplus parameters and peaks at least 0.1 wide.
    """
    if knee is None:
        base = offset - exponent * F.log10(freq)
        width = lambda p: softplus(p["bw"])
    else:
        base = offset - F.log10(softplus(knee) + F.pow(F.greatest(freq, F.lit(1e-5)), softplus(exponent)))
        width = lambda p: softplus(p["bw"]) + 0.1
    gauss = lambda p: softplus(p["pw"]) * F.exp(-(freq - p["cf"]) * (freq - p["cf"]) / (2 * width(p) * width(p)))
    return base + F.aggregate(peaks, F.lit(0.0), lambda s, p: s + gauss(p))


def _normal(x: Column, mu: float, var: float) -> Column:
    return F.exp(-(x - mu) * (x - mu) / (2 * var)) / math.sqrt(2 * math.pi * var)


def _gamma(x: Column, shape: float, scale: float) -> Column:
    const = -math.lgamma(shape) - shape * math.log(scale)
    return F.when(x > 0, F.exp((shape - 1) * F.log(x) - x / scale + const)).otherwise(0.0)


def mixture_density(x: Column, w_gauss: float, w_pos: float, w_neg: float, var: float, shape: float, scale: float, mu: float) -> Column:
    """Gaussian background with a gamma tail on each side."""
    return w_gauss * _normal(x, mu, var) + w_pos * _gamma(x - mu, shape, scale) + w_neg * _gamma(mu - x, shape, scale)


def mixture_posteriors(x: Column, w_gauss: float, w_pos: float, w_neg: float, var: float, shape: float, scale: float, mu: float) -> Column:
    g, p, n = w_gauss * _normal(x, mu, var), w_pos * _gamma(x - mu, shape, scale), w_neg * _gamma(mu - x, shape, scale)
    total = g + p + n + 1e-12
    return F.struct((g / total).alias("background"), (p / total).alias("positive"), (n / total).alias("negative"))


def robust_z(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """z = (x - median) / (IQR / 1.349), with the median and scale."""
    q = quantiles(values, keys, value, {"_q1": 0.25, "mu": 0.5, "_q3": 0.75})
    q = q.select(*keys, "mu", ((F.col("_q3") - F.col("_q1")) / 1.349).alias("sigma"))
    return attach(values, q, keys, [value]).withColumn("z", F.try_divide(F.col(value) - F.col("mu"), F.col("sigma")))


def tangent_entries(cells: DataFrame) -> DataFrame:
    """Upper triangle with the off-diagonal scaled by sqrt 2."""
    return cells.where("i <= j").withColumn("v", F.when(F.col("i") < F.col("j"), F.col("v") * math.sqrt(2)).otherwise(F.col("v")))


def survival(x: Column) -> Column:
    """Upper tail of the standard normal: a power series up to 5, a continued fraction beyond."""
    a = F.abs(x)
    ks = F.sequence(F.lit(1), F.lit(100))
    start = F.struct(a.alias("term"), a.alias("sum"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * a * a / (2 * k + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    dens = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    near = 0.5 - dens * F.aggregate(ks, start, add, lambda s: s["sum"])
    far = dens / F.aggregate(F.sequence(F.lit(40), F.lit(1)), a, lambda f, k: a + k / f)
    tail = F.when(a < 5, near).otherwise(far)
    return F.when(x >= 0, tail).otherwise(1 - tail)


def euler_density(t: Column, dim: int) -> Column:
    """Euler-characteristic density of a Gaussian field in 0, 1 or 2 dimensions."""
    if dim == 0:
        return survival(t)
    if dim == 1:
        return math.sqrt(4 * math.log(2)) / (2 * math.pi) * F.exp(-t * t / 2)
    if dim == 2:
        return 4 * math.log(2) / (2 * math.pi) ** 1.5 * F.exp(-t * t / 2) * t
    raise NotImplementedError("only 0, 1 and 2 dimensions")


def field_p(maps: DataFrame, keys: Sequence[str], resels: float, dim: int = 2, value: str = "value") -> DataFrame:
    """Corrected p of the map maximum: min(resels x density(max), 1)."""
    top = maps.groupBy(*keys).agg(F.max(value).alias("top"))
    return top.withColumn("p", F.least(resels * euler_density(F.col("top"), dim), F.lit(1.0)))


def inject(samples: DataFrame, signal: DataFrame, pattern: DataFrame) -> DataFrame:
    """x + pattern(channel) * s(t), the pattern scaled to a largest magnitude of 1."""
    top = pattern.agg((F.max(F.abs("weight")) + 1e-20).alias("_top"))
    p = pattern.join(F.broadcast(top), how="inner").select("channel", (F.col("weight") / F.col("_top")).alias("_w"))
    s = signal.select("t", F.col("value").alias("_s"))
    j = samples.join(p, "channel", "left").join(s, "t", "left")
    add = F.coalesce(F.col("_w") * F.col("_s"), F.lit(0.0))
    return j.select(*samples.columns, add.alias("injected")).withColumn("value", F.col("value") + F.col("injected"))


def hann(n: Column, length: int, periodic: bool) -> Column:
    return 0.5 * (1 - F.cos(2 * math.pi * n / (length if periodic else length - 1)))


def gaussian_kernel(n: Column, length: int, sigma: float) -> Column:
    d = n - (length - 1) / 2
    return F.exp(-d * d / (2 * sigma * sigma))
