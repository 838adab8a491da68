"""Spectral queries. Small limits and blocks make the split forms part of every check."""

from pyspark.sql import functions as F

from ondula.functions import complex as cx
from ondula.operators import spectral as S
from ondula.operators.gram import gram
from ondula.operators.windows import centre_mixing, slide
from ondula.plans import adapters as ad
from ondula.plans.adapters import with_
from ondula.plans.registry import query
from ondula.plans.windows import WINDOWS

ANG = "(2 * pi() * ((k * t) % n) / n)"
DFT = (", f AS (SELECT channel, n, k, sum(value * cos({a})) AS re, -sum(value * sin({a})) AS im FROM series JOIN sn USING (channel), "
       "(SELECT unnest(range((SELECT max(n) // 2 + 1 FROM sn))) AS k) WHERE k <= n // 2 GROUP BY 1, 2, 3)").format(a=ANG)
BACK = (", b AS (SELECT s.channel, s.t, sum(g * (re * cos({a}) - im * sin({a}))) / any_value(n) AS re, sum(g * (re * sin({a}) + im * cos({a}))) / any_value(n) AS im "
        "FROM series s JOIN g USING (channel) GROUP BY 1, 2)").format(a=ANG)
TWO = "CASE WHEN k = 0 OR 2 * k = n THEN 1.0 ELSE 2.0 END"


@query("spc_01_spectrum", "channel k:l freq:6 re:4 im:4", with_("series", "sn") + DFT + " SELECT channel, k, k * 250.0 / n AS freq, re, im FROM f")
def _(spark, sf):
    return S.spectrum(ad.series(spark, sf), 250.0, limit=512)


def _samples(spark, sf):
    return ad.samples(spark, sf)


SPEC = with_("samples") + f", w AS ({WINDOWS.format(w=32, s=16)}), x AS (SELECT win, channel, t - win * 16 AS p, value FROM w) "


@query("spc_02_spectrogram", "win:l channel:l k:l freq:4 time:4 power:9",
       SPEC + "SELECT win, channel, k, k * 250.0 / 32 AS freq, (win * 16 + 16) / 250.0 AS time, (power(sum(value * h * cos(2 * pi() * k * p / 32)), 2) + power(sum(value * h * sin(2 * pi() * k * p / 32)), 2)) / (250.0 * 32) AS power "
       "FROM (SELECT *, 0.5 * (1 - cos(2 * pi() * p / 32)) AS h FROM x), (SELECT unnest(range(17)) AS k) GROUP BY 1, 2, 3")
def _(spark, sf):
    return S.spectrogram(_samples(spark, sf), 250.0, 32, 16)


def _taper_values(width, bandwidth):
    t = S.tapers(width, bandwidth)
    rows = ", ".join(f"({i}, {p}, CAST({float(t[i, p])!r} AS DOUBLE))" for i in range(len(t)) for p in range(width))
    return f"tp AS (SELECT * FROM (VALUES {rows}) v(taper, p, w))"


TAPER = with_("samples") + f", {_taper_values(64, 3.0)}, w AS ({WINDOWS.format(w=64, s=64)}), x AS (SELECT win, channel, t - win * 64 AS p, value FROM w), " \
    "z AS (SELECT win, channel, taper, k, sum(value * w * cos(2 * pi() * k * p / 64)) AS re, -sum(value * w * sin(2 * pi() * k * p / 64)) AS im FROM x JOIN tp USING (p), (SELECT unnest(range(33)) AS k) GROUP BY 1, 2, 3, 4) "


@query("spc_03_multitaper_power", "channel:l k:l power:9",
       TAPER + "SELECT channel, k, avg(re * re + im * im) / (250.0 * 64) * CASE WHEN k BETWEEN 1 AND 31 THEN 2 ELSE 1 END AS power FROM z GROUP BY 1, 2")
def _(spark, sf):
    return S.static_power(_samples(spark, sf), 250.0, 64, 3.0)


@query("spc_04_cross_spectrum", "k:l i:l j:l re:9 im:9 coherence:6",
       TAPER + ", zz AS MATERIALIZED (SELECT * FROM z), c AS (SELECT a.k, a.channel AS i, b.channel AS j, avg(a.re * b.re + a.im * b.im) AS re, avg(a.im * b.re - a.re * b.im) AS im FROM zz a JOIN zz b USING (win, taper, k) GROUP BY 1, 2, 3), "
       "s AS MATERIALIZED (SELECT k, i, j, re * s AS re, im * s AS im FROM (SELECT *, CASE WHEN k BETWEEN 1 AND 31 THEN 2 ELSE 1 END / (250.0 * 64) AS s FROM c)) "
       "SELECT s.k, s.i, s.j, s.re, s.im, least(greatest((s.re * s.re + s.im * s.im) / greatest(p.re * q.re, 1e-20), 0), 1) AS coherence FROM s JOIN s p ON p.k = s.k AND p.i = s.i AND p.j = s.i JOIN s q ON q.k = s.k AND q.i = s.j AND q.j = s.j")
def _(spark, sf):
    return S.cross_spectrum(_samples(spark, sf), 250.0, 64, bandwidth=3.0)


ANALYTIC = with_("series", "sn") + DFT + f", g AS (SELECT *, {TWO} AS g FROM f)" + BACK


@query("spc_05_analytic_signal", "channel t:l re:6 im:5 envelope:5", ANALYTIC + " SELECT channel, t, re, im, sqrt(re * re + im * im) AS envelope FROM b")
def _(spark, sf):
    return S.analytic(ad.series(spark, sf), limit=512)


@query("spc_06_narrowband", "channel t:l re:4 im:4",
       with_("series", "sn") + DFT + f", g AS (SELECT *, {TWO} AS g FROM f WHERE k * 250.0 / n BETWEEN 8 AND 13)" + BACK + " SELECT channel, t, re, im FROM b")
def _(spark, sf):
    return S.narrowband(ad.series(spark, sf), 250.0, 8.0, 13.0, limit=512)


@query("spc_07_band_filter", "channel t:l value:4",
       with_("series", "sn") + DFT + f", g AS (SELECT *, {TWO} AS g FROM f WHERE k * 250.0 / n >= 1 AND k * 250.0 / n <= 20)" + BACK + " SELECT channel, t, re AS value FROM b")
def _(spark, sf):
    return S.band_filter(ad.series(spark, sf), 250.0, 1.0, 20.0, limit=512)


@query("spc_08_notch_filter", "channel t:l value:4",
       with_("series", "sn") + DFT + f", g AS (SELECT *, {TWO} AS g FROM f WHERE NOT (k * 250.0 / n BETWEEN 49.5 AND 50.5))" + BACK + " SELECT channel, t, re AS value FROM b")
def _(spark, sf):
    return S.notch_filter(ad.series(spark, sf), 250.0, 50.0, 1.0, limit=512)


@query("spc_09_iir_filter", "channel t:l value:6",
       with_("series").replace("WITH ", "WITH RECURSIVE ", 1) + ", r AS (SELECT channel, t, 0.2 * value AS y, 0.1 * value - (-0.5) * (0.2 * value) AS s1, -0.2 * (0.2 * value) AS s2 FROM series WHERE t = 0 "
       "UNION ALL SELECT s.channel, s.t, 0.2 * s.value + s1, 0.1 * s.value + 0.5 * (0.2 * s.value + s1) + s2, -0.2 * (0.2 * s.value + s1) FROM r JOIN series s ON s.channel = r.channel AND s.t = r.t + 1) SELECT channel, t, y AS value FROM r")
def _(spark, sf):
    return S.iir_filter(ad.series(spark, sf), [0.2, 0.1], [1.0, -0.5, 0.2], block=256)


def _kaiser_sql(up, down):
    h = S.kaiser_taps(up, down)
    return "hk AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, CAST({float(v)!r} AS DOUBLE))" for i, v in enumerate(h)) + ") v(i, h))"


@query("spc_10_resample", "channel t:l value:5",
       with_("series", "sn") + f", {_kaiser_sql(2, 3)} SELECT channel, m AS t, sum(value * h) AS value FROM series JOIN sn USING (channel) JOIN (SELECT i, h, unnest(range((SELECT max(n) FROM sn))) AS m FROM hk) ON m * 3 + 30 - i = t * 2 AND m * 3 < n * 2 GROUP BY 1, 2")
def _(spark, sf):
    return S.resample(ad.series(spark, sf), 300, 200)


@query("spc_11_drift_filter", "channel t:l value:5",
       with_("series", "sn") + ", k AS (SELECT channel, n, unnest(range(greatest(1, CAST(floor(2 * n / 250.0 * 0.5) AS BIGINT)) + 1)) AS k FROM sn), "
       "b AS (SELECT channel, k, t, value, cos((2 * t + 1) * k * pi() / (2 * n)) * CASE WHEN k = 0 THEN sqrt(1.0 / n) ELSE sqrt(2.0 / n) END AS b FROM series JOIN k USING (channel)), "
       "c AS (SELECT channel, k, sum(value * b) AS c FROM b GROUP BY 1, 2) SELECT channel, t, any_value(value) - sum(c * b) AS value FROM b JOIN c USING (channel, k) GROUP BY 1, 2")
def _(spark, sf):
    return S.drift_filter(ad.series(spark, sf), 250.0, 0.5)


def _wavelet_sql(bank):
    rows = ", ".join(f"({f}, {p - w.shape[1] // 2}, CAST({float(v.real)!r} AS DOUBLE), CAST({float(v.imag)!r} AS DOUBLE), {o})" for o, w in enumerate(bank) for f in range(len(w)) for p, v in enumerate(w[f]))
    return f"wv AS (SELECT * FROM (VALUES {rows}) v(f, d, wr, wi, o))"


MORLET = S._wavelets(250.0, (20.0, 40.0), 3.0, 7.0, True)


@query("spc_12_morlet", "channel f:l t:l re:5 im:5",
       with_("series") + f", {_wavelet_sql([MORLET])} SELECT channel, f, t - d AS t, sum(value * wr) AS re, sum(value * wi) AS im FROM series, wv WHERE t - d >= 0 AND t - d <= (SELECT max(t) FROM series s WHERE s.channel = series.channel) GROUP BY 1, 2, 3")
def _(spark, sf):
    return S.morlet(ad.series(spark, sf), 250.0, (20.0, 40.0), block=512)


SUPER = [S._wavelets(250.0, (20.0, 40.0), 3.0 * i, 3.0 * i, True) for i in (1, 2)]


@query("spc_13_superlet", "channel f:l t:l magnitude:5",
       with_("series") + f", {_wavelet_sql(SUPER)}, z AS (SELECT channel, f, o, t - d AS t, sqrt(power(sum(value * wr), 2) + power(sum(value * wi), 2)) + 1e-9 AS m FROM series, wv WHERE t - d >= 0 AND t - d <= (SELECT max(t) FROM series s WHERE s.channel = series.channel) GROUP BY 1, 2, 3, 4) "
       "SELECT channel, f, t, exp(avg(ln(m))) AS magnitude FROM z GROUP BY 1, 2, 3")
def _(spark, sf):
    return S.superlet(ad.series(spark, sf), 250.0, (20.0, 40.0), 3.0, 2, block=512)


@query("spc_14_phase_locking", "i:l j:l plv:6 imaginary:6",
       with_("samples") + "SELECT a.channel AS i, b.channel AS j, sqrt(power(avg(cos((a.value - b.value) * 10)), 2) + power(avg(sin((a.value - b.value) * 10)), 2)) AS plv, abs(avg(sin((a.value - b.value) * 10))) AS imaginary FROM samples a JOIN samples b USING (t) GROUP BY 1, 2")
def _(spark, sf):
    return S.phase_locking(ad.frames(spark, sf).withColumn("x", F.transform("x", lambda v: v * 10)))


@query("spc_15_envelope_correlation", "i:l j:l r:6",
       ANALYTIC + ", e AS (SELECT dense_rank() OVER (ORDER BY channel) - 1 AS c, t, sqrt(re * re + im * im) AS e FROM b) SELECT x.c AS i, y.c AS j, corr(x.e, y.e) AS r FROM e x JOIN e y USING (t) WHERE x.c < y.c GROUP BY 1, 2")
def _(spark, sf):
    return S.envelope_correlation(ad.series(spark, sf)).where("i < j")


@query("spc_16_phase_amplitude", "channel:l pac:6",
       with_("samples") + "SELECT a.channel, sqrt(power(avg(abs(b.value) * cos(a.value * 10)), 2) + power(avg(abs(b.value) * sin(a.value * 10)), 2)) / avg(abs(b.value)) AS pac FROM samples a JOIN samples b ON a.t = b.t AND b.channel = 63 - a.channel GROUP BY 1")
def _(spark, sf):
    s = ad.samples(spark, sf)
    amp = s.select("recording", (63 - F.col("channel")).alias("channel"), "t", F.abs("value").alias("envelope"))
    return S.phase_amplitude(s.withColumn("phase", F.col("value") * 10), amp)


@query("spc_17_lagged_correlation", "lag:l cc:6",
       with_("daily") + ", s AS (SELECT channel, t, value - avg(value) OVER (PARTITION BY channel) AS v FROM daily), x AS (SELECT t, v FROM s WHERE channel = 'A'), y AS (SELECT t, v FROM s WHERE channel = 'N'), "
       "l AS (SELECT unnest(range(-50, 51)) AS lag) SELECT lag, sum(x.v * y.v) / greatest(sqrt((SELECT sum(v * v) FROM x)) * sqrt((SELECT sum(v * v) FROM y)), 1e-12) AS cc FROM x, l, y WHERE y.t = x.t + lag GROUP BY 1")
def _(spark, sf):
    d = ad.daily(spark, sf)
    return S.lagged_correlation(d.where("channel = 'A'"), d.where("channel = 'N'"), 50, block=256)


@query("spc_18_band_csd", "freq:2 i:l j:l re:8 im:8",
       with_("samples") + ", n AS (SELECT max(t) + 1 AS n FROM samples), k AS (SELECT f AS freq, k, n FROM n, (SELECT unnest([10.0, 40.0]) AS f), (SELECT unnest(range(2000)) AS k) WHERE k <= n // 2 AND abs(k * 250.0 / n - f) < 2), "
       "z AS (SELECT freq, k, any_value(n) AS n, channel, sum(value * cos(2 * pi() * ((k * t) % n) / n)) AS re, -sum(value * sin(2 * pi() * ((k * t) % n) / n)) AS im FROM samples, k GROUP BY 1, 2, 4) "
       "SELECT a.freq, a.channel AS i, b.channel AS j, sum(a.re * b.re + a.im * b.im) / (count(*) * any_value(a.n)) AS re, sum(a.im * b.re - a.re * b.im) / (count(*) * any_value(a.n)) AS im FROM z a JOIN z b USING (freq, k) GROUP BY 1, 2, 3")
def _(spark, sf):
    return S.band_csd(ad.frames(spark, sf), (10.0, 40.0), 250.0)


COVC = ", cv AS (SELECT a.channel AS i, b.channel AS j, covar_pop(a.value, b.value) AS v FROM samples a JOIN samples b USING (t) GROUP BY 1, 2)"
AC = ", ac AS (SELECT j // 8 - i // 8 AS lag, i % 8 AS c1, j % 8 AS c2, avg(v) AS v FROM cv WHERE j // 8 >= i // 8 GROUP BY 1, 2, 3)"
CPSD = (", fl AS (SELECT lag, c1, c2, v FROM ac UNION ALL SELECT -lag, c2, c1, v FROM ac WHERE lag > 0), "
        "cp AS (SELECT k, c1 AS i, c2 AS j, sum(v * cos(2 * pi() * k * (lag + 7) / 15)) / 250 AS re, -sum(v * sin(2 * pi() * k * (lag + 7) / 15)) / 250 AS im FROM fl, (SELECT unnest(range(8)) AS k) GROUP BY 1, 2, 3) ")
COH = "SELECT s.k, s.i, s.j, s.re, s.im, least(greatest((s.re * s.re + s.im * s.im) / greatest(p.re * q.re, 1e-20), 0), 1) AS coherence FROM cp s JOIN cp p ON p.k = s.k AND p.i = s.i AND p.j = s.i JOIN cp q ON q.k = s.k AND q.i = s.j AND q.j = s.j"


def _cov(spark, sf):
    return gram(ad.frames(spark, sf)).select("i", "j", F.col("cov").alias("v"))


@query("spc_19_autocovariance", "lag:l c1:l c2:l v:9", with_("samples") + COVC + AC + " SELECT * FROM ac")
def _(spark, sf):
    return S.autocovariance(_cov(spark, sf), 8)


@query("spc_20_autocov_spectrum", "k:l i:l j:l re:8 im:8", with_("samples") + COVC + AC + CPSD + COH)
def _(spark, sf):
    return S.autocov_spectrum(S.autocovariance(_cov(spark, sf), 8), 8, 250.0)


@query("spc_21_state_spectra", "state:l k:l i:l psd:8",
       "WITH ex AS (SELECT label AS state, vec_id AS t, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), "
       "cv AS (SELECT state, a.i, b.i AS j, covar_pop(a.x, b.x) AS v FROM ex a JOIN ex b USING (state, t) GROUP BY 1, 2, 3), "
       "c2 AS (SELECT state, a.d AS i, b.d AS j, sum(a.v * cv.v * b.v) AS v FROM cv JOIN (SELECT i, d, CASE WHEN i = d THEN 1.0 ELSE 0 END + 0.01 * (i + d) AS v FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(32)) AS d)) a ON a.i = cv.i "
       "JOIN (SELECT i, d, CASE WHEN i = d THEN 1.0 ELSE 0 END + 0.01 * (i + d) AS v FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(32)) AS d)) b ON b.i = cv.j GROUP BY 1, 2, 3), "
       "ac AS (SELECT state, j // 8 - i // 8 AS lag, i % 8 AS c1, j % 8 AS c2, avg(v) AS v FROM c2 WHERE j // 8 >= i // 8 GROUP BY 1, 2, 3, 4), "
       "fl AS (SELECT state, lag, c1, v FROM ac WHERE c1 = c2 UNION ALL SELECT state, -lag, c1, v FROM ac WHERE c1 = c2 AND lag > 0) "
       "SELECT state, k, c1 AS i, greatest(sum(v * cos(2 * pi() * k * (lag + 3) / 7)) / 250, 0) AS psd FROM fl, (SELECT unnest(range(4)) AS k) GROUP BY 1, 2, 3")
def _(spark, sf):
    f = ad.table(spark, sf, "embeddings").select(F.col("label").alias("state"), F.col("embedding").cast("array<double>").alias("x"))
    cov = gram(f, ["state"]).select("state", "i", "j", F.col("cov").alias("v"))
    comp = spark.createDataFrame([(i, d, float(i == d) + 0.01 * (i + d)) for i in range(64) for d in range(32)], "i int, j int, v double")
    return S.state_spectra(cov, comp, 8, 4, 250.0).where("psd IS NOT NULL")


@query("spc_22_regression_spectra", "state:l channel:l k:l psd:7")
def _(spark, sf):
    p = S.spectrogram(ad.samples(spark, sf), 250.0, 32, 16)
    gamma = ad.table(spark, sf, "embeddings").select(F.lit("all").alias("recording"), F.col("vec_id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("state"), "label").withColumn(
        "p", F.when(F.col("label") % 3 == F.col("state"), 0.8).otherwise(0.1))
    return S.regression_spectra(p, centre_mixing(slide(ad.frames(spark, sf), 32, 16), gamma))


def coil_fids(spark, sf):
    """Four coils of eight points each."""
    return ad.fids(spark, sf).select("acq", (F.col("n") % 4).alias("coil"), "edit", "dyn", F.floor(F.col("n") / 4).cast("int").alias("n"), "s")


def _reference(f):
    return f.where("edit = 0").groupBy("acq", "n").agg(cx.pack(F.avg("s.re"), F.avg("s.im")).alias("s"))


@query("spc_23_spectral_registration", "acq edit:l dyn:l df:3 dp:6")
def _(spark, sf):
    f = ad.fids(spark, sf)
    return S.spectral_registration(f, _reference(f), 0.0005)


GRID = "(SELECT -pi() + i * 2 * pi() / 360 AS p, i FROM (SELECT unnest(range(361)) AS i))"


@query("spc_24_zero_order_phase", "dyn:l edit:l phase:6",
       with_("fids") + ", s AS (SELECT dyn, edit, sum(re) AS r, sum(im) AS q FROM fids GROUP BY 1, 2) SELECT dyn, edit, arg_max(p, r * cos(p) - q * sin(p)) AS phase FROM s, " + GRID + " GROUP BY 1, 2")
def _(spark, sf):
    return S.zero_order_phase(ad.fids(spark, sf).select("dyn", "edit", "s.re", "s.im"), ["dyn", "edit"])


@query("spc_25_first_order_phase", "dyn:l edit:l phase0:2 phase1:2")
def _(spark, sf):
    f = ad.fids(spark, sf).select("dyn", "edit", F.col("n").alias("bin"), (F.col("n") * 0.3).alias("ppm"), "s.re", "s.im")
    return S.first_order_phase(f, ["dyn", "edit"])


@query("spc_26_coil_combination", "dyn:l edit:l n:l re:7 im:7",
       with_("fids") + ", c AS (SELECT acq, edit, dyn, n % 4 AS coil, n // 4 AS n, re, im FROM fids), m AS (SELECT acq, coil, avg(re) AS r, avg(im) AS q FROM c WHERE n = 0 GROUP BY 1, 2), "
       "w AS (SELECT acq, coil, sqrt(r * r + q * q) / sum(sqrt(r * r + q * q)) OVER (PARTITION BY acq) AS w, -(atan2(q, r) - first(atan2(q, r)) OVER (PARTITION BY acq ORDER BY coil)) AS p FROM m) "
       "SELECT dyn, edit, n, sum(w * (re * cos(p) - im * sin(p))) AS re, sum(w * (re * sin(p) + im * cos(p))) AS im FROM c JOIN w USING (acq, coil) GROUP BY 1, 2, 3")
def _(spark, sf):
    return S.sensitivity_combine(coil_fids(spark, sf)).select("dyn", "edit", "n", "s.re", "s.im")


@query("spc_26b_svd_combination", "acq power:6 n:l")
def _(spark, sf):
    c = S.svd_combine(coil_fids(spark, sf), first_only=False)
    return c.groupBy("acq").agg(F.sum(F.col("s.re") ** 2 + F.col("s.im") ** 2).alias("power"), F.count("*").alias("n"))


@query("spc_27_edited_spectroscopy", "acq n:l diff_re:7 diff_im:7 n_used:l")
def _(spark, sf):
    return S.edited_spectroscopy(coil_fids(spark, sf), 0.0005)


@query("spc_28_component_split", "t:l wave_energy:7 spike_energy:7 n:l")
def _(spark, sf):
    sq = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
    f = S.split_components(ad.frames(spark, sf), 0.1, 0.1, 20)
    return f.select("t", sq("wave").alias("wave_energy"), sq("spike").alias("spike_energy"), F.size("wave").alias("n"))
