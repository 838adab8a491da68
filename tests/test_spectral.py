import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ondula.operators import fourier, nonlinear as N, spectral as S, visibility as V
from ondula.operators.tiles import pairs_within

SM = "recording string, channel int, t long, value double"


def samples(spark, *xs):
    return spark.createDataFrame([("r", c, i, float(v)) for c, x in enumerate(xs) for i, v in enumerate(x)], SM)


def values(df, col="value", channel=0):
    return df.where(F.col("channel") == channel).orderBy("t").toPandas()[col].to_numpy()


@pytest.mark.parametrize("n,limit", [(60, 1000), (60, 12), (61, 20), (97, 32), (128, 16), (1, 10), (2, 1)])
def test_transform_layouts(spark, n, limit):
    x = np.random.default_rng(n).normal(size=n)
    df = samples(spark, x)
    f = fourier.dft(fourier.real_rows(df, S.KEY), S.KEY, limit=limit)
    got = f.orderBy("k").toPandas()
    np.testing.assert_allclose(got["re"] + 1j * got["im"], np.fft.fft(x), atol=1e-9)
    back = fourier.dft(f, S.KEY, inverse=True, limit=limit).orderBy("t").toPandas()
    np.testing.assert_allclose(back["re"], x, atol=1e-9)


def test_series_of_different_lengths(spark):
    rng = np.random.default_rng(0)
    xs = [rng.normal(size=n) for n in (10, 37, 64)]
    f = fourier.dft(fourier.real_rows(samples(spark, *xs), S.KEY), S.KEY, limit=16).toPandas()
    for c, x in enumerate(xs):
        g = f[f["channel"] == c].sort_values("k")
        np.testing.assert_allclose(g["re"] + 1j * g["im"], np.fft.fft(x), atol=1e-9)


def test_iir_matches_recursion(spark):
    b, a = [0.3, 0.2, 0.1], [2.0, -0.8, 0.3]
    x = np.random.default_rng(1).normal(size=100)
    s, y = np.zeros(2), []
    bb, aa = np.array(b) / 2, np.array(a) / 2
    for v in x:
        o = bb[0] * v + s[0]
        s = np.array([bb[1] * v - aa[1] * o + s[1], bb[2] * v - aa[2] * o])
        y.append(o)
    for block in (7, 1000):
        np.testing.assert_allclose(values(S.iir_filter(samples(spark, x), b, a, block=block)), y, atol=1e-10)
    np.testing.assert_allclose(values(S.iir_filter(samples(spark, x), [4.0], [2.0])), 2 * x)


def test_tapers_orthonormal():
    for n, k in ((128, 3), (256, 4), (5000, 4)):
        t = S.tapers(n, 3.0, k)
        np.testing.assert_allclose(t @ t.T, np.eye(k), atol=1e-10)


def test_lag_five(spark):
    x, y = np.zeros(200), np.zeros(200)
    x[50:60], y[55:65] = 1, 1
    from ondula.operators.ranking import best_lag
    a, b = samples(spark, x), samples(spark, y)
    assert abs(best_lag(S.lagged_correlation(a, b, 20, block=32), ["recording"]).first()["lag"]) == 5
    own = best_lag(S.lagged_correlation(a, a, 20, block=32), ["recording"]).first()
    assert own["lag"] == 0 and abs(own["cc"] - 1) < 1e-12


def test_registration_finds_the_shift(spark):
    n, dwell = 256, 0.0005
    t = np.arange(n) * dwell
    ref = np.exp(2j * np.pi * -200 * t - 30 * t) + 0.5 * np.exp(2j * np.pi * -190 * t - 40 * t)
    moved = ref * np.exp(-2j * np.pi * 3.2 * t - 0.4j)
    rows = lambda z, e: [("a", e, 0, i, (float(v.real), float(v.imag))) for i, v in enumerate(z)]
    sch = "acq string, edit int, dyn int, n int, s struct<re:double,im:double>"
    got = S.spectral_registration(spark.createDataFrame(rows(moved, 0), sch), spark.createDataFrame(rows(ref, 0), sch), dwell).first()
    assert abs(got["df"] - 3.2) < 1e-9 and abs(got["dp"] - 0.4) < 1e-6


def test_edited_difference_keeps_the_edited_peak(spark):
    rng = np.random.default_rng(2)
    n, dwell = 128, 0.0005
    t = np.arange(n) * dwell
    base, edited = np.exp(2j * np.pi * -150 * t - 40 * t), np.exp(2j * np.pi * -210 * t - 40 * t)
    rows = []
    for dyn in range(6):
        for edit in (0, 1):
            z = base + edit * edited
            for coil in range(2):
                w = (1 + coil) * np.exp(0.3j * coil)
                rows += [("a", coil, edit, dyn, i, (float(v.real), float(v.imag))) for i, v in enumerate(z * w + 1e-4 * rng.normal(size=n))]
    f = spark.createDataFrame(rows, "acq string, coil int, edit int, dyn int, n int, s struct<re:double,im:double>")
    got = S.edited_spectroscopy(f, dwell).orderBy("n").toPandas()
    spec = np.abs(np.fft.fft(got["diff_re"] + 1j * got["diff_im"]))
    freq = np.fft.fftfreq(n, dwell)
    assert abs(freq[np.argmax(spec)] + 210) < 20
    assert spec[np.argmin(np.abs(freq + 150))] < 0.3 * spec.max()


@pytest.mark.parametrize("kind", ["natural", "horizontal"])
@pytest.mark.parametrize("block", [4, 9, 100])
def test_visibility(spark, kind, block):
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=40), np.arange(1, 20.0) ** 2, np.array([3.0, 1, 2]), np.array([1.0, 1, 1, 2, 1]), np.sort(rng.normal(size=30))[::-1]):
        got = {(r["i"], r["j"]) for r in V.visibility_edges(samples(spark, x), kind, block=block).collect()}
        ref = set()
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                k = np.arange(i + 1, j)
                if kind == "natural":
                    ok = ((x[k] - x[i]) / (k - i) < (x[j] - x[i]) / (j - i)).all()
                else:
                    ok = (x[k] < min(x[i], x[j])).all()
                if ok:
                    ref.add((i, j))
        assert got == ref


def test_recurrence_of_a_sine(spark):
    x = np.sin(np.linspace(0, 4 * np.pi, 100))
    f = spark.createDataFrame([("r", i, [float(v)]) for i, v in enumerate(x)], "recording string, t long, x array<double>")
    s = N.recurrence_summary(N.recurrence(f, 0.3, block=16), f).first()
    d = np.abs(x[:, None] - x[None, :]) <= 0.3
    assert s["determinism"] > 0.3
    assert abs(s["recurrence_rate"] - (d.sum() - 100) / (100 * 99)) < 1e-12
    empty = N.recurrence_summary(N.recurrence(f.where("t < 1"), 0.3), f.where("t < 1")).first()
    assert empty["determinism"] == 0 and empty["max_diagonal_length"] == 0
    with pytest.raises(ValueError):
        N.recurrence(f)
    with pytest.raises(ValueError):
        pairs_within(f, 0.1, "cosine")


def test_entropies(spark):
    rng = np.random.default_rng(4)
    noise, sine, flat = rng.normal(size=200), np.sin(np.arange(200) * 0.3), np.ones(200)
    got = {r["channel"]: r for r in N.all_entropies(samples(spark, noise, sine), block=64).collect()}

    def brute(x, m=2):
        r = 0.2 * x.std(ddof=1)
        emb = lambda d: np.stack([x[k:len(x) - d + 1 + k] for k in range(d)], 1)
        cnt = lambda e: (np.abs(e[:, None] - e[None]).max(2) <= r).sum(1)
        a, b = cnt(emb(m)[:-1]), cnt(emb(m + 1))
        samp = -np.log(((b - 1) / (len(b) - 1)).mean() / ((a - 1) / (len(a) - 1)).mean())
        full = cnt(emb(m))
        app = np.log(full / len(full)).mean() - np.log(b / len(b)).mean()
        sv = np.linalg.svd(np.stack([x[k * 2:len(x) - 18 + k * 2] for k in range(10)], 1), compute_uv=False)
        p = sv / sv.sum()
        return samp, app, -np.sum(p * np.log2(p))

    for c, x in enumerate((noise, sine)):
        s, a, v = brute(x)
        assert abs(got[c]["sample_entropy"] - s) < 1e-9
        assert abs(got[c]["approximate_entropy"] - a) < 1e-9
        assert abs(got[c]["svd_entropy"] - v) < 1e-5
    assert got[1]["spectral_entropy"] < got[0]["spectral_entropy"]
    from ondula.operators.tiles import template_counts
    const = N.sample_entropy(template_counts(N.templates(samples(spark, flat)), N.KEY, 2)).first()
    assert const["sample_entropy"] == pytest.approx(0.0)


def test_surrogates(spark):
    x = np.random.default_rng(5).normal(size=101).cumsum()
    df = samples(spark, x)
    for made in (N.shuffle(df, 1), N.block_shuffle(df, 20, 1), N.amplitude_adjusted(df, 1, limit=16)):
        y = values(made)
        assert len(y) == 101 and not np.allclose(y, x)
        np.testing.assert_allclose(np.sort(y), np.sort(x))
    y = values(N.phase_randomise(df, 1, limit=16))
    np.testing.assert_allclose(np.abs(np.fft.rfft(y)), np.abs(np.fft.rfft(x)), atol=1e-8)


def test_signature_levels():
    from ondula.functions.signature import log_signature, lyndon_words, signature
    line = np.outer(np.linspace(0, 1, 5), [1.0, 2.0])
    one, two, three = signature(line, 3)
    np.testing.assert_allclose(one, [1, 2])
    np.testing.assert_allclose(two, np.kron([1, 2], [1, 2]) / 2)
    np.testing.assert_allclose(log_signature(line, 3)[2:], 0, atol=1e-12)
    assert len(lyndon_words(3, 3)) == 3 + 3 + 8
    loop = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0, 0.0]])
    np.testing.assert_allclose(log_signature(loop, 2), [0, 0, 1])  # twice the area over two


def test_dynamic_modes_find_the_frequency(spark):
    t = np.arange(400) * 0.01
    x = np.column_stack([np.cos(2 * np.pi * 5 * t), np.sin(2 * np.pi * 5 * t), 0.5 * np.cos(2 * np.pi * 5 * t + 1)])
    f = spark.createDataFrame([("r", i, [float(v) for v in r]) for i, r in enumerate(x)], "recording string, t long, x array<double>")
    got = N.dynamic_modes(f, 100, 100, 2, 0.01).where("rank = 1").toPandas()
    np.testing.assert_allclose(got["freq"], 5, atol=1e-6)


def test_sparse_dynamics_of_a_stable_system(spark):
    a = np.array([[-0.5, 2, 0], [-2, -0.5, 0], [0, 0, -0.3]])
    x, rows = np.array([1.0, 0.5, 1.0]), []
    for i in range(1000):
        rows.append(("r", i, [float(v) for v in x]))
        x = x + 0.01 * a @ x
    f = spark.createDataFrame(rows, "recording string, t long, x array<double>")
    got = N.sparse_dynamics(f, 500, 500, 3, 1, 0.01, 0.01).toPandas()
    assert (got["max_real"] < 0).all()


def test_transforms_leave_in_pieces(monkeypatch):
    """The transforms of a whole Arrow batch were held before the first of them left."""
    monkeypatch.setattr(fourier, "PIECE", 20)
    x = np.random.default_rng(8).normal(size=(2, 7, 8))
    lists = lambda v, kind: pa.array([list(r) for r in v], pa.list_(kind))
    batch = (lists([range(8)] * 7, pa.int64()), lists(x[0], pa.float64()), lists(x[1], pa.float64()), pa.array([8] * 7), pa.array([-1] * 6 + [1]))
    got = fourier._dft.func(iter([batch, tuple(c.slice(6) for c in batch)]))
    pieces = [next(got)]
    pieces += got
    assert [len(p) for p in pieces] == [3, 3, 1, 1]
    z = x[0] + 1j * x[1]
    want = [*np.fft.fft(z[:6]), *[8 * np.fft.ifft(z[6])] * 2]
    rows = [r for p in pieces for r in p.to_pylist()]
    assert np.allclose(want, [np.array(r["re"]) + 1j * np.array(r["im"]) for r in rows])


def test_band_csd_equals_a_transform_in_bounded_memory(spark, monkeypatch):
    import tracemalloc

    from ondula.operators import spectral

    kernels = []
    monkeypatch.setattr(spectral, "partial_rows", lambda *a, was=spectral.partial_rows: kernels.append(a[3]) or was(*a))
    monkeypatch.setattr(spectral, "BAND_ROWS", 37)
    monkeypatch.setattr(spectral, "BAND_BINS", 5)
    x = np.random.default_rng(9).normal(size=(500, 3))
    f = spark.createDataFrame([("r", t, v.tolist()) for t, v in enumerate(x)], "recording string, t long, x array<double>").repartition(3)
    got = {(r["freq"], r["i"], r["j"]): r["re"] + 1j * r["im"] for r in spectral.band_csd(f, (10.0, 40.0), 250.0).collect()}
    z, freq = np.fft.rfft(x, axis=0), np.fft.rfftfreq(500, 1 / 250)
    for target in (10.0, 40.0):
        k = np.abs(freq - target) < 2
        want = z[k].T @ z[k].conj() / (k.sum() * 500)
        assert max(abs(got[target, i, j] - want[i, j]) for i in range(3) for j in range(3)) < 1e-9
    monkeypatch.undo()
    rows = np.arange(2000.0)
    tracemalloc.start()
    ks, m = kernels[0](np.column_stack([rows, np.full(2000, 60_000.0)]), np.ones((2000, 64)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ks) > 1900 and m.shape == (len(ks), 128) and peak < 40e6  # all waves of the block would take 60 MB and more
