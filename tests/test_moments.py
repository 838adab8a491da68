"""Second moments and linear fits on data with an offset."""

import numpy as np
import pytest

from ondula.operators import aggregates as A
from ondula.operators import matrix as M
from ondula.operators.gram import gram, matrix_of, merge_rows

OFFSETS = (0.0, 1e4, 1e7, 1e8)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    return rng.standard_normal((500, 4)) @ rng.standard_normal((4, 4))


def frames(spark, x, parts=5):
    return spark.createDataFrame([("r", i, v.tolist()) for i, v in enumerate(x)], "recording string, t int, x array<double>").repartition(parts)


@pytest.mark.parametrize("offset", OFFSETS)
def test_gram_and_connectivity(spark, data, offset):
    x = data + offset
    got = {(r.i, r.j): r for r in gram(frames(spark, x)).collect()}
    cov = np.cov((x - x[0]).T, bias=True)
    for (i, j), r in got.items():
        assert r.n == 500
        assert r.cov == pytest.approx(cov[i, j], rel=1e-9, abs=1e-9 * np.sqrt(cov[i, i] * cov[j, j]))
        assert r.mean_i == pytest.approx(x[:, i].mean(), rel=1e-12, abs=1e-12) and r.mean_j == pytest.approx(x[:, j].mean(), rel=1e-12, abs=1e-12)
    r = np.corrcoef((x - x[0]).T)
    for c in A.connectivity(frames(spark, x)).collect():
        assert c.r == pytest.approx(r[c.i, c.j], abs=1e-9)


@pytest.mark.parametrize("offset", OFFSETS)
def test_constant_channels_give_zero(spark, data, offset):
    x = data + offset
    x[:, 2] = offset + 0.1
    got = {(c.i, c.j): c.r for c in A.connectivity(frames(spark, x)).collect()}
    assert all(got[2, k] == 0 == got[k, 2] for k in range(4))
    assert got[0, 0] == pytest.approx(1, abs=1e-9)


def test_merge_is_the_union(data):
    def row(m):
        d = m - m.mean(0)
        c = m.shape[1]
        return np.column_stack([np.full(c, len(m)), m.mean(0), np.broadcast_to(m.mean(0), (c, c)), d.T @ d])

    assert np.allclose(merge_rows(row(data[:7]), row(data[7:])), row(data), rtol=1e-12)


def test_null_frames_do_not_count_and_widths_must_agree(spark):
    import pyarrow as pa
    rows = [("r", 0, [1.0, 2.0]), ("r", 1, None), ("r", 2, [3.0, 6.0])]
    got = {(r.i, r.j): (r.n, r.cov) for r in gram(spark.createDataFrame(rows, "recording string, t int, x array<double>")).collect()}
    assert got == {(0, 0): (2, 1.0), (0, 1): (2, 2.0), (1, 0): (2, 2.0), (1, 1): (2, 4.0)}
    with pytest.raises(ValueError):
        matrix_of(pa.array([[1.0, 2.0, 3.0, 4.0], [5.0, 6.0]]))
    assert np.isnan(matrix_of(pa.array([[1.0, 2.0], None]))[1]).all()
    assert matrix_of(pa.array([[0.0], [1.0, 2.0], [3.0, 4.0]]).slice(1)).tolist() == [[1, 2], [3, 4]]


@pytest.mark.parametrize("offset", OFFSETS)
def test_fits_do_not_lose_digits(spark, data, offset):
    rng = np.random.default_rng(2)
    y = data @ [1.0, -2.0, 0.5, 0.0] + rng.standard_normal(500)
    rows = spark.createDataFrame([(i, v.tolist(), float(w)) for i, (v, w) in enumerate(zip(data + offset, y + offset))], "row int, x array<double>, y double")
    x, z = data + offset, y + offset
    x0, z0 = x - x[0], z - z[0]
    d = np.column_stack([np.ones(500), (x0 - x0.mean(0)) / x0.std(0)])
    beta = np.linalg.solve(d.T @ d + np.diag([0, 1, 1, 1, 1]), d.T @ z0)
    fit, _ = M.ridge(rows)
    assert fit["mse"] == pytest.approx(((z0 - d @ beta) ** 2).mean(), rel=1e-7)
    design = np.column_stack([np.ones(500), rng.standard_normal(500)])
    f = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(design, x))], "t int, d array<double>, x array<double>")
    m = M.fit_glm(f)
    b = np.linalg.lstsq(design, x0, rcond=None)[0]
    assert np.allclose(m.rss, ((x0 - design @ b) ** 2).sum(0), rtol=1e-7)
    assert np.allclose(m.beta, b + np.outer([1, 0], x[0]), rtol=1e-7, atol=1e-6)


def test_recovery_keeps_recordings_apart(spark):
    rng = np.random.default_rng(5)
    rows = [(r, c, t, float(rng.standard_normal())) for r in ("a", "b") for c in range(2) for t in range(40)]
    original = spark.createDataFrame(rows, "recording string, channel int, t int, value double")
    injected = original.withColumn("value", original["value"] * 2 + 1)
    clean = spark.createDataFrame([(r, c, t, v + 2 * v + 1) for r, c, t, v in rows], original.schema)
    got = A.recovery(clean, original, injected).first()
    assert got.correlation == pytest.approx(1) and got.snr_db > 200
    parts = original.withColumnRenamed("channel", "component")
    reg = parts.where("component = 0").selectExpr("'x' AS condition", "recording", "t", "value")
    best = A.component_regressor_correlation(parts, reg, ["x"]).first()
    assert best.component == 0 and best.corr_x == 1.0
    assert A.best_component(parts, reg, "t").first().component == 0


def test_operators_work_beyond_their_former_limits(spark, monkeypatch):
    from ondula.operators import attach, joins, ordered, spectral, tiles
    from pyspark.sql import functions as F
    taper = spectral.tapers(4097)
    assert taper.shape == (7, 4097) and np.allclose(taper @ taper.T, np.eye(7), atol=1e-9)
    i = np.arange(4097)
    d, o = (2048 - i) ** 2 * np.cos(2 * np.pi * 4.0 / 4097), i[1:] * (4097 - i[1:]) / 2
    lam = (taper * (d * taper)).sum(1) + 2 * (taper[:, 1:] * o * taper[:, :-1]).sum(1)
    left = d * taper - lam[:, None] * taper
    left[:, 1:] += o * taper[:, :-1]
    left[:, :-1] += o * taper[:, 1:]
    assert np.abs(left).max() < 1e-6 * np.abs(d).max()
    small = spark.range(200_001)
    assert attach.sized_broadcast(small).count() == 200_001
    monkeypatch.setattr(attach, "SMALL_BYTES", 100)
    stats = spark.createDataFrame([(k, [0.5] * 20) for k in range(9)], "k long, s array<double>")
    assert attach.attach(spark.range(900).selectExpr("id % 9 AS k", "id"), stats, ["k"], ["id"]).count() == 900
    monkeypatch.setattr(joins, "SMALL", 6)
    w = np.arange(12.0).reshape(4, 3)
    cells = spark.createDataFrame([(a, b, float(w[a, b])) for a in range(4) for b in range(3)], "i int, j int, v double")
    f = spark.createDataFrame([("r", 0, [1.0, 2.0, 3.0])], "recording string, t int, x array<double>")
    assert joins.project_frames(f, cells).first().x == (w @ [1, 2, 3]).tolist()
    s = spark.range(50).selectExpr("'r' AS recording", "id AS t")
    wide = ordered.frame(s, ["recording"], "t", 20, 20, {"n": F.count("*")}, block=4)
    assert {r.t: r.n for r in wide.collect()} == {t: min(49, t + 20) - max(0, t - 20) + 1 for t in range(50)}
    x = np.random.default_rng(0).standard_normal((300, 2))
    pts = spark.createDataFrame([("r", k, v.tolist()) for k, v in enumerate(x)], "recording string, t long, x array<double>")
    pairs = tiles.pairs_within(pts, 0.3, block=16)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert {(r.i, r.j) for r in pairs.collect()} == {(a, b) for a, b in zip(*np.nonzero(dist <= 0.3)) if a < b}
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
