"""Models of many keys in one plan against models of one key each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ondula.operators import keyed as K
from ondula.operators import matrix as M


@pytest.fixture(scope="module")
def recordings(spark):
    """Four recordings of different lengths and offsets; one holds most of the rows."""
    rng = np.random.default_rng(3)
    rows = []
    for r, n in enumerate((3000, 200, 150, 400)):
        s = np.column_stack([rng.laplace(size=n), rng.uniform(-1, 1, n), np.sign(rng.normal(size=n)) * rng.random(n) ** 0.2])
        x = s @ rng.normal(size=(3, 3)).T + 100.0 * r
        rows += [(f"r{r}", t, [float(v) for v in f], [float(v) for v in z]) for t, (f, z) in enumerate(zip(x, s))]
    rows += [("r1", 999, None, None)]
    return spark.createDataFrame(rows, "recording string, t long, x array<double>, s array<double>").repartition(7).cache()


def by_key(df):
    return {r["recording"]: r for r in df.collect()}


def single(recordings, name):
    return recordings.where(F.col("recording") == name).select("recording", "t", "x")


def test_principal(recordings):
    got = by_key(K.principal(recordings, n=2))
    assert set(got) == {"r0", "r1", "r2", "r3"}
    for name, r in got.items():
        one = M.principal(single(recordings, name), 2)
        assert np.allclose(r["mean"], one.mean) and np.allclose(r["values"], one.values) and np.allclose(r["vectors"], one.vectors, atol=1e-8)


def test_scores_keep_other_columns_and_invert(recordings):
    model = K.principal(recordings)
    scores = K.transform(recordings, model)
    assert scores.columns == recordings.columns
    back = {(r["recording"], r["t"]): r for r in K.inverse(scores, model).collect()}
    want = recordings.where("x IS NOT NULL").collect()
    assert len(back) == len(want)
    for r in want:
        assert np.allclose(back[r["recording"], r["t"]]["x"], r["x"]) and back[r["recording"], r["t"]]["s"] == r["s"]


def test_share_is_taken_key_by_key(recordings):
    got = by_key(K.principal(recordings, share=0.9))
    for name, r in got.items():
        assert len(r["values"]) == len(M.principal(single(recordings, name), share=0.9).values)


def alone(x, k, steps, seed, tol=1e-4):
    """The fixed-point iteration on one recording, in memory."""
    lam, vec = M.Moments(len(x), x.mean(axis=0), np.cov(x.T, bias=True)).eigen
    white = vec[:k] / np.sqrt(lam[:k])[:, None]
    z = (x - x.mean(axis=0)) @ white.T
    w = M._decorrelate(np.random.default_rng(seed).normal(size=(k, k)))
    for it in range(1, steps + 1):
        g = np.tanh(z @ w.T)
        old, w = w, M._decorrelate(g.T @ z / len(z) - (1 - g * g).mean(axis=0)[:, None] * w)
        if np.max(np.abs(1 - np.abs(np.sum(w * old, axis=1)))) < tol:
            return w @ white, it, True
    return w @ white, steps, False


@pytest.fixture(scope="module")
def model(recordings):
    return K.fast_ica(recordings.select("recording", "t", "x"), n=3, max_iter=10, seed=2)


def test_fast_ica(recordings, model):
    got = by_key(model)
    data = recordings.where("x IS NOT NULL").select("recording", "x").toPandas()
    for name, r in got.items():
        x = np.stack(data[data["recording"] == name]["x"])
        unmixing, steps, done = alone(x, 3, 10, 2)
        assert (r["iterations"], r["converged"]) == (steps, done)
        assert np.allclose(r["unmixing"], unmixing, atol=1e-6) and np.allclose(np.array(r["mixing"]) @ unmixing, np.eye(3), atol=1e-6)
    assert len({r["iterations"] for r in got.values()}) > 1 or not any(r["converged"] for r in got.values())  # keys stop on their own


def test_sources_are_found_and_restored(recordings, model):
    found = K.transform(recordings.where("recording = 'r0'"), model, weights="unmixing")
    pdf = found.toPandas()
    r = np.corrcoef(np.stack(pdf["x"]).T, np.stack(pdf["s"]).T)[:3, 3:]
    assert (np.abs(r).max(axis=0) > 0.9).all()
    back = {r["t"]: r["x"] for r in K.restore(found, model).collect()}
    assert all(np.allclose(back[r["t"]], r["x"]) for r in recordings.where("recording = 'r0'").collect())


def test_covariance_mean(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k, n in enumerate((40, 5, 7, 1)):
        for _ in range(n):
            a = rng.normal(size=(3, 60))
            rows.append((k, [float(v) for v in (a @ a.T / 60).ravel()]))
    covs = spark.createDataFrame(rows, "k int, c array<double>").repartition(5)
    got = {r["k"]: r for r in K.covariance_mean(covs, ["k"]).collect()}
    assert len(got) == 4
    for k, r in got.items():
        mean = np.reshape(r["mean"], (3, 3))
        # the mean is where the log maps of its matrices cancel
        moves = [M.log_map(np.reshape(c, (3, 3)), mean) for key, c in rows if key == k]
        assert r["converged"] and np.linalg.norm(np.mean(moves, axis=0)) < 1e-5
    assert np.allclose(np.ravel(got[3]["mean"]), rows[-1][1])
    assert len({r["iterations"] for r in got.values()}) > 1
    one = M.covariance_mean(covs.where("k = 2"))
    assert np.allclose(np.reshape(got[2]["mean"], (3, 3)), one, rtol=1e-5)


def test_empty_tables(recordings, spark):
    none = recordings.where("false")
    assert K.principal(none).count() == 0
    assert K.fast_ica(none, n=2).count() == 0
    assert K.covariance_mean(spark.createDataFrame([], "k int, c array<double>"), ["k"]).count() == 0


def test_two_keys_and_steps_that_run_out(recordings):
    two = recordings.select("recording", (F.col("t") % 2).alias("half"), "t", "x")
    got = K.fast_ica(two, ["recording", "half"], n=3, max_iter=1).collect()
    assert len(got) == 8 and not any(r["converged"] for r in got) and {r["iterations"] for r in got} == {1}
