import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ondula.operators import aggregates as A
from ondula.operators import ordered, windows
from ondula.operators.quantiles import median_mad, quantiles


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    rows = []
    for key, n in (("a", 83), ("b", 7), ("c", 1)):
        t = np.sort(rng.choice(400, n, replace=False))
        rows += [(key, int(x), float(v), int(s)) for x, v, s in zip(t, rng.normal(size=n).round(2), rng.integers(0, 3, n))]
    pdf = pd.DataFrame(rows, columns=["k", "t", "v", "s"])
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("block", [1, 13, 1000])
def test_neighbour_running_fill(series, block):
    pdf, df = series
    g = pdf.sort_values("t").groupby("k")
    out = ordered.neighbour(df, ["k"], "t", {"v": "p"}, block=block)
    out = ordered.neighbour(out, ["k"], "t", {"v": "n"}, ahead=True, block=block)
    out = ordered.running(out, ["k"], "t", "v", "c", block=block)
    out = ordered.running(out, ["k"], "t", "v", "m", how="max", block=block)
    out = out.withColumn("x", F.when(F.col("s") == 1, F.col("v")))
    out = ordered.fill(out, ["k"], "t", "x", "f", block=block)
    got = ordered.fill(out, ["k"], "t", "x", "b", ahead=True, block=block).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    g = want.groupby("k")["v"]
    x = want["v"].where(want["s"] == 1)
    for name, ref in {"p": g.shift(1), "n": g.shift(-1), "c": g.cumsum(), "m": g.cummax(),
                      "f": x.groupby(want["k"]).ffill(), "b": x.groupby(want["k"]).bfill()}.items():
        np.testing.assert_allclose(got[name].astype(float), ref, err_msg=name)


@pytest.mark.parametrize("block", [1, 13, 1000])
def test_runs(series, block):
    pdf, df = series
    got = ordered.runs(df, ["k"], "t", "s", block=block).toPandas().sort_values(["k", "first"])
    want = pdf.sort_values(["k", "t"])
    island = ((want["s"] != want["s"].shift()) | (want["k"] != want["k"].shift())).cumsum()
    ref = want.groupby(island).agg(k=("k", "first"), s=("s", "first"), first=("t", "min"), last=("t", "max"), length=("t", "size"))
    assert got[["k", "s", "first", "last", "length"]].values.tolist() == ref.sort_values(["k", "first"]).values.tolist()


@pytest.mark.parametrize("width", [1, 5, 6])
def test_moving_average(spark, width):
    x = np.random.default_rng(2).normal(size=50)
    df = spark.createDataFrame([("r", "c", i, float(v)) for i, v in enumerate(x)], "recording string, channel string, t long, value double")
    got = windows.moving_average(df, width, block=9).orderBy("t").toPandas()["smooth"]
    np.testing.assert_allclose(got, np.convolve(x, np.ones(width) / width, "same"), atol=1e-12)


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=501), "b": np.ones(10), "c": np.array([4.0]), "d": np.repeat([1.0, 2.0, 1e9], [50, 3, 1])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("a", float("nan")), ("a", None)], "k string, v double")
    got = quantiles(df, ["k"], "v", {"p5": 0.05, "p50": 0.5, "p95": 0.95}, accuracy=16).toPandas().set_index("k")
    for k, v in data.items():
        np.testing.assert_allclose(got.loc[k, ["p5", "p50", "p95"]].astype(float), np.percentile(v, [5, 50, 95]))
    mm = median_mad(df, ["k"], "v").toPandas().set_index("k")
    for k, v in data.items():
        np.testing.assert_allclose(mm.loc[k, "mad"], np.median(np.abs(v - np.median(v))))


def test_global_rank_with_ties(spark):
    v = [3.0, 1.0, 1.0, 2.0] * 25
    df = spark.createDataFrame([("r", "c", i, x) for i, x in enumerate(v)], "recording string, channel string, t long, value double")
    got = windows.rank_transform(df).orderBy("t").toPandas()["rank"].to_numpy()
    assert (got == np.argsort(np.argsort(v, kind="stable"), kind="stable")).all()


def test_state_edges(spark):
    blocks = [(0, 40), (1, 30), (2, 30)]
    seq = [s for s, n in blocks for _ in range(n)]
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate(seq)], "recording string, t long, state int")
    occ = {r["state"]: r["occupancy"] for r in A.occupancy(df, "recording", "state", 4).collect()}
    assert occ == {0: 0.4, 1: 0.3, 2: 0.3, 3: 0.0}
    life = {r["state"]: r["lifetime"] for r in windows.mean_lifetime(df, 4, block=16).collect()}
    assert life == {0: 40.0, 1: 30.0, 2: 30.0, 3: 0.0}
    gap = {r["state"]: r["interval"] for r in windows.mean_interval(df, 4, block=16).collect()}
    assert set(gap.values()) == {0.0}
    alt = spark.createDataFrame([("r", i, (i // 10) % 2) for i in range(200)], "recording string, t long, state int")
    assert windows.transitions(alt, block=7).count() == 19
    assert {r["interval"] for r in windows.mean_interval(alt, 2, block=7).collect()} == {10.0}


def test_embedding_bounds(spark):
    f = spark.createDataFrame([("r", i, [float(i), 0.5]) for i in range(6)], "recording string, t long, x array<double>")
    assert windows.embed(f, 3, block=4).count() == 4
    for width in (0, 6):
        with pytest.raises(ValueError):
            windows.embed(f, width, n_t=6)
