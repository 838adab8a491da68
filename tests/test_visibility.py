import numpy as np
import pytest
from pyspark.sql import functions as F

from ondula.operators import visibility as V


def brute(t, v, kind):
    out = set()
    for a in range(len(t)):
        top = -np.inf
        for b in range(a + 1, len(t)):
            h = (v[b] - v[a]) / (t[b] - t[a]) if kind == "natural" else v[b]
            if h > top and (kind == "natural" or top < v[a]):
                out.add((int(t[a]), int(t[b])))
            top = max(top, h)
    return out


def shape(name, n=700):
    rng = np.random.default_rng(7)
    t = np.arange(n)
    return {"noise": rng.standard_normal(n), "walk": rng.standard_normal(n).cumsum(), "cap": -((t - n / 2) ** 2.0), "bowl": (t[:90] - 45) ** 2.0,
            "steps": np.floor(t / 50), "flat": np.zeros(n)}[name]


@pytest.mark.parametrize("kind", ["natural", "horizontal"])
def test_edges_over_many_levels(spark, monkeypatch, kind):
    monkeypatch.setattr(V, "FAN", 3)
    names = ["noise", "walk", "cap", "bowl", "steps", "flat"]
    rows, want = [], {}
    for k, name in enumerate(names):
        v = shape(name)
        t = np.arange(len(v)) + 1000 * k - 1500
        keep = np.ones(len(v), bool)
        keep[30:50] = name == "bowl"
        want[name] = brute(t[keep], v[keep], kind)
        rows += [("r", name, int(a), float(b)) for a, b in zip(t[keep], v[keep])]
    s = spark.createDataFrame(rows, "recording string, channel string, t long, value double").repartition(4)
    got = V.visibility_edges(s, kind, block=8).collect()
    for name in names:
        edges = [(r["i"], r["j"]) for r in got if r["channel"] == name]
        assert len(edges) == len(set(edges)) and set(edges) == want[name], name


def test_no_row_holds_a_whole_series(spark, monkeypatch):
    """A series of 1,000 blocks: every summary that is written holds at most ``FAN`` blocks."""
    written = []
    real = V.cut
    monkeypatch.setattr(V, "cut", lambda df: written.append(real(df)) or written[-1])
    v = F.rand(3).alias("value")
    s = spark.range(8000).select(F.lit("r").alias("recording"), F.lit("c").alias("channel"), F.col("id").alias("t"), v).persist()
    edges = V.visibility_edges(s, "natural", block=8)
    n = edges.count()
    sizes = [w.agg(F.max(F.size("_s"))).first()[0] for w in written if "_s" in w.columns]
    assert len(sizes) == 2 and max(sizes) == V.FAN
    assert n > 8000
