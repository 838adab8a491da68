from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ondula.operators import nonlinear as N
from ondula.operators import windows as Wn
from ondula.operators.lines import block_summary, lines_of_pairs, recurrence_lines, skewed
from ondula.operators.tiles import squares


def runs(cells):
    out, n = [], 0
    for c in [*cells, False]:
        if c:
            n += 1
        elif n:
            out.append(n)
            n = 0
    return out


def brute(m, present):
    """Lines of a whole matrix with true diagonal, by walking it."""
    n = len(m)
    upper = Counter()
    for d in range(1, n):
        upper.update((0, length) for length in runs(m[i, i + d] for i in range(n - d)))
    full = m | m.T | np.diag(present)
    upper.update((1, length) for c in range(n) for length in runs(full[:, c]))
    return dict(upper)


def table(lines, key="r"):
    return {(r["kind"], r["length"]): r["n"] for r in lines.where(F.col("recording") == key).collect()}


@pytest.mark.parametrize("block", [4, 7, 64])
def test_lines_equal_a_walk(spark, block):
    rng = np.random.default_rng(block)
    t = np.array([k for k in range(61) if k not in (5, 17, 18, 40)])
    x = np.round(rng.standard_normal((61, 1)).cumsum(0), 2)
    near = np.zeros((61, 61), bool)
    near[np.ix_(t, t)] = np.abs(x[t] - x[t].T) <= 0.8
    present = np.isin(np.arange(61), t)
    want = brute(np.triu(near, 1), present)
    rows = [("r", int(k), x[k].tolist()) for k in t] + [("flat", k, [1.0]) for k in range(20)] + [("one", 3, [0.0])]
    frames = spark.createDataFrame(rows, "recording string, t long, x array<double>").repartition(3)
    lines = recurrence_lines(frames, 0.8, block=block)
    assert table(lines) == want
    assert table(lines, "flat") == {**{(0, k): 1 for k in range(1, 20)}, (1, 20): 20} and table(lines, "one") == {(1, 1): 1}
    pairs = N.recurrence(frames, 0.8, block=block)
    given = lines_of_pairs(pairs, frames, block=block)
    assert table(given) == want and table(given, "flat") == table(lines, "flat")
    rate = {r["recording"]: (r["n"], r["points"]) for r in N.rate_of_lines(lines, frames).collect()}
    assert rate["r"] == (57, 2 * np.triu(near, 1).sum()) and rate["flat"] == (20, 380) and rate["one"] == (1, 0)
    plan = lines._jdf.queryExecution().toString()
    assert "row_number" not in plan


def test_kernels():
    m = np.random.default_rng(0).random((6, 6)) < 0.5
    s = skewed(m)
    assert all(s[i, j - i + 5] == m[i, j] for i in range(6) for j in range(6)) and s.sum() == m.sum()
    kind, line, start, length, n = block_summary(np.ones((4, 4), bool), 8, 20, None)
    assert sum(n[kind == 0] * length[kind == 0]) == 16 and set(line[kind == 0]) == set(range(9, 16))
    assert sorted(zip(line[kind == 1], start[kind == 1])) == [(c, 20) for c in range(8, 12)] + [(c, 8) for c in range(20, 24)]


def test_dynamics_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(Wn, "WINDOWS_PER_TILE", 3)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 5))
    rows = [("a", k, v.tolist()) for k, v in enumerate(x)] + [("b", k, v.tolist()) for k, v in enumerate(x[:60])]
    frames = spark.createDataFrame(rows, "recording string, t long, x array<double>")
    got = Wn.connectivity_dynamics(frames, 40, 10)
    up = np.triu_indices(5, 1)
    for key, data in (("a", x), ("b", x[:60])):
        fc = np.array([np.corrcoef(data[s:s + 40].T)[up] for s in range(0, len(data) - 39, 10)])
        want = np.corrcoef(fc)
        part = got.where(F.col("recording") == key).collect()
        assert len(part) == len(want) ** 2
        for r in part:
            assert r["r"] == pytest.approx(want[r["w1"], r["w2"]], abs=1e-9)


def test_dynamics_hold_few_tiles(spark, monkeypatch):
    """No row has two tiles (pairs of tiles were rows before), and no task holds more than ``HELD``."""
    monkeypatch.setattr(Wn, "WINDOWS_PER_TILE", 1)
    monkeypatch.setattr(Wn, "HELD", 2)
    x = np.random.default_rng(5).standard_normal((430, 4))
    frames = spark.createDataFrame([("a", k, v.tolist()) for k, v in enumerate(x)], "recording string, t long, x array<double>")
    dyn = Wn.connectivity_dynamics(frames, 40, 10)
    plan = dyn._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and "Join" not in plan
    blocks = spark.range(40).withColumnRenamed("id", "blk")
    side, every = squares(blocks, "blk", 2)
    assert blocks.groupBy(side.alias("s")).count().agg(F.max("count")).first()[0] == 2
    assert blocks.select("blk", every).count() == 40 * 20
    up = np.triu_indices(4, 1)
    want = np.corrcoef([np.corrcoef(x[s:s + 40].T)[up] for s in range(0, 391, 10)])
    got = dyn.toPandas()
    assert len(got) == 1600 and np.allclose(want[got["w1"], got["w2"]], got["r"], atol=1e-9)
