"""Kernels and squares of the jobs that compare all pairs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ondula.operators import graph
from ondula.operators import lines as L
from ondula.operators import nonlinear as N
from ondula.operators import tiles
from ondula.operators.tiles import Chunk
from ondula.plans.registry import rounded


def frames_of(spark, t, x, key="all"):
    return spark.createDataFrame([(key, int(a), [float(v) for v in row]) for a, row in zip(t, x)], "recording string, t bigint, x array<double>").repartition(5)


@pytest.fixture
def small(monkeypatch):
    """Many chunks and sides for few points."""
    monkeypatch.setattr(tiles, "CHUNK", 8)
    monkeypatch.setattr(tiles, "OUT", 50)


def test_no_row_holds_blocks_and_pairs_leave_in_pieces(spark, small):
    rng = np.random.default_rng(0)
    t = np.sort(rng.choice(10_000, 90, replace=False))
    t[10:13], t[50] = t[10], t[49]  # times that come twice are no pairs
    x = rng.normal(size=(90, 3)).round(1)
    f = frames_of(spark, t, x)
    d = N.distance_pairs(f, tiles.METRICS, block=4)
    plan = d._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and "flatten" not in plan
    i, j = np.nonzero(t[:, None] < t[None, :])
    e = np.abs(x[i] - x[j])
    want = Counter(zip(t[i].tolist(), t[j].tolist(), np.sqrt((e ** 2).sum(1)).round(9).tolist(), e.sum(1).round(9).tolist(), e.max(1).round(9).tolist()))
    got = Counter((r.i, r.j, round(r.euclidean, 9), round(r.manhattan, 9), round(r.supremum, 9)) for r in d.collect())
    assert got == want


@pytest.mark.parametrize("metric", tiles.METRICS)
@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-30, 0.0), (1e25, 0.0), (1.0, 1e6)])
def test_near_equals_all_distances(metric, scale, offset):
    rng = np.random.default_rng(1)
    a, b = (rng.normal(size=(n, 6)).round(2) * scale + offset for n in (70, 130))
    b[:10] = a[:10] + 0.5 * scale  # distances at the limit
    b[10, 0], a[3, 2] = np.nan, np.inf
    whole = tiles.distances(a, b, metric)
    for finite in (False, True):
        if finite:
            b[10, 0], a[3, 2] = 0.0, 0.0
            whole = tiles.distances(a, b, metric)
        for limit in (0.0, 0.5 * scale, 2.5 * scale, float(whole[5, 7]), float(whole[40, 90])):
            one, two = Chunk(np.arange(70), a, ()), Chunk(np.arange(100, 230), b, ())
            got = [tiles.unpacked(bits, 130) for _, bits in tiles.near([one], two, metric, limit)] or [np.zeros((70, 130), bool)]
            assert np.array_equal(got[0], whole <= limit)


@pytest.mark.parametrize("rate", [0.0, 0.03, 0.4, 1.0])
def test_quantile_starts_where_a_few_points_point(spark, small, rate, monkeypatch):
    monkeypatch.setattr(tiles, "FEW", 40)
    monkeypatch.setattr(tiles, "GUESS", 12)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    x[60:] = x[:20] + 1e-9  # small distances, and a guess that may be wrong
    x[7] = 1e5
    full = tiles.distances(x, x, "euclidean")
    ranges = []
    monkeypatch.setattr(tiles, "_first_range", lambda *a, was=tiles._first_range: ranges.append(was(*a)) or ranges[-1])
    f = frames_of(spark, np.arange(80), x)
    got = tiles.distance_quantile(f, rate, block=4).first()["_q"]
    assert abs(got - np.quantile(full, rate)) <= 1e-9 * max(1, got) and len(ranges) == 1
    pairs = N.recurrence(f, rate=rate, block=4)
    i, j = np.nonzero(np.triu(full <= got, 1))
    assert {(r.i, r.j) for r in pairs.collect()} == set(zip(i.tolist(), j.tolist()))


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 1.0])
@pytest.mark.parametrize("size", [1, 5, 64, 70])
def test_summary_of_bits_equals_that_of_cells(size, share):
    def table(fields):
        out = Counter()
        for *line, n in zip(*[f.tolist() for f in fields]):
            out[tuple(line)] += n
        return out

    m = np.random.default_rng(size).random((size, size)) < share
    a, b = (Chunk(np.arange(at, at + size), np.zeros((size, 1)), ()) for at in (1000, 5000))
    assert table(L.chunk_summary(a, b, tiles.packed_bits(m))) == table(L.block_summary(m, 1000, 5000, None))
    m |= m.T
    assert table(L.chunk_summary(a, a, tiles.packed_bits(m))) == table(L.block_summary(m, 1000, 1000, np.ones(size, bool)))


@pytest.mark.parametrize("block", [2, 5])
def test_lines_of_many_chunks_with_gaps_and_times_that_come_twice(spark, small, block):
    rng = np.random.default_rng(3)
    t = np.array([k for k in range(75) if k not in (5, 17, 18, 40)] + [10**6 + k for k in range(9)])
    x = np.round(rng.normal(size=(len(t), 1)).cumsum(0), 1)
    t, x = np.append(t, t[20:24]), np.concatenate([x, x[30:34]])
    last = 10**6 + 9
    at = np.where(t < 10**6, t, t - 10**6 + 100)  # the same lines, as nothing is near the gap
    near = np.zeros((110, 110), bool)
    for p, v in zip(at, x):
        for q, w in zip(at, x):
            near[p, q] |= p != q and abs(v - w)[0] <= 0.8
    present = np.isin(np.arange(110), at)
    want = Counter()
    for kind, m in ((0, np.triu(near, 1)), (1, near | np.diag(present))):
        for line in [np.diagonal(m, k) for k in range(1, 110)] if kind == 0 else list(m.T):
            want.update((kind, len(run)) for run in "".join("x" if c else " " for c in line).split())
    lines = L.recurrence_lines(frames_of(spark, t, x), 0.8, block=block)
    assert {(r.kind, r.length): r.n for r in lines.collect()} == dict(want) and last > t.max()
    assert lines._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("MapInArrow") == 1  # blocks are compared once


def test_counts_come_from_squares_without_rows_of_blocks(spark, small):
    rng = np.random.default_rng(4)
    t, x = np.sort(rng.choice(200, 90)), rng.normal(size=(90, 3)).round(1)
    counts = tiles.count_within(frames_of(spark, t, x), 0.7, "supremum", block=3)
    want = int((np.triu(np.abs(x[:, None] - x[None]).max(2) <= 0.7, 1) & (t[:, None] < t[None, :])).sum())
    assert counts.first().pairs == want and "ArrowEvalPython" not in counts._jdf.queryExecution().toString()


@pytest.mark.parametrize("ids, exponent", [("bigint", 3.0), ("string", 2.5)])
def test_inverse_distances_by_packed_points(spark, small, monkeypatch, ids, exponent):
    monkeypatch.setattr(graph, "SIDE_POINTS", 20)
    monkeypatch.setattr(graph, "PACKED", 8)
    rng = np.random.default_rng(5)
    v = np.append(np.arange(70) * 3, [0, 3])  # two points come twice, under one name but not at one place
    x = rng.normal(size=(72, 3)).round(1)
    rows = [("m", str(k) if ids == "string" else int(k), *map(float, p)) for k, p in zip(v, x)] + [("one", "7" if ids == "string" else 7, 0.0, 0.0, 0.0)]
    extra = ("x" if ids == "string" else 1000, None, 1.0, 1.0)  # a point without a place has a row of empty cells and no weight
    points = spark.createDataFrame([*rows, ("m", *extra)], f"mesh string, v {ids}, x double, y double, z double").repartition(4)
    cells = graph.inverse_distance(points, exponent)
    w = ((x[:, None] - x[None]) ** 2).sum(2) + 1e-6
    w = np.where(v[:, None] == v[None, :], 0.0, w ** (-exponent / 2))
    total = {k: w[v == k].sum() for k in v.tolist()}
    want = sorted((a, b, w[i, j] / total[a]) for i, a in enumerate(v.tolist()) for j, b in enumerate(v.tolist()) if a != b)
    got = [(r.mesh, r.i, r.j, r.v) for r in cells.collect()]
    assert all(k == "m" for k, *_ in got) and len([g for g in got if g[3] is None]) == 2 * 72
    full = sorted((int(i), int(j), c) for _, i, j, c in got if c is not None)
    assert [g[:2] for g in full] == [g[:2] for g in want] and np.allclose([g[2] for g in full], [g[2] for g in want], rtol=1e-9, atol=0)
    plan = cells._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "inline" in plan and ("POWER(" in plan) == (exponent == 2.5)  # points come packed, cubes are products


@pytest.mark.parametrize("digits", [6, 8])
def test_rounding_without_decimals_gives_the_same_digits(spark, digits):
    rng = np.random.default_rng(6)
    some = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-12, 12, 3000), rng.integers(-10**6, 10**6, 3000) / 10.0**digits + 0.5 / 10.0**digits,
                           rng.integers(-10**6, 10**6, 3000) / 2.0**20, [0.0, -0.0, -1e-12, 1e300, -1e300, np.inf, -np.inf, np.nan]])
    v = spark.createDataFrame([(float(x),) for x in some] + [(None,)], "v double")
    both = v.select("v", rounded(F.col("v"), digits).alias("a"), F.round("v", digits).alias("b"))
    assert both.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0 and both.where("a IS NULL").count() == 1


@pytest.mark.parametrize("radius", [0.7, 30.0])
def test_near_points_meet_in_regions(spark, monkeypatch, radius):
    monkeypatch.setattr(graph, "PACKED", 4)
    monkeypatch.setattr(graph, "REGION", 2)
    monkeypatch.setattr(graph, "REGION_POINTS", 10)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(60, 3)).round(1) * 2, rng.normal(size=(40, 3)).round(1) * 0.2 - 5])  # a crowded place, and below zero
    v = np.append(np.arange(98), [4, 4])  # a name that comes three times is no pair with itself
    rows = [("m/1", int(k), *map(float, p)) for k, p in zip(v, x)] + [("m", int(k), *map(float, p)) for k, p in zip(v[:30], x)] + [("m", 500, None, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "mesh string, v bigint, x double, y double, z double").repartition(3)
    near = graph.within_distance(points, radius)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    i, j = np.nonzero((d2 < radius * radius) & (v[:, None] != v[None, :]))
    want = Counter([("m/1", int(v[a]), int(v[b]), round(float(np.sqrt(d2[a, b])), 9)) for a, b in zip(i, j)]
                   + [("m", int(v[a]), int(v[b]), round(float(np.sqrt(d2[a, b])), 9)) for a, b in zip(i, j) if max(a, b) < 30])
    assert Counter((r.graph, r.src, r.dst, round(r.length, 9)) for r in near.collect()) == want
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "array_distinct" in plan and "Broadcast" not in plan  # cells are copied to regions, not to neighbours
