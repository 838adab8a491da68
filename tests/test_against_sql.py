"""Queries next to their SQL on small tables with the values that larger tables bring."""

import math

import duckdb
import numpy as np
import pytest

import oracle
from ondula.operators import fourier, graph, matrix, nonlinear, tiles
from ondula.plans import load
from ondula.session import cut


def compare(spark, folder, name, **tables):
    """None if query ``name`` and its SQL agree on ``tables``, else the difference."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    q = load()[name]
    df = q.run(spark, str(folder))
    cur = con.execute(q.oracle())
    return oracle.differs([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [d[0] for d in cur.description])


@pytest.mark.parametrize("price", [1000.5, 1001.5, 91000.5, 1000.49, 1000.51])
def test_lengths_round_halves_to_even(spark, tmp_path, price):
    orders = f"SELECT k AS o_orderkey, 7 AS o_custkey, CAST({price} AS DOUBLE) AS o_totalprice FROM (VALUES (2), (3)) v(k)"
    assert compare(spark, tmp_path, "src_06_availability", orders=orders) is None


def joins_of(df):
    """The executed plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_points_are_not_broadcast(spark):
    points = spark.range(400).selectExpr("'m' AS mesh", "id AS v", "id % 20 * 1.0 AS x", "id DIV 20 * 1.0 AS y", "0.0 AS z")
    near = graph.within_distance(points, 3.0)
    assert "Broadcast" not in joins_of(near)
    found = {(r.src, r.dst): r.length for r in near.collect()}
    at = [(v % 20, v // 20) for v in range(400)]
    want = {(a, b): math.dist(at[a], at[b]) for a in range(400) for b in range(400) if a != b and math.dist(at[a], at[b]) < 3}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want) and near.count() == len(want)


def test_pairs_of_all_points_are_not_shuffled(spark):
    points = spark.range(2500).selectExpr("'m' AS mesh", "id AS v", "id % 7 * 1.0 AS x", "id % 11 * 1.0 AS y", "id % 13 * 1.0 AS z")
    cells = graph.inverse_distance(points)
    plan = joins_of(cells)
    # what is exchanged are points and their copies; the last join is not followed by another exchange, nor are pairs sorted
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan
    assert cells.count() == 2500 * 2499
    sums = cells.groupBy("i").agg({"v": "sum"}).collect()
    assert len(sums) == 2500 and all(abs(r[1] - 1) < 1e-9 for r in sums)


def test_chirp_is_made_once_per_length(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3, 202))  # 2 x 101: no factors below the limit
    rows = spark.createDataFrame([(c, t, float(x[c, t]), 0.0) for c in range(3) for t in range(202)], "channel int, t bigint, re double, im double")
    f = fourier.dft(rows, ["channel"], limit=50)
    got = {(r.channel, r.k): complex(r.re, r.im) for r in f.collect()}
    want = np.fft.fft(x, axis=1)
    assert len(got) == 606 and max(abs(got[c, k] - want[c, k]) for c in range(3) for k in range(202)) < 1e-9
    assert "SortMergeJoin" in joins_of(f)


def frames_of(spark, x):
    return spark.createDataFrame([("all", t, [float(v) for v in row]) for t, row in enumerate(x)], "recording string, t bigint, x array<double>")


def test_distances_of_several_metrics_meet_no_join_of_pairs(spark):
    x = np.random.default_rng(2).normal(size=(90, 5))
    f = frames_of(spark, x)
    d = nonlinear.distance_pairs(f, ("euclidean", "manhattan", "supremum"), block=16)
    assert joins_of(d).split("Initial Plan")[0].count("SortMergeJoin") <= 1 and "Broadcast" not in joins_of(d)  # only blocks meet
    rows = d.collect()
    assert len(rows) == 90 * 89 // 2
    for r in rows:
        e = np.abs(x[r.i] - x[r.j])
        assert abs(r.euclidean - math.sqrt((e ** 2).sum())) < 1e-12 and abs(r.manhattan - e.sum()) < 1e-12 and r.supremum == e.max()


@pytest.mark.parametrize("rate", [0.0, 0.005, 0.05, 0.5, 0.98, 1.0])
def test_quantile_of_distances_is_exact_and_writes_no_pairs(spark, rate, monkeypatch):
    monkeypatch.setattr(tiles, "FEW", 40)  # several passes
    x = np.random.default_rng(3).normal(size=(60, 3)).round(1)
    x[40:] = x[:20]  # ties and zeros
    x[7] = 1e6  # a distant point
    full = tiles.distances(x, x, "euclidean")
    got = tiles.distance_quantile(frames_of(spark, x), rate, block=16).first()["_q"]
    assert abs(got - np.quantile(full, rate)) <= 1e-9 * max(1, got)


def test_sides_are_bounded(spark):
    blocks = spark.range(1000).withColumnRenamed("id", "blk")
    assert blocks.select(tiles.squares(blocks, "blk")[1].alias("s")).count() == 1000 * tiles.SIDES


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e9])
def test_supremum_prefilter_loses_and_adds_nothing(scale):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(70, 6)).round(2) * scale, rng.normal(size=(50, 6)).round(2) * scale
    b[:10] = a[:10] + 0.5 * scale  # distances at the limit
    b[10] = 50 * scale
    whole = np.abs(a[:, None] - b[None]).max(axis=2)
    for limit in (0.0, 0.5 * scale, 1.5 * scale, 1e3 * scale, whole[3, 3]):
        i, j, d = tiles.close_pairs(a, b, "supremum", limit)
        want = np.nonzero(whole <= limit)
        assert np.array_equal(i, want[0]) and np.array_equal(j, want[1]) and np.array_equal(d, whole[want])


def test_counts_of_pairs_equal_the_pairs(spark):
    f = frames_of(spark, np.random.default_rng(5).normal(size=(100, 4)))
    pairs = nonlinear.recurrence(f, 1.2, metric="supremum", block=16)
    counts = tiles.count_within(f, 1.2, metric="supremum", block=16)
    assert counts.first().pairs == pairs.count() > 0
    assert nonlinear.rate_of_counts(counts, f).first() == nonlinear.recurrence_rate(pairs, f).first()


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_templates_meet_in_two_dimensions(spark, dim):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, dim + 1)).round(1)
    r = 0.4
    rows = [("a", t, [float(v) for v in row[: dim + (t < 119)]], r) for t, row in enumerate(x)]
    got = tiles.template_counts(spark.createDataFrame(rows, "channel string, t bigint, x array<double>, r double"), ["channel"], dim, block=8)
    assert ("cell1" in joins_of(got)) == (dim > 1)  # the second value is a key: a cell holds no more than both values allow
    near = np.abs(x[:, None, :dim] - x[None, :, :dim]).max(axis=2) <= r
    full = np.arange(120) < 119
    both = near & full & (np.abs(x[:, None, dim] - x[None, :, dim]) <= r)
    for row in got.collect():
        assert (row.c_all, row.c_full) == (near[row.t].sum(), (near[row.t] & full).sum())
        if row.full:
            assert row.c_next == both[row.t].sum()
    assert got.count() == 120


def test_loadings_are_updated_in_one_function(spark, monkeypatch):
    x = np.abs(np.random.default_rng(7).normal(size=(40, 6)))
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "row bigint, v array<double>")
    plans = []

    def seen(df):
        plans.append(joins_of(df).split("Initial Plan")[0].count("ArrowEvalPython"))
        return cut(df)

    monkeypatch.setattr(matrix, "cut", seen)
    w, h = matrix.nmf(rows, 2, 12, seed=2)
    assert max(plans) <= 1  # a worker for each of five updates before
    fit = np.array([r.w for r in w.orderBy("row").collect()]) @ h
    assert np.linalg.norm(x - fit) < 0.6 * np.linalg.norm(x)
