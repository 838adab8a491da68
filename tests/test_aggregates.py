import numpy as np
import pytest
from pyspark.sql import functions as F

from ondula.operators import aggregates as A
from ondula.operators import graph as G
from ondula.operators import joins as J

FR = "recording string, t long, x array<double>"


def frames(spark, x, rec="r"):
    return spark.createDataFrame([(rec, i, [float(v) for v in r]) for i, r in enumerate(x)], FR)


def test_connectivity_constant_channel(spark):
    x = np.random.default_rng(0).normal(size=(100, 4)) + 1000
    x[:, 2] = 7.3
    got = A.connectivity(frames(spark, x)).toPandas()
    m = got.pivot(index="i", columns="j", values="r").to_numpy()
    ref = np.corrcoef(np.delete(x, 2, 1).T)
    np.testing.assert_allclose(np.delete(np.delete(m, 2, 0), 2, 1), ref, atol=1e-7)
    assert (m[2] == 0).all() and (m[:, 2] == 0).all()


def test_connectivity_single_sample(spark):
    assert {r["r"] for r in A.connectivity(frames(spark, [[1.0, 2.0]])).collect()} == {0.0}


def test_identical_recordings_have_no_distance(spark):
    df = spark.createDataFrame([(float(v),) for v in range(50)], "v double")
    assert A.ks_statistic(df, df, "v").first()["ks"] == 0


def test_mutual_information_matches_histogram(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    x[:, 1] += x[:, 0]
    got = {(r["i"], r["j"]): r["mi"] for r in A.mutual_information(frames(spark, x), bins=8).collect()}
    h, _, _ = np.histogram2d(x[:, 0], x[:, 1], 8)
    p = h / h.sum()
    e = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    ref = np.sum(p[p > 0] * np.log(p[p > 0] / e[p > 0]))
    assert abs(got[(0, 1)] - ref) < 1e-9


def test_valid_values(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 0.0, float("nan"), float("inf"), float("-inf"), None, 5.0)], "value double")
    assert sorted(r["value"] for r in A.valid_values(df).collect()) == [1.0, 5.0]


def test_region_fixture(spark):
    vox = [(i, j, k, 0.8 if max(i, j, k) < 5 else 1.4) for i in range(10) for j in range(10) for k in range(10)]
    seg = [(i, j, k, 2) for i in range(2, 5) for j in range(2, 5) for k in range(2, 5)] + [(i, j, k, 1001) for i in range(5, 8) for j in range(5, 8) for k in range(5, 8)]
    v = spark.createDataFrame(vox, "i int, j int, k int, value double")
    s = spark.createDataFrame(seg, "i int, j int, k int, label_id int")
    dim = spark.createDataFrame([(2, "WM"), (1001, "GM"), (24, "CSF")], "label_id int, tissue string")
    j = J.map_with_labels(v, s, ["i", "j", "k"]).join(dim, "label_id")
    got = {r["tissue"]: r for r in A.tissue_stats(j, dim, ["tissue"]).collect()}
    assert got["WM"]["n"] == 27 and abs(got["WM"]["mean"] - 0.8) < 1e-12
    assert abs(got["GM"]["median"] - 1.4) < 1e-12
    assert got["CSF"]["n"] == 0 and got["CSF"]["mean"] is None


def test_interval_join_counts_each_pair_once(spark):
    rng = np.random.default_rng(2)
    p, a = rng.uniform(0, 100, 200), rng.uniform(0, 90, 20)
    pts = spark.createDataFrame([("r", float(v)) for v in p], "recording string, time double")
    sp = spark.createDataFrame([("r", i, float(v), float(v + 7)) for i, v in enumerate(a)], "recording string, e int, a double, z double")
    n = J.interval_join(pts, sp, ["recording"], "time", "a", "z", 7.0).count()
    assert n == sum(((p >= v) & (p <= v + 7)).sum() for v in a)


def test_greedy_match_may_repeat_left(spark):
    a = np.array([[1.0, 0.2], [0.0, 1.0]])
    b = np.array([[1.0, 0.9], [0.0, 0.1]])
    cells = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(2) for j in range(2)], "i int, j int, v double")
    pairs = J.match_components(cells(a), cells(b))
    assert [p[0] for p in pairs] == [0, 0] and sorted(p[1] for p in pairs) == [0, 1]


def adjacency(spark, a):
    e = spark.createDataFrame([("g", int(i), int(j)) for i, j in np.argwhere(a)], "graph string, src int, dst int")
    n = spark.createDataFrame([("g", i) for i in range(len(a))], "graph string, node int")
    return e, n


@pytest.fixture(scope="module")
def random_graph():
    rng = np.random.default_rng(5)
    u = np.triu(rng.random((12, 12)) < 0.3, 1)
    u[11] = u[:, 11] = False  # a node without edges
    return u | u.T


def test_clustering_directed_and_undirected(spark, random_graph):
    rng = np.random.default_rng(6)
    directed = (rng.random((10, 10)) < 0.4) & ~np.eye(10, dtype=bool)
    for a in (random_graph, directed):
        got = {r["node"]: r["clustering"] for r in G.clustering(*adjacency(spark, a)).collect()}
        for i in range(len(a)):
            nb = np.flatnonzero(a[i])
            ref = 0.0 if len(nb) < 2 else a[np.ix_(nb, nb)].sum() / (len(nb) * (len(nb) - 1))
            assert abs(got[i] - ref) < 1e-12


def test_paths_and_betweenness(spark, random_graph):
    a, n = random_graph, len(random_graph)
    dist, cnt = np.full((n, n), np.inf), np.zeros((n, n))
    for s in range(n):
        dist[s, s], cnt[s, s], frontier = 0, 1, [s]
        while frontier:
            nxt = []
            for v in frontier:
                for w in np.flatnonzero(a[v]):
                    if dist[s, w] == np.inf:
                        dist[s, w] = dist[s, v] + 1
                        nxt.append(w)
                    if dist[s, w] == dist[s, v] + 1:
                        cnt[s, w] += cnt[s, v]
            frontier = nxt
    bc = np.zeros(n)
    for v in range(n):
        for s in range(n):
            for t in range(n):
                if len({s, t, v}) == 3 and dist[s, t] < np.inf and dist[s, v] + dist[v, t] == dist[s, t]:
                    bc[v] += cnt[s, v] * cnt[v, t] / cnt[s, t]
    e, nodes = adjacency(spark, a)
    got = {r["node"]: r["betweenness"] for r in G.betweenness(e, nodes).collect()}
    np.testing.assert_allclose([got[i] for i in range(n)], bc / ((n - 1) * (n - 2)), atol=1e-12)
    reach = dist[(dist < np.inf) & (dist > 0)]
    assert abs(G.path_length(e, nodes).first()["path_length"] - reach.mean()) < 1e-12


def test_path_length_without_edges(spark):
    e, n = adjacency(spark, np.zeros((3, 3), dtype=bool))
    assert G.path_length(e, n).first()["path_length"] == float("inf")


@pytest.mark.parametrize("m", [5, 40])
def test_random_graphs_have_the_size(spark, m):
    sizes = spark.createDataFrame([("g", 10, m)], "graph string, n long, m long")
    r = G.random_graphs(sizes, 3, 1)
    per = r.groupBy("graph").agg(F.count("*").alias("c"), F.count_distinct("src", "dst").alias("d")).collect()
    assert len(per) == 3 and all(x["c"] == x["d"] == 2 * m for x in per)
    assert r.where("src = dst").count() == 0


def test_empty_voxels_do_not_stop_a_job(spark):
    from ondula.functions import scalar as sc
    df = spark.createDataFrame([(500.0, 0.0, 0.0), (500.0, 0.8, 0.05)], "m0 double, t1 double, t2 double")
    c = F.col
    got = df.select(sc.spgr(c("m0"), c("t1"), F.lit(0.2), 0.004).alias("a"), sc.bssfp(c("m0"), c("t1"), c("t2"), F.lit(0.2), 0.004).alias("b"),
                    sc.echo_decay(c("m0"), c("t2"), F.lit(0.01)).alias("c"), sc.venous_oxygen(c("t2"))["oef"].alias("d")).collect()
    assert got[0]["a"] == pytest.approx(500 * np.sin(0.2)) and got[0]["c"] == 0


def test_normal_tail(spark):
    import math

    from ondula.functions.scalar import survival
    xs = [-8.0, -3.0, -0.5, 0.0, 0.3, 1.96, 4.9, 5.0, 9.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(survival(F.col("x")).alias("p")).toPandas()["p"]
    np.testing.assert_allclose(got, [0.5 * math.erfc(x / math.sqrt(2)) for x in xs], rtol=1e-6, atol=1e-15)
