from collections import deque

import numpy as np
import pytest

from ondula.operators import graph as G


def search(adj, s):
    """(distance, shortest paths, order) from ``s``."""
    dist, sigma, order, queue = {s: 0}, {s: 1.0}, [], deque([s])
    while queue:
        u = queue.popleft()
        order.append(u)
        for v in adj.get(u, ()):
            if v not in dist:
                dist[v], sigma[v] = dist[u] + 1, 0.0
                queue.append(v)
            if dist[v] == dist[u] + 1:
                sigma[v] += sigma[u]
    return dist, sigma, order


def brute(adj, nodes):
    total = dict.fromkeys(nodes, 0.0)
    hops = []
    for s in nodes:
        dist, sigma, order = search(adj, s)
        hops += [d for d in dist.values() if d]
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in order:
                if v in adj.get(u, ()) and dist[v] == dist[u] + 1:
                    delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            if v != s:
                total[v] += delta[v]
    n = len(nodes)
    return np.mean(hops) if hops else float("inf"), {v: x / ((n - 1) * (n - 2)) if n > 2 else x for v, x in total.items()}


@pytest.fixture(scope="module")
def graphs(spark):
    rng = np.random.default_rng(3)
    pairs = {"random": {(int(a), int(b)) for a, b in rng.integers(0, 80, (320, 2)) if a != b}, "none": set(),
             "two": {(0, 1), (1, 0)}}
    nodes = {"random": list(range(80)), "none": [4, 9], "two": [0, 1]}
    adjacency = spark.createDataFrame([(g, a, b) for g, p in pairs.items() for a, b in p], "graph string, src int, dst int").repartition(3)
    table = spark.createDataFrame([(g, k) for g, n in nodes.items() for k in n], "graph string, node int")
    want = {}
    for g in pairs:
        adj = {}
        for a, b in pairs[g]:
            adj.setdefault(a, set()).add(b)
        want[g] = brute(adj, nodes[g])
    return adjacency, table, want


def test_hops_in_batches_of_words(graphs):
    adjacency, nodes, want = graphs
    counts = G.hop_counts(adjacency, nodes, words=1).collect()
    for g in ("random", "two", "none"):
        part = {r["depth"]: r["n"] for r in counts if r["graph"] == g}
        mean = sum(d * n for d, n in part.items()) / sum(part.values()) if part else float("inf")
        assert mean == pytest.approx(want[g][0])


def test_path_length(graphs):
    adjacency, nodes, want = graphs
    got = {r["graph"]: r["path_length"] for r in G.path_length(adjacency, nodes).collect()}
    assert got == {g: pytest.approx(want[g][0]) for g in ("random", "none", "two")}


def test_betweenness_in_batches(graphs):
    adjacency, nodes, want = graphs
    got = G.betweenness(adjacency, nodes, sources=40).collect()
    for g in ("random", "none", "two"):
        assert {r["node"]: r["betweenness"] for r in got if r["graph"] == g} == {v: pytest.approx(x, abs=1e-12) for v, x in want[g][1].items()}
