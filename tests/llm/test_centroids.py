import hashlib

import numpy as np

from ondula.llm import centroids


def plain(rows, k, rounds, size):
    """The contract in Python integers."""
    kept = []
    for key, e in rows:
        if e is not None and len(e) == size and all(v is not None and np.isfinite(v) for v in e):
            kept.append((key, [int(np.floor(1024 * float(v))) for v in e]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [x for _, x in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, m)), j) for j, m in enumerate(c)) for _, x in kept]

    for _ in range(rounds):
        own = [j for _, j in assign()]
        for j in set(own):
            members = [x for (_, x), o in zip(kept, own) if o == j]
            c[j] = [sum(v) // len(members) for v in zip(*members)]
    return sorted((str(key), j, d) for (key, _), (d, j) in zip(kept, assign())), c


def check(spark, rows, k=8, rounds=10, size=8):
    df = spark.createDataFrame([(key, e, "x") for key, e in rows], "vec_id long, embedding array<float>, cluster string").repartition(3)
    got, c = centroids.cluster(df, k, rounds, size)
    want, centers = plain([(r.vec_id, r.embedding) for r in df.collect()], k, rounds, size)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want
    assert c == centers
    return got, c


def test_rounds_equal_plain_integers(spark):
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((12, 8))[rng.integers(0, 12, 400)] + 0.1 * rng.standard_normal((400, 8))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(500, None), (501, []), (502, [1.0] * 7), (503, [None] + [0.0] * 7), (504, [float("nan")] * 8), (505, [float("inf")] * 8), (None, [0.5] * 8)]
    rows += rows[:5] + [(3, [0.25] * 8)]
    got, c = check(spark, rows)
    out = centroids.with_inertia(got, c).collect()
    total = sum(r.distance for r in out)
    assert all(r.inertia == total for r in out)
    assert all(r.cluster_inertia == sum(s.distance for s in out if s.cluster == r.cluster) for r in out)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest() for r in out)


def test_ties_and_empty_clusters(spark):
    grid = [(i, [float(i % 3), float(i % 2)] * 4) for i in range(40)]
    check(spark, grid)
    check(spark, [(i, [1.0] * 8) for i in range(30)])


def test_few_or_no_rows(spark):
    check(spark, [(1, [0.5] * 8), (2, [-0.5] * 8)])
    got, c = check(spark, [(1, None)])
    assert c == [] and centroids.with_inertia(got, c).columns[-1] == "centroid_sha256" and centroids.with_inertia(got, c).count() == 0


def test_bounds_are_below_the_distance_and_spare_comparisons():
    rng = np.random.default_rng(2)
    centers = rng.integers(-900, 900, (8, 64))
    x = centers[rng.integers(0, 8, 3000)] + rng.integers(-60, 60, (3000, 64))
    start = x[:8].copy()
    pivots = centroids.placed(x[:1024], start, 10)
    d = np.sqrt(centroids.pairwise(x, pivots).astype(float))
    made = []
    c = start
    for _ in range(10):
        bounds = centroids.Bounds(c, pivots)
        exact = centroids.pairwise(x, c)
        assert (bounds.lower(d) <= np.sqrt(exact.astype(float)) * (1 + 1e-12)).all()
        own, best, n = centroids.nearest(x, d, bounds)
        assert (own == exact.argmin(1)).all() and (best == exact.min(1)).all()
        made.append(n / exact.size)
        c = centroids.moved(c, {int(j): (int((own == j).sum()), x[own == j].sum(0).tolist()) for j in np.unique(own)})
    assert made[-1] < 0.4


def test_large_components():
    rng = np.random.default_rng(3)
    x = rng.integers(1 - centroids.MOST, centroids.MOST, (20, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in x[:3]] for u in x]
    assert centroids.pairwise(x, x[:3]).tolist() == want
