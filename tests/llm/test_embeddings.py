import numpy as np
import pytest
from pyspark.sql import functions as F

from ondula.llm import common, embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.stack([v for _, v in good])
    sim = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None]
    i, j = np.nonzero((sim >= cosine) & ~np.eye(len(x), dtype=bool))
    ids = np.array([k for k, _ in good])
    order = np.argsort(ids)
    rank = np.argsort(order)
    label = common.smallest_labels(len(x), rank[i], rank[j])
    n = np.bincount(i, minlength=len(x))
    out = {k: (0, k) for k, _ in rows}
    return out | {int(ids[k]): (int(n[k]), int(ids[order[label[rank[k]]]])) for k in range(len(x))}, len(i)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 64))
    x[900:1100] = x[0] + rng.standard_normal((200, 64)) * rng.uniform(0.05, 0.45, (200, 1))  # a crowd, partly beyond the threshold
    x[1100:1400] = x[100:400] + rng.standard_normal((300, 64)) * 0.3
    x[1400:1450] = x[1]
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("crowd", [embeddings.CROWD, 20])
def test_recall_and_counts(spark, vectors, monkeypatch, crowd):
    monkeypatch.setattr(embeddings, "CROWD", crowd)
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame([(*v, 0) for v in vectors], SCHEMA).repartition(6)).collect()}
    want, links = brute(vectors)
    assert len(got) == len(vectors)
    assert all(got[k].n_links <= n for k, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.95 * links
    assert sum(got[k].component_id == c for k, (_, c) in want.items()) >= 0.97 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_small_key_in_a_crowded_cell_is_counted_once(spark):
    cell = F.pmod(F.hash("id"), F.lit(common.CELLS))
    small = spark.range(1, 1 << 21).where(cell == spark.range(1).select(cell).first()[0]).first()[0]  # a key in the cell of key 0
    rows = [(0, i, [0, 0], 1, [float(i + 1), 1.0]) for i in range(100, 1100)] + [(small, i, [small, small], 1, [1.0, float(i) / 100]) for i in range(12)]
    placed = spark.createDataFrame(rows, "key long, id long, codes array<int>, copies long, embedding array<double>")
    met = common.units(placed, "key", "id", 100)
    met = met.select("unit", *[c for c in met.columns if c != "unit"]).repartition(8, "unit").sortWithinPartitions("unit")
    out = met.mapInArrow(embeddings._linked(0.9), "u long, v long, links long").groupBy("u").agg(F.sum("links").alias("n")).collect()
    assert {r.u: r.n for r in out if r.u < 12} == dict.fromkeys(range(12), 11)
    assert {r.u: r.n for r in out if r.u >= 100} == dict.fromkeys(range(100, 1100), 999)


@pytest.mark.parametrize("mean", [0.0, 0.8])
def test_recall_with_a_common_direction(spark, mean):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2100, 64))
    x = np.sqrt(mean) * np.eye(64)[0] + np.sqrt(1 - mean) * x / np.linalg.norm(x, axis=1)[:, None]
    if mean:  # pairs at the threshold among vectors with a common direction
        u = rng.standard_normal((700, 64))
        u -= (u * x[:700]).sum(1, keepdims=True) * x[:700]
        x[1400:] = 0.902 * x[:700] + np.sqrt(1 - 0.902**2) * u / np.linalg.norm(u, axis=1)[:, None]
    else:  # a group of a third of all rows, with pairs close to the threshold
        x[:700] = x[0] + rng.standard_normal((700, 64)) / 8 * 0.33
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    want, links = brute([r[:2] for r in rows])
    assert links > 800 and all(got[k] <= n for k, (n, _) in want.items())
    assert sum(got.values()) >= embeddings.RECALL * links, (sum(got.values()), links)


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, None, 0), (2, [0.0, 0.0, 0.0], 0), (3, [1.0, None, 2.0], 0), (4, [float("nan"), 1.0, 1.0], 0), (5, [float("inf"), 1.0, 1.0], 0), (6, [], 0),
            (7, v, 0), (8, v, 0), (9, [2.0, 4.0, 6.0], 0), (10, v + [1.0], 0), (None, v, 0), (11, [-1.0, -2.0, -3.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got == {**{i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 11)}, 7: (2, 7, True), 8: (2, 7, False), 9: (2, 7, False), None: (0, None, False)}
    assert embeddings.near_duplicates(df.where("false")).count() == 0
    assert embeddings.near_duplicates(df.where("vec_id = 1")).first().n_links == 0
