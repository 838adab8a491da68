import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from ondula.llm import mixing


def brute(rows, weights=(5, 2, 1), repeats=3, share=1.0):
    """taken words by key: queues, finish times and the cut as plain lists."""
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, _, t in rows}
    queues = defaultdict(list)
    for k, s, _ in rows:
        queues[s].append(k)
    names = sorted((s for s in queues if s is not None)) + ([None] if None in queues else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = {s: sum(size[k] for k in q) for s, q in queues.items()}
    budget = share * sum(total.values())
    target, open_ = {}, set(names)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > repeats * total[s]}
        for s in over or open_:
            target[s] = float(repeats * total[s]) if over else level * weight[s]
        open_ -= over or set(open_)
    order = []
    for s, q in queues.items():
        q.sort(key=lambda k: (int(hashlib.md5(f"mix:{k}".encode()).hexdigest()[:15], 16), str(k)))
        run = 0
        for e in range(repeats):
            for k in q:
                run += size[k]
                if size[k] and target[s]:
                    order.append((run / target[s], "" if s is None else f"={s}", k))
    spent, taken = 0, defaultdict(int)
    for _, _, k in sorted(order):
        if spent + size[k] > budget:
            break
        spent += size[k]
        taken[k] += size[k]
    return {k: taken[k] for k, _, _ in rows}, target


def test_against_plain_lists(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 4)
    monkeypatch.setattr(mixing, "STEP", 8)
    rows = [(i, None if i % 11 == 0 else f"s{i % 7 if i % 3 else 0}", " w" * ((i * 37) % 50)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(docs, mixing.cyclic_weights(docs, (5, 2, 1))).collect()
    taken, target = brute(rows)
    assert {r.doc_id: r.taken for r in out} == taken
    assert all(abs(r.target - target[r.source]) < 1e-6 * max(1, r.target) for r in out)
    by = defaultdict(int)
    for r in out:
        by[r.source] += r.taken
        assert r.taken <= 3 * r.size
    assert all(abs(by[s] - target[s]) <= 100 for s in by)
    again = mixing.mix(docs.repartition(13), mixing.cyclic_weights(docs, (5, 2, 1)))
    assert {r.doc_id: r.taken for r in again.collect()} == taken


def test_small_source_stops_at_its_limit(spark):
    rows = [(i, "a" if i < 3 else "b", "x y z") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(docs, mixing.cyclic_weights(docs, (5, 2)))
    assert {r.source: (r.target, r.t) for r in out.groupBy("source", "target").agg(F.sum("taken").alias("t")).collect()} == {
        "a": (27.0, 27), "b": (273.0, 273)}
    emitted = mixing.emitted(out)
    assert emitted.where("source = 'a'").count() == 9
    assert emitted.agg(F.max("epoch")).first()[0] == 2


def test_edges(spark):
    schema = "doc_id long, source string, text string, size int, Target string"
    empty = spark.createDataFrame([], schema)
    assert mixing.mix(empty, mixing.cyclic_weights(empty, (5, 2))).count() == 0
    rows = [(None, None, None, 1, "t"), (1, None, "", 1, "t"), (1, "a", "w " * 70000, 1, "t"), (1, "a", "w " * 70000, 1, "t"), (2, "", "one", 1, "t")]
    out = mixing.mix(spark.createDataFrame(rows, schema), mixing.cyclic_weights(spark.createDataFrame(rows, schema), (5, 2, 1))).collect()
    assert len(out) == 5
    assert sorted(r["size"] for r in out) == [0, 0, 1, 70000, 70000]
    assert all(r.taken == r.copies * r["size"] and r.copies <= 3 for r in out)
    blank = spark.createDataFrame([(1, "a", None, 1, "t")], schema)
    assert mixing.mix(blank, mixing.cyclic_weights(blank, (5,))).first().taken == 0
