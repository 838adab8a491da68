import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ondula.llm import common, simhash


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints(spark):
    texts = [None, "", "  ", "One", "One two", "A b\tC d\n e f", "É " + "x y z " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint % (1 << 64) for r in simhash.fingerprints(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    one = docs.where("doc_id = 3").select(F.xxhash64(F.lower("text"))).first()[0]
    assert one % (1 << 64) == got[3]


def test_code_is_perfect():
    (_, count, _), *_ = simhash._cosets()
    assert count.tolist() == [1] * 2048


def test_links_are_all_pairs_within_threshold(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(150):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randrange(4)):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                base ^= 1 << b
            fps.add(base)
    crowd = rng.getrandbits(64)
    fps |= {crowd ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(a)}  # more than LISTED at one anchor
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    found = common.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(5)))
    got = {r.node: r.root for r in found.collect()}
    x = np.array(signed)
    i, j = np.nonzero(np.bitwise_count((x[:, None] ^ x[None]).view(np.uint64)) <= 3)
    label = common.smallest_labels(len(x), i, j)
    assert {f: got.get(f, f) for f in signed} == {f: signed[label[k]] for k, f in enumerate(signed)}


def test_crowded_anchors_are_tiled(spark, monkeypatch):
    base = 0x1234567812345678
    fps = [base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    monkeypatch.setattr(simhash, "CROWD", 50)
    found = common.components(simhash.links(df)).collect()
    x = np.array(sorted(fps))
    i, j = np.nonzero(np.bitwise_count((x[:, None] ^ x[None]).view(np.uint64)) <= 3)
    label = common.smallest_labels(len(x), i, j)
    got = {r.node: r.root for r in found}
    assert {int(f): got.get(int(f), int(f)) for f in x} == {int(f): int(x[label[k]]) for k, f in enumerate(x)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(600), rng.randrange(600)) for _ in range(420)] + [(i + 1000, i + 1001) for i in range(300)] + [(2000, i) for i in range(2001, 2300)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    label = common.smallest_labels(2400, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert got == {n: int(label[n]) for n in {x for e in edges if e[0] != e[1] for x in e}}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges_and_deduplication(spark):
    long = "many words here " * 20000
    rows = [(5, "a b c d", "x"), (2, "A B c d", "x"), (7, None, "x"), (3, "", "x"), (None, "a b c d", "x"), (9, long, "x"), (9, long, "x"), (4, "other text it is", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).where("doc_id is not null").collect())
    assert got == [(2, 2), (3, 3), (4, 4), (5, 2), (7, 3), (9, 9), (9, 9)]
    assert simhash.near_duplicates(docs).where("doc_id is null").first().component_id is None
    kept = simhash.deduplicated(docs)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4, 9]
    assert kept.columns == docs.columns
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_texts_that_share_a_key_stay(spark):
    rows = [(1, "first of the texts", 1), (1, "quite another one here", 2), (1, "first of the texts", 1), (1, "First of the texts", 3), (2, "first of the texts", 4), (3, "third one that stands alone", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    kept = sorted((r.doc_id, r.text.lower()) for r in simhash.deduplicated(docs).collect())
    assert kept == [(1, "first of the texts"), (1, "quite another one here"), (3, "third one that stands alone")]
    first = [tuple(r) for r in simhash.deduplicated(docs).orderBy("doc_id", "text").collect()]
    assert first == [tuple(r) for r in simhash.deduplicated(docs.repartition(5, "n")).orderBy("doc_id", "text").collect()]


def test_units_are_bounded_whatever_the_total(spark):
    """A key of 3,000 members beside two million others: no unit holds more than twice the bound."""
    rows = spark.range(0, 2_000_000, 1, 8).select((F.col("id") % 200_000).alias("key"), F.col("id").alias("member"))
    placed = rows.unionByName(spark.range(3000).select(F.lit(-5).cast("long").alias("key"), F.col("id").alias("member")))
    met = common.units(placed, "key", "member", 100)
    assert met.groupBy("unit").count().agg(F.max("count")).first()[0] <= 2 * 1.5 * 100
    hot = met.where("key = -5")
    tiles = hot.agg(F.max("own")).first()[0] + 1
    assert tiles == 30 and hot.count() == 3000 * tiles
    assert met.where("key <> -5").count() == 2_000_000
