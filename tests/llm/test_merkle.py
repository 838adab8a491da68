import hashlib

import pytest
from pyspark.sql import functions as F

from ondula.llm import merkle


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    """(root, siblings of each leaf from below)."""
    own, proofs = list(range(len(digests))), [[] for _ in digests]
    level = digests
    while len(level) > 1:
        for i, k in enumerate(own):
            other = k ^ 1
            proofs[i].append((bool(k & 1), level[other] if other < len(level) else ""))
        own = [k // 2 for k in own]
        level = [h("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
    return level[0], proofs


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0], h("".join(field(v) for v in (r[0], r[1], r[2], r[3], r[4])))))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for lang in langs:
        leaves = sorted(by[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs[lang] = leaves, *tree([d for _, d in leaves])
    root, tails = tree([subs[lang][1] for lang in langs])
    return sorted((str(k), d, subs[lang][1], root, tuple(p + t)) for lang, t in zip(langs, tails) for (k, d), p in zip(subs[lang][0], subs[lang][2]))


def check(spark, rows, band):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars int, text string, leaf string").repartition(3)
    got = merkle.manifest(df, band=band).withColumn("back", merkle.folded(F.col("leaf"), F.col("proof")))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof", "back"]
    out = got.collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, tuple((s.left, s.digest) for s in r.proof)) for r in out) == plain(rows)
    assert all(r.back == r.root for r in out)


ROWS = [(i, f"s{i % 3}", ("en", "de", None, "日本", "")[0 if i % 3 else i % 5], i, "tëxt " * (i % 4)) for i in range(70)]
ODD = [(None, None, None, None, None), (None, None, None, None, None), (7, "s", "en", 3, None), (7, "s", "en", 3, None), (7, "s", "en", 4, "y"), (99, "s", "lone", 1, "x" * 100000), (100, "a", "=", None, "")]


@pytest.mark.parametrize("band", [1, 2, 3, 12])
def test_manifest_equals_plain_trees(spark, band):
    check(spark, ROWS + ODD, band)


def test_lone_leaf(spark):
    check(spark, [(1, "s", "en", 1, "x")], 2)


def test_many_trees(spark):
    check(spark, [(i, "s", f"l{i}", 1, "x") for i in range(41)], 2)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars int, text string")
    assert merkle.manifest(df).collect() == []


def test_tampering_shows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, lang string, n_chars int, text string")
    other = merkle.digest_of(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS])
    got = merkle.manifest(df.withColumn("other", other), keep=("other",), band=3)
    assert got.where(merkle.folded(F.col("other"), F.col("proof")) == F.col("root")).count() == 0


def test_a_tree_of_thousands(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.col("id").cast("string").alias("text"))
    rows = [(i, "s", "en", 1, str(i)) for i in range(9000)]
    out = merkle.manifest(df, band=4).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, tuple((s.left, s.digest) for s in r.proof)) for r in out) == plain(rows)
