import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ondula.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name, label, precision, recall", [("op7_quality", "quality", 0.99, 0.98), ("op10_toxicity", "toxic", 0.85, 0.7)])
def test_held_out_accuracy(spark, name, label, precision, recall):
    scored = queries.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label), "doc_id").where("held_out")
    c = {(r[0], r[1]): r[2] for r in scored.groupBy(label, "predicted").count().collect()}
    good = c.get((1, 1), 0)
    assert good / (good + c.get((0, 1), 0)) >= precision
    assert good / (good + c.get((1, 0), 0)) >= recall


def test_held_out_is_crc32(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, -3, 10**12)], "doc_id long").select("doc_id", quality.held_out("doc_id", 4, 2).alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.collect())
    assert not spark.range(1).select(F.lit(None).cast("long").alias("doc_id")).select(quality.held_out("doc_id", 4, 2)).first()[0]


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.held_out("doc_id", 4, 2)
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(docs, labels.where(~out)), quality.fit(docs, turned.where(~out)))


def test_follow_the_leader_update():
    """One coordinate, one step: z and n as in the closed form, weight back from them."""
    model = quality.Leader(2)
    model.learn(np.array([0]), np.array([2.0]), 1)
    assert model.z[0] == pytest.approx(-1.0) and model.n[0] == pytest.approx(1.0)
    assert model.weights(np.array([0]))[0] == pytest.approx((1 - quality.L1) / ((quality.BETA + 1) / quality.ALPHA + quality.L2))


def test_negative_risk_is_stepped_back():
    zp, zu = np.array([5.0, 5.0]), np.array([-5.0])
    p, u = toxicity._risk_gradient(zp, zu, 0.5)
    assert (p > 0).all() and (u < 0).all()
    p, u = toxicity._risk_gradient(np.array([0.0]), np.array([5.0]), 0.1)
    assert (p < 0).all() and (u > 0).all()


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_edges(spark, module, label):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (2, "word " * 50000, 0.5), (None, "x", 0.5)], "doc_id long, text string, score double")
    for rows in ([], [(1, 1), (2, 0), (1, None), (None, 1), (9, 1)]):
        labels = spark.createDataFrame(rows, f"doc_id long, {label} int")
        weights = module.fit(docs, labels)
        scores = [r[0] for r in docs.select(module.score(F.col("text"), weights, docs)).collect()]
        assert len(scores) == 4 and all(0 <= s <= 1 for s in scores)
        assert scores[0] == scores[1]
    empty = docs.where("false")
    weights = module.fit(empty, labels)
    assert empty.select(module.score(F.col("text"), weights, empty)).count() == 0
