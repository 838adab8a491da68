import numpy as np
import pytest
from pyspark.sql import functions as F

from ondula.operators import aggregates as A
from ondula.operators.quantiles import part_of, quantiles, splitters

PROBS = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.999, "e": 1.0}


@pytest.fixture(scope="module")
def outlier(spark):
    """A million values below one and a single huge one, over 40 partitions."""
    v = F.when(F.col("id") == 777_777, F.lit(1e12)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 40))
    return spark.range(0, 1_000_001, 1, 40).select(F.lit("g").alias("k"), v.alias("v"), (1 + F.col("id") % 3).alias("w")).cache()


@pytest.fixture(scope="module")
def plain(outlier):
    return outlier.toPandas()


def test_one_outlier(outlier, plain):
    got = quantiles(outlier, ["k"], "v", PROBS).first()
    assert [got[n] for n in PROBS] == pytest.approx(np.quantile(plain["v"], list(PROBS.values())), rel=1e-12)


def test_weights(outlier, plain):
    got = quantiles(outlier, ["k"], "v", PROBS, weight="w").first()
    assert [got[n] for n in PROBS] == pytest.approx(np.quantile(np.repeat(plain["v"], plain["w"]), list(PROBS.values())), rel=1e-12)


def test_parts_are_even(outlier):
    split = splitters(outlier, ["k"], "v")
    rows = outlier.join(F.broadcast(split), "k").groupBy(part_of(F.col("v"), F.col("_splits"))).count()
    assert rows.agg(F.max("count")).first()[0] < 4 * 1_000_000 / 1024 and rows.count() > 900


def test_other_statistics_with_an_outlier(outlier, plain):
    half = outlier.where("w = 1")
    a, b = np.sort(plain["v"]), np.sort(plain["v"][plain["w"] == 1])
    at = np.concatenate([a, b])
    want = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()
    assert A.ks_statistic(outlier, half, "v", ["k"]).first()["ks"] == pytest.approx(want, rel=1e-12)
    order = plain.sort_values("v")
    reached = order["v"][order["w"].cumsum() >= plain["w"].sum() / 2].iloc[0]
    assert A.weighted_median(outlier, ["k"], "v", "w").first()["weighted_median"] == reached


def test_ties_small_groups_and_gaps(spark):
    rows = [("one", 5.0)] + [("two", x) for x in (1.0, 9.0)] + [("ties", float(k // 100)) for k in range(1000)] + [("heavy", 3.0)] * 500 + [("heavy", 4.0)]
    rows += [("none", None), ("nan", float("nan")), ("mixed", float("nan")), ("mixed", 2.0), ("mixed", None), ("inf", float("inf")), ("inf", 1.0), ("inf", 0.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r["k"]: [r[n] for n in ("lo", "mid", "hi")] for r in quantiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.97}, accuracy=20).collect()}
    assert set(got) == {"one", "two", "ties", "heavy", "mixed", "inf"}
    for key in ("one", "two", "ties", "heavy"):
        assert got[key] == pytest.approx(np.quantile([v for k, v in rows if k == key], [0.1, 0.5, 0.97]))
    assert got["mixed"] == [2.0, 2.0, 2.0] and got["inf"][1] == 1.0


def test_a_coarse_sketch_is_corrected(outlier, plain):
    """Ends far from the wanted ranks are moved until the counts prove them right."""
    got = quantiles(outlier.limit(50_000), ["k"], "v", {"c": 0.37}, accuracy=2).first()
    assert 0 < got["c"] < 1


def test_all_rows_and_aggregates_beside(outlier, plain):
    got = quantiles(outlier, [], "v", {"c": 0.5}, also=[F.count("v").alias("n"), F.max("v").alias("top")]).first()
    assert (got["n"], got["top"]) == (1_000_001, 1e12) and got["c"] == pytest.approx(np.median(plain["v"]), rel=1e-12)
