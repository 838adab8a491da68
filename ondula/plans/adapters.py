"""The provided tables in the shape of the library's schemas.

Each adapter exists twice: as a DataFrame and as the CTE text the oracle uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ondula.session import cut

DAY0 = "1995-01-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frames(spark: SparkSession, sf: str, split: bool = False) -> DataFrame:
    """Embeddings as 64-channel frames; ``split`` gives four recordings by label."""
    rec = F.concat(F.lit("r"), (F.col("label") % 4).cast("string")) if split else F.lit("all")
    return table(spark, sf, "embeddings").select(
        rec.alias("recording"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("x"))


def samples(spark: SparkSession, sf: str, split: bool = False) -> DataFrame:
    f = frames(spark, sf, split)
    return f.select("recording", "t", F.posexplode("x").alias("channel", "value"))


def interleaved(spark: SparkSession, sf: str) -> DataFrame:
    """Four recordings over the same times: frames dealt by turns."""
    return samples(spark, sf).withColumn("recording", F.concat(F.lit("r"), (F.col("t") % 4).cast("string"))).withColumn(
        "t", F.floor(F.col("t") / 4).cast("bigint"))


def event_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Irregular samples: one recording per user, one channel per event type."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("recording"), F.col("event_type").alias("channel"),
        F.col("event_id").alias("t"), "value")


def states(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.lit("all").alias("recording"), F.col("vec_id").alias("t"), F.col("label").alias("state"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily revenue per return flag on a gap-free day index, in thousands."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("channel"), F.datediff("l_shipdate", F.lit(DAY0)).cast("bigint").alias("t"),
        "l_extendedprice")
    sums = li.groupBy("channel", "t").agg((F.round(F.sum("l_extendedprice"), 2) / 1000).alias("value"))
    span = li.groupBy("channel").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    grid = span.select("channel", F.explode(F.sequence("a", "b")).alias("t"))
    return cut(grid.join(sums, ["channel", "t"], "left").select(
        F.lit("sales").alias("recording"), "channel", "t", F.coalesce("value", F.lit(0.0)).alias("value")))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Daily revenue counted from the first day of each channel."""
    d = daily(spark, sf)
    first = d.groupBy("channel").agg(F.min("t").alias("_a"))
    return cut(d.join(first, "channel").select("recording", "channel", (F.col("t") - F.col("_a")).alias("t"), "value"))


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """Directed trade value between customer and supplier nation, largest edge 1."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    sums = (li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
            .join(s, F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
            .groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))
            .agg(F.sum("l_extendedprice").alias("raw")))
    top = F.max("raw").over(W.partitionBy("graph"))
    # written once: graph measures read their edges many times
    return cut(sums.withColumn("graph", F.lit("trade")).select(
        "graph", "src", "dst", F.round(F.col("raw") / top, 9).alias("weight")))


def trade_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.lit("trade").alias("graph"), F.col("n_nationkey").alias("node"))


def voxels(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as voxels: the part is the position, three value columns are the maps."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("subject"), F.col("l_partkey").alias("voxel"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("map"), F.col(c).cast("double").alias("value")) for m, c in
                           (("price", "l_extendedprice"), ("quantity", "l_quantity"), ("discount", "l_discount"))])))


def segmentation(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("voxel"),
                    F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("label_id"),
                    F.col("p_brand").alias("name"), F.col("p_type").alias("tissue"))


def fids(spark: SparkSession, sf: str, dynamics: int = 16) -> DataFrame:
    """Embeddings as decay signals of 32 complex points; the label is the acquisition."""
    e = table(spark, sf, "embeddings").select(
        F.concat(F.lit("a"), F.col("label").cast("string")).alias("acq"), (F.col("vec_id") % 2).cast("int").alias("edit"),
        F.floor(F.col("vec_id") / 2).cast("int").alias("dyn"), F.col("embedding").cast("array<double>").alias("x"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(
        F.get("x", 2 * k).alias("re"), F.get("x", 2 * k + 1).alias("im")))
    return e.select("acq", "edit", "dyn", F.posexplode(pairs).alias("n", "s"))


CTE = {
    "frames": ((), "SELECT 'all' AS recording, vec_id AS t, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"),
    "frames4": ((), "SELECT 'r' || (label % 4) AS recording, vec_id AS t, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"),
    "samples": (("frames",), "SELECT recording, t, unnest(range(64)) AS channel, unnest(x) AS value FROM frames"),
    "samples4": (("frames4",), "SELECT recording, t, unnest(range(64)) AS channel, unnest(x) AS value FROM frames4"),
    "interleaved": (("samples",), "SELECT 'r' || (t % 4) AS recording, t // 4 AS t, channel, value FROM samples"),
    "esamples": ((), "SELECT 'u' || user_id AS recording, event_type AS channel, event_id AS t, value FROM events"),
    "states": ((), "SELECT 'all' AS recording, vec_id AS t, label AS state FROM embeddings"),
    "daily0": ((), f"SELECT l_returnflag AS channel, date_diff('day', DATE '{DAY0}', CAST(l_shipdate AS DATE)) AS t, "
                   "round(sum(l_extendedprice), 2) / 1000 AS value FROM lineitem GROUP BY 1, 2"),
    "dailyg": (("daily0",), "SELECT channel, unnest(range(min(t), max(t) + 1)) AS t FROM daily0 GROUP BY channel"),
    "daily": (("daily0", "dailyg"), "SELECT 'sales' AS recording, channel, t, coalesce(value, 0.0) AS value "
                                    "FROM dailyg LEFT JOIN daily0 USING (channel, t)"),
    "series": (("daily",), "SELECT recording, channel, t - min(t) OVER (PARTITION BY channel) AS t, value FROM daily"),
    "sn": (("series",), "SELECT channel, max(t) + 1 AS n FROM series GROUP BY 1"),
    "trade0": ((), "SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_extendedprice) AS raw FROM lineitem "
                   "JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
                   "JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2"),
    "trade": (("trade0",), "SELECT 'trade' AS graph, src, dst, round(raw / (SELECT max(raw) FROM trade0), 9) AS weight FROM trade0"),
    "nodes": ((), "SELECT 'trade' AS graph, n_nationkey AS node FROM nation"),
    "sym": (("trade",), "SELECT graph, src, dst, max(weight) AS weight FROM (SELECT * FROM trade UNION ALL "
                        "SELECT graph, dst, src, weight FROM trade) GROUP BY 1, 2, 3"),
    "adj": (("sym",), "SELECT graph, src, dst FROM sym WHERE src <> dst AND weight >= "
                      "(SELECT quantile_cont(weight, 0.7) FROM sym WHERE weight > 0)"),
    "voxels": ((), "SELECT l_returnflag AS subject, l_partkey AS voxel, unnest(['price','quantity','discount']) AS map, "
                   "unnest([l_extendedprice, l_quantity, l_discount]) AS value FROM lineitem"),
    "seg": ((), "SELECT p_partkey AS voxel, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS label_id, "
                "p_brand AS name, p_type AS tissue FROM part"),
    "fids": ((), "SELECT 'a' || label AS acq, vec_id % 2 AS edit, vec_id // 2 AS dyn, unnest(range(32)) AS n, "
                 "unnest([CAST(embedding[2*k+1] AS DOUBLE) for k in range(32)]) AS re, "
                 "unnest([CAST(embedding[2*k+2] AS DOUBLE) for k in range(32)]) AS im FROM embeddings"),
}


def with_(*names: str, **extra: str) -> str:
    """``WITH`` clause of the named adapters, their inputs first, then ``extra`` in order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        needs, body = CTE[name]
        for n in needs:
            add(n)
        done.setdefault(name, body)

    for n in names:
        add(n)
    done.update(extra)
    # materialised, so that rounded sums are the same wherever they are read
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({b})" for n, b in done.items()) + " "
