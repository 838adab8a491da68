"""Streaming queries over the event file, and the user-function surface."""

from pyspark.sql import functions as F

from ondula.functions.tables import register_window_ids
from ondula.operators import matrix as M
from ondula.operators.sweep import Registry
from ondula.plans import adapters as ad
from ondula.plans.adapters import with_
from ondula.plans.registry import query
from ondula.streaming import hopping, runs
from ondula.streaming.sinks import drain

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def live(spark, sf):
    s = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    return s.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("t"), F.concat(F.lit("u"), F.col("user_id")).alias("recording"),
                    F.col("event_type").alias("channel"), "value")


HOP = ("WITH e AS (SELECT epoch_us(ts) AS us, event_type AS channel, value FROM events), "
       "w AS (SELECT (us // 1800000000 - k) * 1800000000 AS s, channel, value FROM e, (SELECT unnest(range(2)) AS k)), "
       "g AS (SELECT s, channel, count(*) AS n, avg(value) AS mean, avg(value * value) AS power FROM w GROUP BY 1, 2) "
       "SELECT s // 1000000 AS start, channel, n, mean, power FROM g WHERE s + 3600000000 <= (SELECT max(us) FROM e) - 3600000000")


def _hop(spark, sf):
    one = live(spark, sf).withColumn("recording", F.lit("all"))
    return hopping.hopping_power(one, "1 hour", "30 minutes", "1 hour")


@query("str_01_hopping_band_power", "start:l channel n:l mean:6 power:9", HOP)
def _(spark, sf):
    return drain(_hop(spark, sf)).withColumn("start", F.unix_seconds("start"))


@query("str_02_chunked_projection", "t:l source value:6",
       "WITH e AS (SELECT epoch_us(ts) // 3600000000 AS h, event_type, value FROM events) "
       "SELECT h * 3600 AS t, s AS source, sum(value * CASE s WHEN 'a' THEN length(event_type) ELSE 1 END) AS value FROM e, (SELECT unnest(['a', 'b']) AS s) "
       "WHERE (s = 'a' OR event_type = 'click') AND h <= (SELECT max(h) - 1 FROM e) GROUP BY 1, 2")
def _(spark, sf):
    types = ad.table(spark, sf, "events").select(F.col("event_type").alias("j")).distinct()
    a = types.select(F.lit("a").alias("i"), "j", F.length("j").cast("double").alias("v"))
    b = types.where("j = 'click'").select(F.lit("b").alias("i"), "j", F.lit(1.0).alias("v"))
    one = live(spark, sf).withColumn("recording", F.lit("all")).withColumn("ts", F.date_trunc("hour", "ts"))
    return drain(hopping.project_live(one, a.unionByName(b), "1 hour")).select(F.unix_seconds("ts").alias("t"), "source", "value")


@query("str_03_artifact_flags", "start:l channel rms:6 artifact:b",
       HOP.replace("SELECT s // 1000000 AS start, channel, n, mean, power FROM g", "SELECT s // 1000000 AS start, channel, sqrt(power) AS rms, sqrt(power) >= l AS artifact FROM g JOIN (SELECT event_type AS channel, 1.2 * sqrt(avg(value * value)) AS l FROM events GROUP BY 1) USING (channel)"))
def _(spark, sf):
    level = ad.event_samples(spark, sf).groupBy("channel").agg((1.2 * F.sqrt(F.avg(F.col("value") ** 2))).alias("level"))
    one = live(spark, sf).withColumn("recording", F.lit("all"))
    return drain(hopping.flag_artifacts(one, level, "1 hour", "30 minutes", "1 hour")).withColumn("start", F.unix_seconds("start"))


@query("str_04_state_runs", "recording state:l first:l last:l length:l dropped:l",
       "WITH e AS (SELECT 'u' || user_id AS recording, event_id AS t, epoch_us(ts) // 1000 AS ms, length(event_type) AS state FROM events), "
       "w AS (SELECT max(ms) - 3600000 AS wm FROM e), s AS (SELECT e.* FROM e, w WHERE ms <= wm), "
       "o AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY ms, t) AS k, max(t) OVER (PARTITION BY recording ORDER BY ms, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s), "
       "u AS (SELECT *, sum(CASE WHEN t <= top THEN 1 ELSE 0 END) OVER (PARTITION BY recording ORDER BY k) AS lost FROM o), "
       "g AS (SELECT *, lag(state) OVER x AS p, lag(ms) OVER x AS pm FROM u WHERE top IS NULL OR t > top WINDOW x AS (PARTITION BY recording ORDER BY k)), "
       "i AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> state OR ms - pm > 43200000 THEN 1 ELSE 0 END) OVER (PARTITION BY recording ORDER BY k) AS run FROM g), "
       "r AS (SELECT recording, run, any_value(state) AS state, min(t) AS first, max(t) AS last, count(*) AS length, max(ms) AS ms, max(k) AS k FROM i GROUP BY 1, 2), "
       "n AS (SELECT *, lead(k) OVER (PARTITION BY recording ORDER BY run) AS following FROM r) "
       "SELECT n.recording, n.state, first, last, length, (SELECT count(*) FROM o WHERE o.recording = n.recording AND o.t <= o.top AND (n.following IS NULL OR o.k < n.following)) AS dropped "
       "FROM n, w WHERE following IS NOT NULL OR n.ms + 43200000 <= wm")
def _(spark, sf):
    s = live(spark, sf).select("ts", "recording", "t", F.length("channel").cast("bigint").alias("state"))
    with runs.with_state_store(spark):
        return drain(runs.run_lengths(s, "1 hour", 12 * 3600.0))


# --------------------------------------------------------------- user functions


def line_model(p, protocol):
    """A user forward model: offset and slope over the protocol's x."""
    return p[:, [0]] + p[:, [1]] * protocol["x"]


@query("udf_02_user_forward_model", "label:l a:3 b:3 rmse:5",
       "WITH e AS (SELECT label, unnest(range(64)) AS k, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings), m AS (SELECT label, k, 1 + 0.5 * k + avg(v) AS y FROM e GROUP BY 1, 2), "
       "f AS (SELECT label, regr_intercept(y, k) AS a, regr_slope(y, k) AS b FROM m GROUP BY 1) SELECT label, any_value(a) AS a, any_value(b) AS b, sqrt(avg((y - a - b * k) ** 2)) AS rmse FROM m JOIN f USING (label) GROUP BY 1")
def _(spark, sf):
    import numpy as np
    e = ad.table(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "v"))
    m = e.groupBy("label", "k").agg((1 + 0.5 * F.col("k") + F.avg("v")).alias("y")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("k", "y"))).alias("c"))
    f = M.VoxelFitter(line_model, (-5.0, -5.0), (5.0, 5.0)).fit(m.select("label", F.col("c.y").alias("x")), {"x": np.arange(64.0)}, (0.5, 0.1))
    return f.select("label", F.get("params", F.lit(0)).alias("a"), F.get("params", F.lit(1)).alias("b"), "rmse")


@query("udf_03_user_graph_function", "region:l t:l value:6",
       with_("trade") + ", o AS (SELECT src AS region, sum(weight) AS s FROM trade GROUP BY 1) SELECT region, 0 AS t, s AS value FROM o UNION ALL SELECT src, 1, sum(weight * coalesce(s, 0)) FROM trade LEFT JOIN o ON region = dst GROUP BY 1")
def _(spark, sf):
    from ondula.operators.graph import lesion_sweep
    from ondula.plans.graphs import two_step_flow
    none = spark.createDataFrame([(0, -1)], "lesion int, region int")
    return lesion_sweep(ad.trade(spark, sf), none, two_step_flow).select("region", "t", F.col("lesioned").alias("value"))


@query("udf_04_cleaning_registry", "channel t:l value:6",
       with_("daily") + "SELECT channel, t, value - avg(value) OVER (PARTITION BY channel) AS value FROM daily")
def _(spark, sf):
    reg = Registry()
    reg.add("demean", demean, "subtract the mean of each series")
    return reg.apply("demean", ad.daily(spark, sf), ["recording", "channel"])


def demean(samples, keys):
    m = samples.groupBy(*keys).agg(F.avg("value").alias("_m"))
    return samples.join(m, list(keys)).withColumn("value", F.col("value") - F.col("_m")).drop("_m")


@query("udf_05_preparation_chain", "t:l n:l first:6",
       with_("frames") + ", z AS (SELECT t, x[1] AS v FROM frames), s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM z WHERE t <= (SELECT max(t) - 2 FROM z)) "
       "SELECT t, 192 AS n, (v - m) / s AS first FROM z, s WHERE t <= (SELECT max(t) - 2 FROM z)")
def _(spark, sf):
    p = M.prepare(ad.frames(spark, sf), {"tde": {"n_embeddings": 3}, "standardize": {}})
    return p.select("t", F.size("x").alias("n"), F.get("x", F.lit(0)).alias("first"))


@query("udf_06_window_expansion", "t:l win:l",
       "SELECT vec_id AS t, win FROM embeddings, (SELECT unnest(range(1000)) AS win) WHERE vec_id >= win * 20 AND vec_id < win * 20 + 50")
def _(spark, sf):
    register_window_ids(spark)
    ad.table(spark, sf, "embeddings").select(F.col("vec_id").alias("t")).createOrReplaceTempView("ondula_t")
    return spark.sql("SELECT t, win FROM ondula_t, LATERAL window_ids(t, 50, 20)")
