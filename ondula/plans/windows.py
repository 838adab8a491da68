"""Window, ranking and set queries. Small blocks make the block hand-over part of every check."""

from pyspark.sql import functions as F

from ondula.operators import aggregates as A
from ondula.operators import ranking as R
from ondula.operators import sets as S
from ondula.operators import windows as Wn
from ondula.plans import adapters as ad
from ondula.plans.adapters import with_
from ondula.plans.joins import EPOCH, epoch_rows
from ondula.plans.registry import query


def phases(spark, sf):
    return ad.daily(spark, sf).select("recording", "channel", "t", (F.col("value") / 100).alias("phase"))


@query("win_01_instantaneous_frequency", "channel t:l freq:5",
       with_("daily") + ", p AS (SELECT channel, t, value / 100 AS p, lead(value / 100) OVER (PARTITION BY channel ORDER BY t) AS q FROM daily), "
       "d AS (SELECT channel, t, (q - p + pi()) - 2 * pi() * floor((q - p + pi()) / (2 * pi())) - pi() AS d FROM p) "
       "SELECT channel, t, coalesce(d, lag(d) OVER (PARTITION BY channel ORDER BY t)) * 250 / (2 * pi()) AS freq FROM d")
def _(spark, sf):
    return Wn.instantaneous_frequency(phases(spark, sf), 250.0, block=256)


@query("win_02_embedding", "t:l n:l total:6 first:6 last:6",
       with_("frames") + ", e AS (SELECT t, list(x) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS w FROM frames) "
       "SELECT t, 320 AS n, list_sum(flatten(w)) AS total, w[1][1] AS first, w[5][64] AS last FROM e WHERE len(w) = 5")
def _(spark, sf):
    e = Wn.embed(ad.frames(spark, sf), 5, block=64)
    return e.select("t", F.size("x").alias("n"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("total"), F.get("x", F.lit(0)).alias("first"),
                    F.element_at("x", -1).alias("last"))


@query("win_03_delay_tensor", "t:l lag:l channel:l value:8",
       with_("samples") + "SELECT t - lag AS t, lag, channel, value FROM samples, (SELECT unnest(range(3)) AS lag) WHERE t - lag >= 0 AND t - lag + 2 <= (SELECT max(t) FROM samples)")
def _(spark, sf):
    return Wn.delay_tensor(ad.samples(spark, sf), 3)


@query("win_04_strided_embedding", "channel t:l x0:6 x1:6 x2:6",
       with_("daily") + "SELECT * FROM (SELECT channel, t, value AS x0, lead(value, 2) OVER w AS x1, lead(value, 4) OVER w AS x2 FROM daily WINDOW w AS (PARTITION BY channel ORDER BY t)) WHERE x2 IS NOT NULL")
def _(spark, sf):
    return Wn.embed_channel(ad.daily(spark, sf), 3, 2, block=256).select("channel", "t", *[F.get("x", F.lit(k)).alias(f"x{k}") for k in range(3)])


RUNS = with_("states") + (", g AS (SELECT *, lag(state) OVER (ORDER BY t) AS p FROM states), "
                          "i AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> state THEN 1 ELSE 0 END) OVER (ORDER BY t) AS run FROM g), "
                          "r AS (SELECT run, state, min(t) AS first, max(t) AS last, count(*) AS length FROM i GROUP BY 1, 2) ")


@query("win_05_run_lengths", "run:l state:l first:l last:l length:l", RUNS + "SELECT * FROM r")
def _(spark, sf):
    return Wn.run_lengths(ad.states(spark, sf), block=64)


@query("win_06_mean_lifetime", "state:l lifetime:6",
       RUNS + "SELECT k.state, coalesce(avg(length) / 250, 0) AS lifetime FROM (SELECT unnest(range(12)) AS state) k LEFT JOIN r USING (state) GROUP BY 1")
def _(spark, sf):
    return Wn.mean_lifetime(ad.states(spark, sf), 12, 250.0, block=64)


@query("win_07_mean_interval", "state:l interval:6",
       RUNS + ", n AS (SELECT state, lead(first) OVER (PARTITION BY state ORDER BY first) - last - 1 AS gap FROM r) "
       "SELECT k.state, coalesce(avg(gap) / 250, 0) AS interval FROM (SELECT unnest(range(12)) AS state) k LEFT JOIN n USING (state) GROUP BY 1")
def _(spark, sf):
    return Wn.mean_interval(ad.states(spark, sf), 12, 250.0, block=64)


WINDOWS = ("SELECT win, t, channel, value FROM samples, (SELECT unnest(range((SELECT (max(t) + 1 - {w}) // {s} + 1 FROM samples))) AS win) "
           "WHERE t >= win * {s} AND t < win * {s} + {w}")


@query("win_08_sliding_windows", "win:l centre:l n:l total:6",
       with_("samples") + f", w AS ({WINDOWS.format(w=50, s=20)}) SELECT win, win * 20 + 25 AS centre, count(*) AS n, sum(value) AS total FROM w GROUP BY 1")
def _(spark, sf):
    return Wn.slide(ad.samples(spark, sf), 50, 20).groupBy("win", "centre").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


FCD = with_("samples") + (f", w AS ({WINDOWS.format(w=100, s=50)}), f AS (SELECT a.win, a.channel AS i, b.channel AS j, corr(a.value, b.value) AS r FROM w a JOIN w b "
                          "ON a.win = b.win AND a.t = b.t AND a.channel < b.channel GROUP BY 1, 2, 3), "
                          "d AS (SELECT a.win AS w1, b.win AS w2, corr(a.r, b.r) AS r FROM f a JOIN f b ON a.i = b.i AND a.j = b.j GROUP BY 1, 2) ")


@query("win_09_connectivity_dynamics", "w1:l w2:l r:6", FCD + "SELECT * FROM d")
def _(spark, sf):
    return Wn.connectivity_dynamics(ad.frames(spark, sf), 100, 50)


@query("win_10_dynamics_distance", "ks:6",
       FCD + ", u AS (SELECT r, CAST(w1 % 2 = 0 AS INTEGER) AS a, CAST(w1 % 2 = 1 AS INTEGER) AS b FROM d WHERE w1 < w2), "
       "c AS (SELECT r, sum(sum(a)) OVER (ORDER BY r) AS ca, sum(sum(b)) OVER (ORDER BY r) AS cb FROM u GROUP BY r) "
       "SELECT max(abs(ca / (SELECT sum(a) FROM u) - cb / (SELECT sum(b) FROM u))) AS ks FROM c")
def _(spark, sf):
    from ondula.session import cut
    d = cut(Wn.connectivity_dynamics(ad.frames(spark, sf), 100, 50).where("w1 < w2"))  # only these count below
    return Wn.dynamics_distance(d.where("w1 % 2 = 0"), d.where("w1 % 2 = 1"))


@query("win_11_moving_average", "channel t:l smooth:6",
       with_("daily") + "SELECT channel, t, sum(value) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6 AS smooth FROM daily")
def _(spark, sf):
    return Wn.moving_average(ad.daily(spark, sf), 6, block=256)


@query("win_12_first_crossing", "graph transition:l",
       with_("daily") + ", s AS (SELECT t, coalesce(sum(value) FILTER (channel = 'A'), 0) AS l, coalesce(sum(value) FILTER (channel <> 'A'), 0) * 0.3 AS n FROM daily GROUP BY 1), "
       "m AS (SELECT t, sum(l) OVER w AS l, sum(n) OVER w AS n FROM s WINDOW w AS (ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) "
       "SELECT 'sales' AS graph, coalesce(min(t) FILTER (n > l), max(t) + 1) AS transition FROM m")
def _(spark, sf):
    c = ad.daily(spark, sf).select(F.col("recording").alias("graph"), F.when(F.col("channel") == "A", 0).otherwise(1).alias("region"), "t",
                                   F.when(F.col("channel") == "A", F.col("value")).otherwise(F.col("value") * 0.3).alias("value"))
    return Wn.local_network_transition(c, 0, 5, block=256)


@query("win_13_baseline_correction", "epoch:l event_id:l value:6",
       EPOCH + "SELECT epoch, event_id, value - avg(value) FILTER (rel <= 0) OVER (PARTITION BY epoch, channel) AS value FROM e")
def _(spark, sf):
    return Wn.baseline_correct(epoch_rows(spark, sf), ["epoch", "channel"])


@query("win_14_rank_transform", "channel t:l rank:l", with_("esamples") + "SELECT channel, t, row_number() OVER (PARTITION BY channel ORDER BY value, t) - 1 AS rank FROM esamples")
def _(spark, sf):
    return Wn.rank_transform(ad.event_samples(spark, sf), ["channel"])


@query("win_15_explained_variance", "id n_keep:l",
       with_("samples4") + ", s AS (SELECT recording AS id, channel AS k, stddev_pop(value) AS s FROM samples4 GROUP BY 1, 2), "
       "c AS (SELECT id, k, sum(s * s) OVER (PARTITION BY id ORDER BY k) / sum(s * s) OVER (PARTITION BY id) AS e FROM s) "
       "SELECT id, min(k) + 1 AS n_keep FROM c WHERE e >= 0.5 GROUP BY 1")
def _(spark, sf):
    s = ad.samples(spark, sf, split=True).groupBy(F.col("recording").alias("id"), F.col("channel").alias("k")).agg(F.stddev_pop("value").alias("s"))
    return Wn.explained_variance(s, 0.5, 60)


@query("win_16_artifact_times", "recording t:l artifact:b",
       with_("samples") + ", q AS (SELECT channel, avg(abs(value)) AS m, greatest(stddev_pop(abs(value)), 1e-10) AS s FROM samples GROUP BY 1) "
       "SELECT recording, t, bool_or(abs((abs(value) - m) / s) > 3) AS artifact FROM samples JOIN q USING (channel) GROUP BY 1, 2")
def _(spark, sf):
    return Wn.artifact_times(ad.samples(spark, sf).withColumn("value", F.abs("value")), 3.0)


@query("win_17_robust_reference", "t:l channel:l value:8",
       with_("samples") + ", r AS (SELECT t, avg(value) AS r FROM samples GROUP BY 1), s AS (SELECT channel, stddev_pop(value - r) AS s FROM samples JOIN r USING (t) GROUP BY 1), "
       "g AS (SELECT channel FROM s WHERE s < 3 * (SELECT median(s) FROM s)), m AS (SELECT t, avg(value) AS g FROM samples JOIN g USING (channel) GROUP BY 1) "
       "SELECT t, channel, value - g AS value FROM samples JOIN m USING (t)")
def _(spark, sf):
    return Wn.robust_reference(ad.samples(spark, sf))


@query("win_18_average_reference", "t:l channel:l value:8", with_("samples") + "SELECT t, channel, value - avg(value) OVER (PARTITION BY t) AS value FROM samples")
def _(spark, sf):
    return Wn.average_reference(ad.frames(spark, sf)).select("t", F.posexplode("x").alias("channel", "value"))


@query("win_19_change_points", "win:l distance:8 change:b",
       with_("samples") + ", n AS (SELECT t, channel, value, lead(value) OVER (PARTITION BY channel ORDER BY t) AS q FROM samples), "
       "d AS (SELECT t AS win, sqrt(sum((value - q) ** 2)) AS distance FROM n WHERE q IS NOT NULL GROUP BY 1) "
       "SELECT win, distance, distance > (SELECT avg(distance) + 1.5 * stddev_pop(distance) FROM d) AS change FROM d")
def _(spark, sf):
    return Wn.change_points(ad.frames(spark, sf).withColumnRenamed("t", "win"), 1.5, block=64)


@query("win_20_transition_times", "t:l", with_("states") + "SELECT t FROM (SELECT t, state, lead(state) OVER (ORDER BY t) AS q FROM states) WHERE q <> state")
def _(spark, sf):
    return Wn.transitions(ad.states(spark, sf), block=64)


@query("win_21_centre_mixing", "win:l state:l p:8",
       with_("samples") + f", w AS (SELECT DISTINCT win FROM ({WINDOWS.format(w=50, s=20)})) SELECT win, channel AS state, value AS p FROM w JOIN samples ON t = win * 20 + 25")
def _(spark, sf):
    g = ad.samples(spark, sf).select("recording", "t", F.col("channel").alias("state"), F.col("value").alias("p"))
    return Wn.centre_mixing(Wn.slide(ad.frames(spark, sf), 50, 20), g)


@query("win_22_overlap_add", "t:l channel:l value:7",
       with_("samples") + f", w AS ({WINDOWS.format(w=100, s=50)}) SELECT t, channel, sum(h * value * (1 + win % 2)) / greatest(sum(h), 1e-10) AS value FROM "
       "(SELECT *, 0.5 * (1 - cos(2 * pi() * (t - win * 50) / 99)) AS h FROM w) GROUP BY 1, 2")
def _(spark, sf):
    w = Wn.slide(ad.samples(spark, sf), 100, 50)
    return Wn.overlap_add(w.withColumn("value", F.col("value") * (1 + F.col("win") % 2)), 100, 50)


# ---------------------------------------------------------------------- ranking


@query("top_01_hard_states", "t:l state:l", with_("samples") + "SELECT t, arg_max(channel, value) AS state FROM samples GROUP BY 1")
def _(spark, sf):
    return R.hard_states(ad.samples(spark, sf).select("recording", "t", F.col("channel").alias("state"), F.col("value").alias("p")))


@query("top_02_density_threshold", "src:l dst:l weight:1", with_("adj") + "SELECT src, dst, 1.0 AS weight FROM adj")
def _(spark, sf):
    return R.density_threshold(S.symmetrise(ad.trade(spark, sf)), 0.3)


XC = ", s AS (SELECT channel, t, value - avg(value) OVER (PARTITION BY channel) AS v FROM daily), x AS (SELECT t, v FROM s WHERE channel = 'A'), y AS (SELECT t, v FROM s WHERE channel = 'N'), " \
     "l AS (SELECT unnest(range(-20, 21)) AS lag), c AS (SELECT lag, sum(x.v * y.v) / greatest(sqrt((SELECT sum(v * v) FROM x)) * sqrt((SELECT sum(v * v) FROM y)), 1e-12) AS cc FROM x, l, y WHERE y.t = x.t + lag GROUP BY 1) "


@query("top_03_best_lag", "lag:l cc:6", with_("daily") + XC + "SELECT lag, cc FROM c ORDER BY abs(cc) DESC LIMIT 1")
def _(spark, sf):
    from ondula.operators.spectral import lagged_correlation
    d = ad.daily(spark, sf)
    return R.best_lag(lagged_correlation(d.where("channel = 'A'"), d.where("channel = 'N'"), 20), ["recording"])


@query("top_05_mode_order", "win:l mode:l rank:l",
       with_("samples") + "SELECT t AS win, channel AS mode, row_number() OVER (PARTITION BY t ORDER BY abs(value) DESC, channel) AS rank FROM samples")
def _(spark, sf):
    return R.order_modes(ad.samples(spark, sf).select(F.col("t").alias("win"), F.col("channel").alias("mode"), F.col("value").alias("freq")), ["win"])


@query("top_06_peak_in_window", "dyn:l edit:l ppm:3 magnitude:7",
       with_("fids") + "SELECT dyn, edit, arg_max(n * 0.25, m) AS ppm, max(m) AS magnitude FROM (SELECT *, sqrt(re * re + im * im) AS m FROM fids WHERE n * 0.25 BETWEEN 1.5 AND 4.5) GROUP BY 1, 2")
def _(spark, sf):
    f = ad.fids(spark, sf).select("dyn", "edit", (F.col("n") * 0.25).alias("ppm"), F.hypot("s.re", "s.im").alias("magnitude"))
    return R.peak_in(f, ["dyn", "edit"], 3.0, 1.5)


@query("top_07_window_energy_order", "component:l ratio:6",
       with_("samples") + "SELECT channel AS component, coalesce(sum(value ** 2) FILTER (t BETWEEN 70 AND 150), 0) / (sum(value ** 2) + 1e-9) AS ratio FROM samples GROUP BY 1")
def _(spark, sf):
    return R.order_by_window_energy(ad.samples(spark, sf).withColumnRenamed("channel", "component"), 70, 150)


# ------------------------------------------------------------------------- sets


@query("set_01_session_concat", "recording n:l total:6", with_("samples4") + "SELECT recording, count(*) AS n, sum(value) AS total FROM samples4 GROUP BY 1")
def _(spark, sf):
    s = ad.samples(spark, sf, split=True)
    return S.concat_sessions(*[s.where(F.col("recording") == f"r{k}") for k in range(4)]).groupBy("recording").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


FACES = "SELECT l_orderkey % 300 AS v0, l_partkey % 300 AS v1, l_suppkey % 300 AS v2 FROM lineitem"


def faces(spark, sf):
    m = lambda c: (F.col(c) % 300).alias
    return ad.table(spark, sf, "lineitem").select(F.lit("m").alias("mesh"), m("l_orderkey")("v0"), m("l_partkey")("v1"), m("l_suppkey")("v2"))


@query("set_02_face_edges", "src:l dst:l",
       f"WITH f AS ({FACES}) SELECT DISTINCT src, dst FROM (SELECT v0 AS src, v1 AS dst FROM f UNION ALL SELECT v1, v0 FROM f UNION ALL SELECT v1, v2 FROM f UNION ALL SELECT v2, v1 FROM f "
       "UNION ALL SELECT v0, v2 FROM f UNION ALL SELECT v2, v0 FROM f) WHERE src <> dst")
def _(spark, sf):
    return S.face_edges(faces(spark, sf))


@query("set_03_symmetrise", "src:l dst:l weight:9", with_("sym") + "SELECT src, dst, weight FROM sym")
def _(spark, sf):
    return S.symmetrise(ad.trade(spark, sf))


@query("set_04_fold_split", "fold:l n_test:l n_train:l",
       "WITH f AS (SELECT least(p_partkey // ((SELECT count(*) FROM part) // 7), 6) AS fold FROM part) SELECT fold, count(*) AS n_test, (SELECT count(*) FROM f) - count(*) AS n_train FROM f GROUP BY 1")
def _(spark, sf):
    f = S.fold_ids(ad.table(spark, sf, "part").select(F.col("p_partkey").alias("row")), 7)
    counts = S.value_counts(f, "fold").withColumnRenamed("n", "n_test")
    train = [S.train_rows(f, k).agg(F.lit(k).alias("fold"), F.count("*").alias("n_train")) for k in range(7)]
    out = train[0]
    for t in train[1:]:
        out = out.unionByName(t)
    return counts.join(out, "fold")


@query("set_05_common_keys", "key:l", "SELECT s_suppkey AS key FROM supplier INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def _(spark, sf):
    return S.common_keys(ad.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key")),
                         ad.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), ["key"])


@query("set_06_value_counts", "label:l n:l", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def _(spark, sf):
    return S.value_counts(ad.table(spark, sf, "embeddings"), "label")
