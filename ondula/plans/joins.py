"""Join queries."""

from pyspark.sql import functions as F

from ondula.operators import joins as J
from ondula.plans import adapters as ad
from ondula.plans.adapters import with_
from ondula.plans.aggregates import WEIGHTS, weights
from ondula.plans.registry import query


@query("joi_01_map_labels", "label_id:l map n:l total:4 only_map:l only_labels:l",
       with_("voxels", "seg") + "SELECT label_id, map, count(*) AS n, sum(value) AS total, "
       "(SELECT count(DISTINCT voxel) FROM voxels WHERE voxel NOT IN (SELECT voxel FROM seg)) AS only_map, "
       "(SELECT count(DISTINCT voxel) FROM seg WHERE voxel NOT IN (SELECT voxel FROM voxels)) AS only_labels "
       "FROM voxels JOIN seg USING (voxel) GROUP BY 1, 2")
def _(spark, sf):
    v, s = ad.voxels(spark, sf), ad.segmentation(spark, sf)
    out = J.map_with_labels(v, s, ["voxel"]).groupBy("label_id", "map").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.join(F.broadcast(J.shape_mismatch(v, s, ["voxel"])), how="inner")  # one row


@query("joi_02_label_lookup", "label_id:l n:l sigma:4",
       with_("seg") + "SELECT label_id, count(*) AS n, CASE WHEN label_id <= 20 THEN label_id / 100.0 ELSE 0 END AS sigma FROM seg GROUP BY 1")
def _(spark, sf):
    seg = ad.segmentation(spark, sf)
    dim = seg.where("label_id <= 20").select("label_id", (F.col("label_id") / 100.0).alias("sigma")).distinct()
    return J.label_lookup(seg, dim).groupBy("label_id", "sigma").agg(F.count("*").alias("n"))


@query("joi_03_label_membership", "label_id:l n:l", with_("seg") + "SELECT label_id, count(*) AS n FROM seg WHERE label_id IN (2, 41) OR label_id % 7 = 3 GROUP BY 1")
def _(spark, sf):
    seg = ad.segmentation(spark, sf)
    members = seg.where("label_id IN (2, 41) OR label_id % 7 = 3").select("label_id")
    return J.with_label_in(seg, members).groupBy("label_id").agg(F.count("*").alias("n"))


@query("joi_04_good_channels", "recording channel",
       with_("esamples") + "SELECT DISTINCT recording, channel FROM esamples e WHERE NOT EXISTS (SELECT 1 FROM esamples b WHERE b.recording = e.recording AND b.channel = e.channel AND b.value > 120)")
def _(spark, sf):
    s = ad.event_samples(spark, sf)
    return J.without(s.select("recording", "channel").distinct(), s.where("value > 120"), ["recording", "channel"])


FEATURES = ("WITH o AS (SELECT o_custkey AS subject, count(*) AS n_orders, avg(o_totalprice) AS mean_price, max(o_totalprice) AS max_price FROM orders GROUP BY 1) ")


def order_features(spark, sf):
    o = ad.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(
        F.count("*").cast("double").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("max_price"))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("n_orders", "mean_price", "max_price")])
    return o.select("subject", F.lit("orders").alias("modality"), F.inline(rows))


def account_features(spark, sf):
    return ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), F.lit("account").alias("modality"),
                                                  F.lit("balance").alias("name"), F.col("c_acctbal").alias("value"))


@query("joi_05_feature_merge", "subject:l n_orders:1 mean_price:6 max_price:4 balance:4",
       FEATURES + "SELECT c_custkey AS subject, n_orders, mean_price, max_price, c_acctbal AS balance FROM customer LEFT JOIN o ON subject = c_custkey")
def _(spark, sf):
    return J.wide_features(order_features(spark, sf), account_features(spark, sf), names=["n_orders", "mean_price", "max_price", "balance"])


SECONDS = "epoch_us(ts) / 1000000.0"


def timed(spark, sf):
    return ad.table(spark, sf, "events").select(
        F.concat(F.lit("u"), "user_id").alias("recording"), F.col("event_type").alias("channel"), "event_id", "value",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("time"))


def onsets(spark, sf):
    return timed(spark, sf).where("channel = 'purchase'").select("recording", F.col("event_id").alias("epoch"), F.col("time").alias("onset"))


EPOCH = (f"WITH s AS (SELECT 'u' || user_id AS recording, event_type AS channel, event_id, value, {SECONDS} AS time FROM events), "
         "e AS (SELECT o.event_id AS epoch, s.channel, s.event_id, s.value, s.time - o.time AS rel FROM s JOIN s o ON o.channel = 'purchase' AND o.recording = s.recording "
         "AND s.time >= o.time - 36000 AND s.time <= o.time + 36000 WHERE s.channel <> 'purchase') ")


def epoch_rows(spark, sf):
    return J.epochs(timed(spark, sf).where("channel <> 'purchase'"), onsets(spark, sf), -36000.0, 36000.0)


@query("joi_06_epochs", "epoch:l event_id:l rel:3", EPOCH + "SELECT epoch, event_id, rel FROM e")
def _(spark, sf):
    return epoch_rows(spark, sf)


@query("joi_07_evoked_window", "recording channel:l n:l first:l last:l total:6",
       with_("samples") + "SELECT recording, channel, count(*) AS n, min(t) AS first, max(t) AS last, sum(value) AS total FROM samples WHERE t >= 0 AND t < 210 GROUP BY 1, 2")
def _(spark, sf):
    return J.evoked_window(ad.samples(spark, sf), onset=10.0, dt=0.5, pre=50.0, post=95.0).groupBy("recording", "channel").agg(
        F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.sum("value").alias("total"))


KERNEL = (1.0, 0.6, 0.3, -0.1)
BOX = ("WITH ev AS (SELECT event_type AS c, event_id * 7e-1 AS onset, 2e0 + value % 3 AS dur FROM events WHERE event_type <> 'view'), n AS (SELECT CAST(max(event_id) * 0.35 AS BIGINT) AS n FROM events), "
       "g AS (SELECT c, unnest(range((SELECT n FROM n))) AS t FROM (SELECT DISTINCT c FROM ev)), "
       "b AS (SELECT DISTINCT c, unnest(range(CAST(floor(onset / 2) AS BIGINT), least(CAST(floor((onset + dur) / 2) AS BIGINT), (SELECT n FROM n)))) AS t FROM ev), "
       "x AS (SELECT g.c, g.t, CASE WHEN b.t IS NULL THEN 0.0 ELSE 1.0 END AS v FROM g LEFT JOIN b ON b.c = g.c AND b.t = g.t), "
       "k AS (SELECT * FROM (VALUES (0, 1.0), (1, 0.6), (2, 0.3), (3, -0.1)) k(lag, h)), "
       "y AS (SELECT c, t + lag AS t, sum(v * h) AS v FROM x, k WHERE t + lag < (SELECT n FROM n) GROUP BY 1, 2) ")


@query("joi_08_event_boxcar", "condition t:l value:8", BOX + "SELECT c AS condition, t, v - avg(v) OVER (PARTITION BY c) AS value FROM y")
def _(spark, sf):
    e = ad.table(spark, sf, "events")
    n = spark.createDataFrame([(e.agg(F.max("event_id")).first()[0] * 0.35,)], "v double").select(F.round("v").cast("bigint")).first()[0]
    ev = e.select((F.col("event_id") * 0.7).alias("onset"), (2.0 + F.col("value") % 3).alias("duration"),
                  F.when(F.col("event_type") == "view", "baseline").otherwise(F.col("event_type")).alias("trial_type"))
    return J.design_regressors(ev, KERNEL, n, 2.0)


@query("joi_09_nearest_event", "recording t:l distance:l",
       with_("esamples") + "SELECT recording, t, (SELECT min(abs(p.t - e.t)) FROM esamples p WHERE p.recording = e.recording AND p.channel = 'purchase') AS distance FROM esamples e WHERE channel = 'error'")
def _(spark, sf):
    s = ad.event_samples(spark, sf)
    return J.nearest_distance(s.where("channel = 'error'"), s.where("channel = 'purchase'"), ["recording"], block=512)


@query("joi_10_channel_pairs", "i:l j:l r:6",
       with_("samples") + "SELECT a.channel AS i, b.channel AS j, corr(a.value, b.value) AS r FROM samples a JOIN samples b USING (t) WHERE a.channel < b.channel GROUP BY 1, 2")
def _(spark, sf):
    from ondula.operators.aggregates import connectivity
    return connectivity(ad.frames(spark, sf)).where("i < j")


@query("joi_11_apply_weights", "t:l source:l value:8 fast:8",
       with_("samples", **WEIGHTS) + "SELECT t, i AS source, sum(v * value) AS value, sum(v * value) AS fast FROM samples JOIN w ON j = channel GROUP BY 1, 2")
def _(spark, sf):
    w = weights(spark, sf)
    dense = J.project_frames(ad.frames(spark, sf), w).select("t", F.posexplode("x").alias("source", "fast"))
    return J.apply_weights(ad.samples(spark, sf), w).join(dense, ["t", "source"])


@query("joi_12_common_region_correlation", "r:6 n:l",
       "WITH a AS (SELECT p_brand AS b, avg(p_retailprice) AS x FROM part WHERE p_size < 25 GROUP BY 1), b AS (SELECT p_brand AS b, avg(l_discount) AS y FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1) "
       "SELECT corr(x, y) AS r, count(*) AS n FROM a JOIN b USING (b) HAVING count(*) >= 5")
def _(spark, sf):
    from ondula.operators.aggregates import common_correlation
    p = ad.table(spark, sf, "part")
    a = p.where("p_size < 25").groupBy("p_brand").agg(F.avg("p_retailprice").alias("value"))
    b = p.join(ad.table(spark, sf, "lineitem"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.avg("l_discount").alias("value"))
    return common_correlation(a, b, ["p_brand"], 5)


@query("joi_13_mask_overlap", "intersection:l n_a:l n_b:l dice:6 jaccard:6",
       "WITH a AS (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE l_quantity > 45), b AS (SELECT DISTINCT l_partkey AS v FROM lineitem WHERE l_discount > 0.08), "
       "c AS (SELECT (SELECT count(*) FROM a JOIN b USING (v)) AS i, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb) "
       "SELECT i AS intersection, na AS n_a, nb AS n_b, 2 * i / (na + nb) AS dice, i / (na + nb - i) AS jaccard FROM c")
def _(spark, sf):
    li = ad.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "v")
    return J.mask_overlap(li.where("l_quantity > 45"), li.where("l_discount > 0.08"), ["v"])


@query("joi_14_component_match", "a:l b:l score:6")
def _(spark, sf):
    e = ad.table(spark, sf, "embeddings").select("label", "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    half = lambda k: e.where(F.col("vec_id") % 2 == k).groupBy("i", F.col("label").alias("j")).agg(F.avg("v").alias("v"))
    return spark.createDataFrame(J.match_components(half(0), half(1)), "a int, b int, score double")


@query("joi_15_paired_correction", "acq edit:l dyn:l n:l re:7 im:7",
       with_("fids") + ", c AS (SELECT acq, dyn, re AS df, im AS dp FROM fids WHERE edit = 0 AND n = 0), x AS (SELECT acq, edit, dyn, n, re, im, 2 * pi() * df * n * 0.001 + dp AS p FROM fids JOIN c USING (acq, dyn)) "
       "SELECT acq, edit, dyn, n, re * cos(p) - im * sin(p) AS re, re * sin(p) + im * cos(p) AS im FROM x")
def _(spark, sf):
    f = ad.fids(spark, sf)
    shifts = f.where("edit = 0 AND n = 0").select("acq", "dyn", F.col("s.re").alias("df"), F.col("s.im").alias("dp"))
    return J.correct_pairs(f, shifts, ["acq"], 0.001).select("acq", "edit", "dyn", "n", "s.re", "s.im")


@query("joi_16_region_overlap", "hemi region:l intersection:l n_a:l n_b:l dice:6",
       "WITH a AS (SELECT DISTINCT l_returnflag AS hemi, p_size % 5 AS region, l_partkey AS v FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 30), "
       "b AS (SELECT DISTINCT l_returnflag AS hemi, p_size % 5 AS region, l_partkey AS v FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount > 0.05), "
       "j AS (SELECT coalesce(a.hemi, b.hemi) AS hemi, coalesce(a.region, b.region) AS region, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) AS i, count(a.v) AS na, count(b.v) AS nb "
       "FROM a FULL JOIN b ON a.hemi = b.hemi AND a.region = b.region AND a.v = b.v GROUP BY 1, 2) SELECT hemi, region, i AS intersection, na AS n_a, nb AS n_b, 2 * i / (na + nb + 1e-10) AS dice FROM j")
def _(spark, sf):
    li = ad.table(spark, sf, "lineitem").join(ad.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_returnflag").alias("hemi"), F.col("p_size").alias("label_id"), F.col("l_partkey").alias("v"), "l_quantity", "l_discount")
    groups = li.select("hemi", "label_id").distinct().withColumn("region", F.col("label_id") % 5)
    return J.region_overlap(li.where("l_quantity > 30"), groups, li.where("l_discount > 0.05").withColumn("region", F.col("label_id") % 5), ["v"])
