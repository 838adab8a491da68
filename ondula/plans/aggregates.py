"""Aggregation queries."""

from pyspark.sql import functions as F

from ondula.operators import aggregates as A
from ondula.operators import graph as G
from ondula.operators import windows as Wn
from ondula.plans import adapters as ad
from ondula.plans.adapters import with_
from ondula.plans.registry import query

CORR = ("SELECT recording, a.channel AS i, b.channel AS j, corr(a.value, b.value) AS r FROM {s} a JOIN {s} b "
        "USING (recording, t) WHERE a.channel < b.channel GROUP BY 1, 2, 3")


@query("agg_01_functional_connectivity", "recording i:l j:l r:6", with_("samples4") + CORR.format(s="samples4"))
def _(spark, sf):
    return A.connectivity(ad.frames(spark, sf, split=True)).where("i < j")


@query("agg_02_static_connectivity", "i:l j:l r:6", with_("samples") + f"SELECT i, j, r FROM ({CORR.format(s='samples')})")
def _(spark, sf):
    f = ad.frames(spark, sf, split=True)
    return A.static_connectivity([f.where(F.col("recording") == r) for r in ("r0", "r1", "r2", "r3")]).where("i < j")


@query("agg_03_static_summary", "recording i:l mean:6 std:6 mean_abs_r:6",
       with_("samples4") + f", c AS ({CORR.format(s='samples4')}), "
       "bi AS (SELECT recording, i, r FROM c UNION ALL SELECT recording, j, r FROM c) "
       "SELECT s.recording, channel AS i, mean, std, m AS mean_abs_r FROM "
       "(SELECT recording, channel, avg(value) AS mean, stddev_pop(value) AS std FROM samples4 GROUP BY 1, 2) s JOIN "
       "(SELECT recording, i, avg(abs(r)) AS m FROM bi GROUP BY 1, 2) b ON b.recording = s.recording AND b.i = s.channel")
def _(spark, sf):
    return A.channel_summary(ad.frames(spark, sf, split=True))


@query("agg_04_matrix_correlation", "r:6",
       with_("samples4") + f", c AS ({CORR.format(s='samples4')}) SELECT corr(a.r, b.r) AS r FROM c a JOIN c b "
       "ON a.i = b.i AND a.j = b.j WHERE a.recording = 'r0' AND b.recording = 'r1'")
def _(spark, sf):
    r = A.connectivity(ad.frames(spark, sf, split=True))
    return A.matrix_correlation(r.where("recording = 'r0'"), r.where("recording = 'r1'"))


LABELLED = with_("voxels", "seg") + (
    ", v AS (SELECT s.name, s.label_id, s.tissue, map, subject, value FROM voxels JOIN seg s USING (voxel) "
    "WHERE map = 'price' AND value <> 0 AND value BETWEEN 1000 AND 60000) ")


def _labelled(spark, sf):
    v = A.valid_values(ad.voxels(spark, sf).where("map = 'price'"), low=1000, high=60000)
    return v.join(ad.segmentation(spark, sf), "voxel")


@query("agg_05_region_statistics", "name mean:4 median:4 std:4 p5:4 p95:4 n:l",
       LABELLED + "SELECT name, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std, "
       "quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95, count(*) AS n FROM v GROUP BY name "
       "HAVING count(*) >= 5")
def _(spark, sf):
    return A.region_stats(_labelled(spark, sf), ["name"])


@query("agg_06_tissue_statistics", "tissue mean:4 median:4 std:4 n:l",
       LABELLED + "SELECT t.tissue, CASE WHEN n >= 10 THEN mean END AS mean, CASE WHEN n >= 10 THEN median END AS median, "
       "CASE WHEN n >= 10 THEN std END AS std, CASE WHEN n >= 10 THEN n ELSE 0 END AS n FROM (SELECT DISTINCT tissue FROM seg) t "
       "LEFT JOIN (SELECT tissue, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std, count(*) AS n "
       "FROM v GROUP BY 1) s USING (tissue)")
def _(spark, sf):
    return A.tissue_stats(_labelled(spark, sf), ad.segmentation(spark, sf), ["tissue"])


@query("agg_07_tool_comparison", "tissue price_mean:4 price_n:l quantity_mean:4 quantity_n:l discount_mean:6 discount_n:l",
       with_("voxels", "seg") + ", s AS (SELECT tissue, map, avg(value) AS mean, count(*) AS n FROM voxels JOIN seg USING (voxel) "
       "WHERE value <> 0 GROUP BY 1, 2 HAVING count(*) >= 10) SELECT tissue, " + ", ".join(
           f"max(CASE WHEN map = '{m}' THEN mean END) AS {m}_mean, max(CASE WHEN map = '{m}' THEN n END) AS {m}_n"
           for m in ("price", "quantity", "discount")) + " FROM s GROUP BY 1")
def _(spark, sf):
    v = A.valid_values(ad.voxels(spark, sf)).join(ad.segmentation(spark, sf), "voxel")
    dim = v.select("tissue", "map")
    return A.tool_comparison(A.tissue_stats(v, dim, ["tissue", "map"]), "tissue", "map", ["price", "quantity", "discount"])


@query("agg_08_segmentation_summary", "label_id:l voxels:l volume_mm3:4 name sigma:4",
       with_("seg") + "SELECT label_id, count(*) AS voxels, count(*) * 1.0 AS volume_mm3, "
       "CASE WHEN label_id <= 20 THEN 'Brand#' || label_id ELSE 'label_' || label_id END AS name, "
       "CASE WHEN label_id <= 20 THEN label_id / 100.0 ELSE 0 END AS sigma FROM seg GROUP BY label_id")
def _(spark, sf):
    seg = ad.segmentation(spark, sf)
    dim = seg.where("label_id <= 20").select("label_id", "name", (F.col("label_id") / 100.0).alias("sigma")).distinct()
    return A.segmentation_summary(seg, dim)


@query("agg_09_surface_region_means", "label_id:l mean:4 std:4 n:l",
       with_("voxels", "seg") + "SELECT label_id, avg(value) FILTER (value <> 0) AS mean, stddev_pop(value) FILTER (value <> 0) AS std, "
       "count(*) FILTER (value <> 0) AS n FROM voxels JOIN seg USING (voxel) WHERE map = 'discount' AND label_id <> 0 GROUP BY 1 "
       "HAVING count(*) > 10 AND count(*) FILTER (value <> 0) > 5")
def _(spark, sf):
    v = ad.voxels(spark, sf).where("map = 'discount'").join(ad.segmentation(spark, sf), "voxel")
    return A.surface_means(v, "label_id", "value")


@query("agg_10_tissue_snr", "tissue snr:2",
       with_("voxels", "seg") + "SELECT tissue, round(avg(value) / greatest(stddev_pop(value), 1e-10), 2) AS snr FROM voxels "
       "JOIN seg USING (voxel) WHERE map = 'price' GROUP BY 1")
def _(spark, sf):
    return A.tissue_snr(ad.voxels(spark, sf).where("map = 'price'").join(ad.segmentation(spark, sf), "voxel"), ["tissue"])


@query("agg_11_euler_number", "mesh euler:l",
       "SELECT c_mktsegment AS mesh, count(DISTINCT c_custkey) - (3 * count(o_orderkey)) // 2 + count(o_orderkey) AS euler "
       "FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, sf):
    c = ad.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("mesh"), "c_custkey")
    o = ad.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return A.euler_number(c, o.join(c, "c_custkey"), "mesh")


@query("agg_12_sample_covariance", "recording i:l j:l cov:8",
       with_("samples4") + "SELECT recording, a.channel AS i, b.channel AS j, covar_samp(a.value, b.value) AS cov "
       "FROM samples4 a JOIN samples4 b USING (recording, t) WHERE a.channel <= b.channel GROUP BY 1, 2, 3")
def _(spark, sf):
    return A.sample_covariance(ad.frames(spark, sf, split=True)).where("i <= j")


@query("agg_13_second_moment_template", "i:l j:l v:8",
       with_("samples4") + "SELECT i, j, avg(m) AS v FROM (SELECT recording, a.channel AS i, b.channel AS j, "
       "sum(a.value * b.value) / count(*) AS m FROM samples4 a JOIN samples4 b USING (recording, t) "
       "WHERE a.channel <= b.channel GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _(spark, sf):
    return A.second_moment_template(ad.frames(spark, sf, split=True)).where("i <= j")


MI = with_("samples") + """, r AS (SELECT channel, min(value) AS lo, max(value) AS hi FROM samples GROUP BY 1),
b AS (SELECT t, channel, least(floor((value - lo) / (hi - lo) * 16), 15) AS k FROM samples JOIN r USING (channel)),
h AS (SELECT a.channel AS i, b.channel AS j, a.k AS ka, b.k AS kb, count(*) AS n FROM b a JOIN b ON a.t = b.t AND a.channel <= b.channel
GROUP BY 1, 2, 3, 4),
p AS (SELECT i, j, n, sum(n) OVER (PARTITION BY i, j) AS tot, sum(n) OVER (PARTITION BY i, j, ka) AS na,
sum(n) OVER (PARTITION BY i, j, kb) AS nb FROM h)
SELECT i, j, sum(n / tot * ln(n * tot / (na * nb))) AS mi FROM p {w} GROUP BY 1, 2"""


@query("agg_14_mutual_information", "i:l j:l mi:6", MI.format(w="WHERE i = 0 AND j > 0"))
def _(spark, sf):
    return A.mutual_information(ad.frames(spark, sf)).where("i = 0 AND j > 0")


@query("agg_15_mutual_information_matrix", "i:l j:l mi:6", MI.format(w=""))
def _(spark, sf):
    return A.mutual_information(ad.frames(spark, sf)).where("i <= j")


@query("agg_16_labeling_nmi", "nmi:6",
       "WITH c AS (SELECT label AS a, vec_id % 10 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), "
       "p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY a) / sum(n) OVER () AS pa, "
       "sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb FROM c) "
       "SELECT 2 * sum(p * ln(p / (pa * pb))) / (-sum(p * ln(pa)) - sum(p * ln(pb))) AS nmi FROM p")
def _(spark, sf):
    return A.labeling_nmi(ad.states(spark, sf).withColumn("other", F.col("t") % 10), "state", "other")


@query("agg_17_fractional_occupancy", "recording state:l occupancy:6 soft:6",
       "WITH k AS (SELECT unnest(range(64)) AS state) SELECT 'all' AS recording, state, "
       "(SELECT count(*) FROM embeddings WHERE label = state) / (SELECT count(*) FROM embeddings) AS occupancy, "
       "(SELECT avg(abs(embedding[state + 1])) FROM embeddings) AS soft FROM k")
def _(spark, sf):
    hard = A.occupancy(ad.states(spark, sf), "recording", "state", 64)
    gamma = ad.samples(spark, sf).select(
        "recording", F.col("channel").alias("state"), F.abs(F.col("value").cast("float")).cast("double").alias("p"))
    return hard.join(A.soft_occupancy(gamma, ["recording", "state"]).withColumnRenamed("occupancy", "soft"),
                     ["recording", "state"], "left")


@query("agg_18_switching_rate", "recording switching_rate:6",
       "SELECT 'all' AS recording, avg(CAST(label <> p AS INTEGER)) * 250 AS switching_rate FROM "
       "(SELECT label, lag(label) OVER (ORDER BY vec_id) AS p FROM embeddings) WHERE p IS NOT NULL")
def _(spark, sf):
    return A.switching_rate(ad.states(spark, sf), fs=250.0, block=128)


@query("agg_19_global_field_power", "recording mean_gfp:8 max_gfp:8",
       with_("samples4") + "SELECT recording, avg(g) AS mean_gfp, max(g) AS max_gfp FROM (SELECT recording, t, stddev_pop(value) AS g "
       "FROM samples4 GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    return A.field_power(ad.frames(spark, sf, split=True)).groupBy("recording").agg(
        F.avg("gfp").alias("mean_gfp"), F.max("gfp").alias("max_gfp"))


def _evoked(spark, sf, parity):
    """Mean response per channel over ten relative times, of even or odd trials."""
    s = ad.samples(spark, sf).where(F.floor(F.col("t") / 10) % 2 == parity)
    return s.groupBy("channel", (F.col("t") % 10).alias("t")).agg(F.avg("value").alias("value"))


@query("agg_20_evoked_loss", "waveform:9 field_power:9 loss:9",
       with_("samples") + ", e AS (SELECT channel, t % 10 AS t, avg(value) FILTER (t // 10 % 2 = 0) AS a, "
       "avg(value) FILTER (t // 10 % 2 = 1) AS b FROM samples GROUP BY 1, 2), "
       "w AS (SELECT avg((a - b) ** 2) AS w FROM e), g AS (SELECT avg((ga - gb) ** 2) AS g FROM "
       "(SELECT stddev_pop(a) AS ga, stddev_pop(b) AS gb FROM e GROUP BY t)) "
       "SELECT w AS waveform, g AS field_power, w + 0.5 * g AS loss FROM w, g")
def _(spark, sf):
    return A.evoked_loss(_evoked(spark, sf, 0), _evoked(spark, sf, 1))


def weights(spark, sf):
    """Mean frame per label as a 10 x 64 weight matrix."""
    e = ad.table(spark, sf, "embeddings").select(F.col("label").alias("i"), F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "v"))
    return e.groupBy("i", "j").agg(F.avg("v").alias("v"))


WEIGHTS = {"ex": "SELECT label, unnest(range(64)) AS j, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings",
           "w": "SELECT label AS i, j, avg(v) AS v FROM ex GROUP BY 1, 2"}
COV = "SELECT a.channel AS i, b.channel AS j, covar_pop(a.value, b.value) AS v FROM samples a JOIN samples b USING (t) GROUP BY 1, 2"


def cov(spark, sf, cond="true"):
    return A.gram(ad.frames(spark, sf).where(cond)).select("i", "j", F.col("cov").alias("v"))


@query("agg_21_sensor_loss", "loss:9",
       with_("samples", **WEIGHTS) + ", p AS (SELECT t, i, sum(v * value) AS s FROM samples JOIN w ON j = channel GROUP BY 1, 2) "
       "SELECT avg((s - value) ** 2) AS loss FROM p JOIN samples s USING (t) WHERE s.channel = p.i")
def _(spark, sf):
    from ondula.operators.joins import apply_weights
    s = ad.samples(spark, sf)
    p = apply_weights(s, weights(spark, sf)).withColumnRenamed("source", "channel")
    return A.waveform_loss(p, s, ["recording", "t", "channel"])


@query("agg_22_two_sample_ks", "ks:6",
       with_("esamples") + ", u AS (SELECT value, CAST(channel = 'click' AS INTEGER) AS a, CAST(channel = 'view' AS INTEGER) AS b "
       "FROM esamples WHERE channel IN ('click', 'view')), c AS (SELECT value, sum(sum(a)) OVER (ORDER BY value) AS ca, "
       "sum(sum(b)) OVER (ORDER BY value) AS cb FROM u GROUP BY value) "
       "SELECT max(abs(ca / (SELECT sum(a) FROM u) - cb / (SELECT sum(b) FROM u))) AS ks FROM c")
def _(spark, sf):
    e = ad.event_samples(spark, sf)
    return A.ks_statistic(e.where("channel = 'click'"), e.where("channel = 'view'"), "value")


@query("agg_23_permutation_p", "channel observed:6 p:6",
       with_("esamples") + "SELECT channel, any_value(o) AS observed, avg(CAST(value >= o AS DOUBLE)) AS p FROM "
       "(SELECT *, avg(value) OVER (PARTITION BY channel) AS o FROM esamples) GROUP BY 1")
def _(spark, sf):
    e = ad.event_samples(spark, sf)
    return A.permutation_p(e, e.groupBy("channel").agg(F.avg("value").alias("value")), ["channel"])


@query("agg_24_run_summary", "optimizer mean_fitness:4 std_fitness:4 max_fitness:4 mean_time:6 mean_evals:4 n:l",
       "SELECT o_orderpriority AS optimizer, avg(o_totalprice) AS mean_fitness, stddev_pop(o_totalprice) AS std_fitness, "
       "max(o_totalprice) AS max_fitness, avg(o_totalprice / 1000) AS mean_time, avg(o_custkey) AS mean_evals, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    o = ad.table(spark, sf, "orders")
    return A.run_summary(o.select(F.col("o_orderpriority").alias("optimizer"), F.col("o_totalprice").alias("fitness"),
                                  (F.col("o_totalprice") / 1000).alias("wall_time"), F.col("o_custkey").alias("evals")))


@query("agg_25_edit_averages", "acq n:l on_re:8 off_im:8 diff_re:8 diff_im:8 sum_re:8 sum_im:8 n_used:l",
       with_("fids") + ", m AS (SELECT acq, n, " + ", ".join(
           f"avg({p}) FILTER (edit = {e}) AS {c}_{p}" for p in ("re", "im") for c, e in (("on", 1), ("off", 0))) +
       ", least(count(DISTINCT dyn) FILTER (edit = 1), count(DISTINCT dyn) FILTER (edit = 0)) AS n_used FROM fids GROUP BY 1, 2) "
       "SELECT acq, n, on_re, off_im, on_re - off_re AS diff_re, on_im - off_im AS diff_im, on_re + off_re AS sum_re, "
       "on_im + off_im AS sum_im, n_used FROM m")
def _(spark, sf):
    return A.average_edits(ad.fids(spark, sf))


@query("agg_26_transient_outliers", "acq edit:l dyn:l residual:8 z:5 rejected:b",
       with_("fids") + ", m AS (SELECT acq, edit, n, avg(re) AS mr, avg(im) AS mi FROM fids GROUP BY 1, 2, 3), "
       "r AS (SELECT acq, edit, dyn, sqrt(avg((re - mr) ** 2 + (im - mi) ** 2)) AS residual FROM fids JOIN m USING (acq, edit, n) GROUP BY 1, 2, 3), "
       "q AS (SELECT acq, edit, median(residual) AS med FROM r GROUP BY 1, 2), "
       "d AS (SELECT acq, edit, med, median(abs(residual - med)) AS mad FROM r JOIN q USING (acq, edit) GROUP BY 1, 2, 3) "
       "SELECT acq, edit, dyn, residual, 0.6745 * (residual - med) / (mad + 1e-10) AS z, "
       "abs(0.6745 * (residual - med) / (mad + 1e-10)) > 3 AS rejected FROM r JOIN d USING (acq, edit)")
def _(spark, sf):
    return A.transient_outliers(ad.fids(spark, sf))


@query("agg_27_variance_outliers", "recording channel:l variance:8",
       with_("samples4") + ", v AS (SELECT recording, channel, var_pop(value) AS variance FROM samples4 GROUP BY 1, 2), "
       "q AS (SELECT recording, median(variance) AS med, mad(variance) AS m FROM v GROUP BY 1) "
       "SELECT recording, channel, variance FROM v JOIN q USING (recording) WHERE variance > med + 1.0 * 1.4826 * m")
def _(spark, sf):
    return A.variance_outliers(ad.samples(spark, sf, split=True), k=1.0)


STDS = with_("esamples") + (
    ", s AS (SELECT recording, channel, stddev_pop(value) AS std FROM esamples GROUP BY 1, 2), "
    "q AS (SELECT recording, avg(std) AS std_mean, stddev_pop(std) AS std_std, median(std) AS med, mad(std) AS m FROM s GROUP BY 1), "
    "f AS (SELECT recording, channel, std_mean, std_std, std > std_mean + 1.5 * std_std AS noisy, "
    "std < greatest(med - 1.5 * greatest(m, 0.01 * med), 0) AS flat FROM s JOIN q USING (recording)), "
    "sq AS (SELECT recording, any_value(std_mean) AS std_mean, any_value(std_std) AS std_std, "
    "coalesce(string_agg(channel, ',' ORDER BY channel) FILTER (noisy), '') AS noisy, "
    "coalesce(string_agg(channel, ',' ORDER BY channel) FILTER (flat), '') AS flat, "
    "count(*) FILTER (noisy) AS n_noisy, count(*) FILTER (flat) AS n_flat FROM f GROUP BY 1) ")


@query("agg_28_noisy_flat_channels", "recording std_mean:6 std_std:6 noisy flat n_noisy:l n_flat:l", STDS + "SELECT * FROM sq")
def _(spark, sf):
    return A.std_quality(A.channel_std(ad.event_samples(spark, sf)), k=1.5).withColumn(
        "noisy", F.array_join("noisy_channels", ",")).withColumn("flat", F.array_join("flat_channels", ","))


def _spectra(spark, sf):
    """Squared embedding entries as power on a 2 Hz grid."""
    return ad.samples(spark, sf, split=True).select(
        "recording", F.col("t").alias("channel"), (F.col("channel") * 2.0).alias("freq"), (F.col("value") ** 2).alias("power"))


LINE = ("SELECT recording, CASE WHEN greatest(s50, s60) <= 0 THEN 0.0 WHEN s50 >= s60 THEN 50.0 ELSE 60.0 END AS line_freq, "
        "greatest(s50, s60) AS line_power, greatest(s50, s60) > 0.05 AS has_line_noise FROM (SELECT recording, "
        "sum(p) FILTER (f BETWEEN 49 AND 51) / sum(p) AS s50, sum(p) FILTER (f BETWEEN 59 AND 61) / sum(p) AS s60 "
        "FROM (SELECT recording, channel * 2.0 AS f, avg(value ** 2) AS p FROM samples4 GROUP BY 1, 2) GROUP BY 1)")


@query("agg_29_line_noise_share", "recording line_freq:1 line_power:8 has_line_noise:b", with_("samples4") + LINE)
def _(spark, sf):
    return A.line_noise(_spectra(spark, sf), "recording")


def _durations(spark, sf):
    """Seconds per user: one event index is one second."""
    return ad.event_samples(spark, sf).groupBy("recording").agg(F.max("t").cast("double").alias("total"))


def _annotations(spark, sf):
    return ad.event_samples(spark, sf).select("recording", F.when(F.col("channel") == "error", "BAD_muscle high").otherwise(
        F.col("channel")).alias("description"), F.col("value").alias("duration"))


MUSCLE = ("SELECT recording, coalesce(sum(value) FILTER (channel = 'error'), 0) / max(t) AS muscle_fraction FROM esamples GROUP BY 1")


@query("agg_30_artifact_share", "recording muscle_fraction:8", with_("esamples") + MUSCLE)
def _(spark, sf):
    return A.artifact_share(_annotations(spark, sf), _durations(spark, sf), "recording")


@query("agg_31_quality_index", "n_noisy:l n_flat:l has_line_noise:b heart_rate:4 muscle_fraction:4 quality:6",
       "SELECT *, (1.0 - least(n_noisy + n_flat, 30) / 30.0 + CASE WHEN has_line_noise THEN 0 ELSE 1 END + "
       "CASE WHEN heart_rate > 50 AND heart_rate < 100 THEN 1.0 ELSE 0.5 END + greatest(0, 1.0 - muscle_fraction * 5)) / 4 AS quality FROM "
       "(SELECT p_size % 7 AS n_noisy, p_size % 31 AS n_flat, p_size % 2 = 0 AS has_line_noise, p_retailprice / 12 AS heart_rate, "
       "p_size / 200.0 AS muscle_fraction FROM part)")
def _(spark, sf):
    p = ad.table(spark, sf, "part").select(
        (F.col("p_size") % 7).alias("n_noisy"), (F.col("p_size") % 31).alias("n_flat"), (F.col("p_size") % 2 == 0).alias("has_line_noise"),
        (F.col("p_retailprice") / 12).alias("heart_rate"), (F.col("p_size") / 200.0).alias("muscle_fraction"))
    return p.withColumn("quality", A.quality_index())


RATE = ("SELECT recording, count(*) FILTER (channel = 'click') AS n_events, "
        "count(*) FILTER (channel = 'click') / (max(t) / 60.0) AS rate_per_min FROM esamples GROUP BY 1")


@query("agg_32_quality_report", "recording n_noisy:l n_flat:l line_power:8 heart_rate:8 muscle_fraction:8 quality:6",
       STDS + f", rate AS ({RATE}), mus AS ({MUSCLE}), l AS (SELECT 'u' || (vec_id % 150) AS recording, "
       "sum(e[26]**2) / sum(list_sum(list_transform(e, lambda v: v*v))) AS s50, sum(e[31]**2) / sum(list_sum(list_transform(e, lambda v: v*v))) AS s60 "
       "FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) GROUP BY 1) "
       "SELECT recording, n_noisy, n_flat, greatest(s50, s60) AS line_power, rate_per_min AS heart_rate, muscle_fraction, "
       "(1.0 - least(n_noisy + n_flat, 30) / 30.0 + CASE WHEN greatest(s50, s60) > 0.05 THEN 0 ELSE 1 END + "
       "CASE WHEN rate_per_min > 50 AND rate_per_min < 100 THEN 1.0 ELSE 0.5 END + greatest(0, 1.0 - muscle_fraction * 5)) / 4 AS quality "
       "FROM sq JOIN rate USING (recording) JOIN mus USING (recording) LEFT JOIN l USING (recording)")
def _(spark, sf):
    e, dur = ad.event_samples(spark, sf), _durations(spark, sf)
    spec = ad.samples(spark, sf).select(F.concat(F.lit("u"), F.col("t") % 150).alias("recording"), F.col("t").alias("channel"),
                                        (F.col("channel") * 2.0).alias("freq"), (F.col("value") ** 2).alias("power"))
    heart = A.event_rate(e.where("channel = 'click'"), dur, "recording")
    muscle = A.artifact_share(_annotations(spark, sf), dur, "recording")
    stds = A.channel_std(e)
    out = A.std_quality(stds, k=1.5).join(A.line_noise(spec, "recording"), "recording", "left").join(
        heart.select("recording", F.col("rate_per_min").alias("heart_rate")), "recording", "left").join(muscle, "recording", "left")
    return out.fillna({"has_line_noise": False, "muscle_fraction": 0.0, "heart_rate": 0.0}).withColumn("quality", A.quality_index())


@query("agg_33_event_rates", "recording n_events:l rate_per_min:8", with_("esamples") + RATE)
def _(spark, sf):
    return A.event_rate(ad.event_samples(spark, sf).where("channel = 'click'"), _durations(spark, sf), "recording")


@query("agg_34_recovery_metrics", "correlation:6 snr_db:6 rmse:8 amplitude_ratio:6 distortion:6",
       with_("interleaved") + ", p AS (SELECT recording, channel, t, value AS inj, 0.9 * value + 0.01 * sin(t) AS rec FROM interleaved), "
       "c AS (SELECT avg(r) AS r FROM (SELECT corr(inj, rec) AS r FROM p GROUP BY recording, channel)), "
       "g AS (SELECT avg(inj ** 2) AS pi, avg(rec ** 2) AS pr, avg((rec - inj) ** 2) AS pn FROM p) "
       "SELECT r AS correlation, 10 * log10(pi / pn) AS snr_db, sqrt(pn) AS rmse, sqrt(pr / pi) AS amplitude_ratio, 1 - r AS distortion FROM c, g")
def _(spark, sf):
    s = ad.interleaved(spark, sf)
    clean = s.withColumn("value", 1.9 * F.col("value") + 0.01 * F.sin("t"))
    return A.recovery(clean, s, s)


@query("agg_35_band_power", "recording band power:8",
       with_("samples4") + ", psd AS (SELECT recording, channel * 2.0 AS f, avg(value ** 2) AS p FROM samples4 GROUP BY 1, 2), "
       "b AS (SELECT * FROM (VALUES ('delta', 1.0, 4.0), ('theta', 4.0, 8.0), ('alpha', 8.0, 13.0), ('beta', 13.0, 30.0), ('gamma', 30.0, 100.0)) v(band, lo, hi)), "
       "l AS (SELECT recording, band, f, p, lag(p) OVER w AS pp, lag(f) OVER w AS pf FROM psd JOIN b ON f BETWEEN lo AND hi "
       "WINDOW w AS (PARTITION BY recording, band ORDER BY f)) SELECT recording, band, coalesce(sum((p + pp) / 2 * (f - pf)), 0) AS power FROM l GROUP BY 1, 2")
def _(spark, sf):
    bands = spark.createDataFrame([("delta", 1.0, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0),
                                   ("gamma", 30.0, 100.0)], "band string, fmin double, fmax double")
    return A.band_power(_spectra(spark, sf), bands, ["recording"])


@query("agg_36_weighted_median", "l_returnflag weighted_median:4",
       "WITH c AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), "
       "k AS (SELECT l_returnflag, v, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS cw, sum(w) OVER (PARTITION BY l_returnflag) AS tw FROM c) "
       "SELECT l_returnflag, min(v) FILTER (cw >= tw / 2) AS weighted_median FROM k GROUP BY 1")
def _(spark, sf):
    return A.weighted_median(ad.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")


GAPPED = ("SELECT 'sales' AS key, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS t, round(sum(l_extendedprice), 2) AS value "
          "FROM lineitem WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5 GROUP BY 2")


@query("agg_37_block_average", "frame:l value:3 blocks:l",
       f"WITH s AS ({GAPPED}), d AS (SELECT *, t - lag(t) OVER (ORDER BY t) AS d FROM s), "
       "m AS (SELECT *, sum(CASE WHEN d > 1.5 * (SELECT median(d) FROM d) THEN 1 ELSE 0 END) OVER (ORDER BY t) AS b FROM d), "
       "f AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY t) - 1 AS frame, count(*) OVER (PARTITION BY b) AS len FROM m) "
       "SELECT frame, avg(value) AS value, count(*) AS blocks FROM f WHERE len = (SELECT count(*) FROM m WHERE b = 0) GROUP BY 1")
def _(spark, sf):
    li = ad.table(spark, sf, "lineitem").where(F.dayofweek("l_shipdate").between(2, 6))
    s = li.groupBy(F.lit("sales").alias("key"), F.datediff("l_shipdate", F.lit(ad.DAY0)).cast("bigint").alias("t")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("value"))
    return A.block_average(s, "key", block=256)


@query("agg_38_connectome_features",
       "graph mean_strength:6 strength_std:6 density:6 clustering_coeff:6 clustering_std:6 asymmetry:6 max_strength:6 strength_entropy:6",
       with_("trade", "nodes") + ", b AS (SELECT src, dst FROM trade WHERE weight > (SELECT median(weight) FROM trade WHERE weight > 0)), "
       "k AS (SELECT src, count(*) AS k FROM b GROUP BY 1), tri AS (SELECT x.src, count(*) AS n FROM b x JOIN b y ON x.src = y.src AND x.dst < y.dst "
       "JOIN b z ON (z.src = x.dst AND z.dst = y.dst) OR (z.src = y.dst AND z.dst = x.dst) GROUP BY 1), "
       "cc AS (SELECT node, CASE WHEN k >= 2 THEN coalesce(n, 0) / (k * (k - 1)) ELSE 0 END AS c FROM nodes LEFT JOIN k ON k.src = node LEFT JOIN tri ON tri.src = node), "
       "s AS (SELECT node, coalesce(sum(weight), 0) AS s FROM nodes LEFT JOIN trade ON src = node GROUP BY 1), "
       "p AS (SELECT s, s / ((SELECT sum(s) FROM s) + 1e-10) AS p FROM s), "
       "a AS (SELECT sum(abs(d)) AS a FROM (SELECT sum(w) AS d FROM (SELECT src, dst, weight AS w FROM trade UNION ALL SELECT dst, src, -weight FROM trade) GROUP BY src, dst)) "
       "SELECT 'trade' AS graph, avg(s) AS mean_strength, stddev_pop(s) AS strength_std, (SELECT count(*) FROM trade WHERE weight > 0) / (25 * 24) AS density, "
       "(SELECT avg(c) FROM cc) AS clustering_coeff, (SELECT stddev_pop(c) FROM cc) AS clustering_std, (SELECT a FROM a) / (25 * 25) AS asymmetry, "
       "max(s) AS max_strength, -sum(CASE WHEN p > 0 THEN p * ln(p) END) AS strength_entropy FROM p")
def _(spark, sf):
    e, n = ad.trade(spark, sf), ad.trade_nodes(spark, sf)
    return A.connectome_features(e, n, G.clustering(G.above_median(e), n))


@query("agg_39_dynamics_features", "recording fo_state0:6 fo_state9:6 lifetime_state0:6 lifetime_state9:6 switching_rate:6",
       with_("states") + ", g AS (SELECT *, lag(state) OVER (ORDER BY t) AS p FROM states), "
       "i AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> state THEN 1 ELSE 0 END) OVER (ORDER BY t) AS run FROM g), "
       "r AS (SELECT state, count(*) AS len FROM i GROUP BY run, state) "
       "SELECT 'all' AS recording, " + ", ".join(
           f"(SELECT avg(CAST(state = {k} AS DOUBLE)) FROM states) AS fo_state{k}, (SELECT avg(len) / 250 FROM r WHERE state = {k}) AS lifetime_state{k}" for k in (0, 9)) +
       ", (SELECT avg(CAST(state <> p AS DOUBLE)) * 250 FROM g WHERE p IS NOT NULL) AS switching_rate")
def _(spark, sf):
    s = ad.states(spark, sf)
    return A.dynamics_features(A.occupancy(s, "recording", "state", 10), Wn.mean_lifetime(s, 10, fs=250.0, block=128),
                               A.switching_rate(s, fs=250.0, block=128), 10)


@query("agg_40_condition_contrast", "recording contrast:6",
       with_("esamples") + "SELECT recording, avg(value) FILTER (channel = 'click') - avg(value) FILTER (channel = 'view') AS contrast FROM esamples GROUP BY 1")
def _(spark, sf):
    return A.contrast(ad.event_samples(spark, sf), ["recording"], "channel", "click", "view")


@query("agg_41_circular_statistics", "channel circular_mean:6 circular_variance:6 rayleigh_z:5",
       with_("esamples") + ", m AS (SELECT channel, avg(cos(value)) AS c, avg(sin(value)) AS s, count(*) AS n FROM esamples GROUP BY 1) "
       "SELECT channel, atan2(s, c) AS circular_mean, 1 - sqrt(c * c + s * s) AS circular_variance, n * (c * c + s * s) AS rayleigh_z FROM m")
def _(spark, sf):
    return A.circular_stats(ad.event_samples(spark, sf), ["channel"], "value")


@query("agg_42_normal_loglik", "channel:l loglik:4",
       with_("samples") + "SELECT channel, -0.5 * count(*) * ln(2 * pi() * var_pop(value)) - sum(value ** 2) / (2 * var_pop(value)) AS loglik FROM samples GROUP BY 1")
def _(spark, sf):
    return A.normal_loglik(ad.samples(spark, sf), ["channel"])


def gain(spark, sf):
    """The transposed class means as a 64 x 10 gain matrix."""
    return weights(spark, sf).select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


RES = with_("samples", **WEIGHTS) + ", m AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM w a JOIN w b ON a.j = b.j GROUP BY 1, 2) "


@query("agg_43_resolution_metrics", "source:l amplitude:9 peak_error:l spread:9 leakage:9",
       RES + "SELECT c.j AS source, amplitude, abs(peak - c.j) AS peak_error, spread, leakage FROM (SELECT j, sum(v) FILTER (i = j) AS amplitude, "
       "arg_max(i, abs(v)) AS peak, sum(v * v) FILTER (i <> j) AS spread FROM m GROUP BY j) c JOIN "
       "(SELECT i, sum(v * v) FILTER (i <> j) AS leakage FROM m GROUP BY i) r ON r.i = c.j")
def _(spark, sf):
    return A.resolution_metrics(A.multiply(weights(spark, sf), gain(spark, sf)))


@query("agg_44_point_spread_cross_talk", "kind i:l j:l v:9",
       RES + "SELECT 'spread' AS kind, i, j, v FROM m WHERE j = 3 UNION ALL SELECT 'cross_talk', i, j, v FROM m WHERE i = 3")
def _(spark, sf):
    m = A.multiply(weights(spark, sf), gain(spark, sf))
    return m.where("j = 3").withColumn("kind", F.lit("spread")).unionByName(m.where("i = 3").withColumn("kind", F.lit("cross_talk")))


@query("agg_45_resolution_matrix", "i:l j:l v:9", RES + "SELECT i, j, v FROM m")
def _(spark, sf):
    return A.multiply(weights(spark, sf), gain(spark, sf))


POWER = "SELECT a.i AS source, sum(a.v * c.v * b.v) AS power FROM w a JOIN {c} c ON c.i = a.j JOIN w b ON b.i = a.i AND b.j = c.j GROUP BY 1"


@query("agg_46_source_power", "source:l power:10 norm:8 gain0:6",
       with_("samples", **WEIGHTS) + f", c AS ({COV}), p AS ({POWER.format(c='c')}) SELECT source, power, sqrt(greatest(power, 1e-20)) AS norm, "
       "v / sqrt(greatest(power, 1e-20)) AS gain0 FROM p JOIN w ON w.i = source AND w.j = 0")
def _(spark, sf):
    w, c = weights(spark, sf), cov(spark, sf)
    g = A.unit_noise_gain(w, c).where("j = 0").select(F.col("i").alias("source"), F.col("v").alias("gain0"))
    return A.source_power(w, c).join(A.noise_norm(w, c), "source").join(g, "source")


@query("agg_47_power_contrast", "source:l contrast:6",
       with_("samples", **WEIGHTS) + f", c1 AS ({COV.replace('GROUP', 'WHERE t % 2 = 0 GROUP')}), c0 AS ({COV.replace('GROUP', 'WHERE t % 2 = 1 GROUP')}), "
       f"a AS ({POWER.format(c='c1')}), b AS ({POWER.format(c='c0')}) SELECT source, (a.power - b.power) / greatest(b.power, 1e-20) AS contrast FROM a JOIN b USING (source)")
def _(spark, sf):
    return A.power_contrast(weights(spark, sf), cov(spark, sf, "t % 2 = 0"), cov(spark, sf, "t % 2 = 1"))


@query("agg_48_depth_weights", "source:l weight:8",
       with_(**WEIGHTS) + ", n AS (SELECT i AS source, power(greatest(sqrt(sum(v * v)), 1e-10), -0.64) AS w FROM w GROUP BY 1) "
       "SELECT source, w / (SELECT avg(w) FROM n) AS weight FROM n")
def _(spark, sf):
    return A.depth_weights(gain(spark, sf))


@query("agg_49_state_fit_vector", "state:l mean_exponent:6 std_exponent:6 mean_peak:6 std_peak:6 mean_power:6 mean_r2:6",
       "SELECT label AS state, coalesce(avg(e[1]) FILTER (e[1] > 0), 0) AS mean_exponent, coalesce(stddev_pop(e[1]) FILTER (e[1] > 0), 0) AS std_exponent, "
       "coalesce(avg(e[2]) FILTER (e[2] > 0), 0) AS mean_peak, coalesce(stddev_pop(e[2]) FILTER (e[2] > 0), 0) AS std_peak, avg(e[3]) AS mean_power, avg(e[4]) AS mean_r2 "
       "FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) GROUP BY 1")
def _(spark, sf):
    e = ad.table(spark, sf, "embeddings").select(F.col("label").alias("state"), F.col("embedding").cast("array<double>").alias("e"))
    return A.state_fit_vector(e.select("state", *[F.col("e")[k].alias(c) for k, c in enumerate(("exponent", "peak_freq", "peak_power", "r_squared"))]))


@query("agg_50_band_peaks", "recording alpha_peak:2 beta_peak:2",
       with_("esamples") + "SELECT recording, max_by(f, p) FILTER (f BETWEEN 7 AND 13) AS alpha_peak, max_by(f, p) FILTER (f > 13 AND f <= 30) AS beta_peak FROM "
       "(SELECT recording, value AS f, t AS p FROM esamples) GROUP BY 1")
def _(spark, sf):
    e = ad.event_samples(spark, sf)
    return A.band_peaks(e.select("recording", F.col("value").alias("freq"), F.col("t").alias("power")), "recording")


@query("agg_51_imaginary_coherence", "channel:l icoh:6",
       with_("fids") + ", s AS (SELECT n AS channel, dyn * 2 + edit AS t, re, im FROM fids) SELECT a.channel, "
       "avg(a.im * r.re - a.re * r.im) / sqrt(avg(a.re ** 2 + a.im ** 2) * avg(r.re ** 2 + r.im ** 2) + 1e-12) AS icoh "
       "FROM s a JOIN s r ON a.t = r.t AND r.channel = 0 GROUP BY 1")
def _(spark, sf):
    s = ad.fids(spark, sf).select(F.lit("all").alias("recording"), F.col("n").alias("channel"), (F.col("dyn") * 2 + F.col("edit")).alias("t"), "s")
    return A.imaginary_coherence(s, 0)


@query("agg_52_vertex_map_correlation", "r:6 n:l",
       "WITH a AS (SELECT l_partkey AS v, avg(l_discount) AS x FROM lineitem GROUP BY 1), b AS (SELECT p_partkey AS v, p_retailprice AS y FROM part) "
       "SELECT corr(x, y) AS r, count(*) AS n FROM a JOIN b USING (v) WHERE x <> 0 AND y <> 0 HAVING count(*) >= 100")
def _(spark, sf):
    a = ad.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("v")).agg(F.avg("l_discount").alias("value"))
    b = ad.table(spark, sf, "part").select(F.col("p_partkey").alias("v"), F.col("p_retailprice").alias("value"))
    return A.common_correlation(a, b, ["v"], 100, clean=True)


@query("agg_53_component_regressors", "component:l corr_a:4 corr_b:4 max_abs_corr:4",
       with_("interleaved") + ", x AS (SELECT 'a' AS condition, recording, t, value AS x FROM interleaved WHERE channel = 1 UNION ALL SELECT 'b', recording, t, value FROM interleaved WHERE channel = 2), "
       "r AS (SELECT channel AS component, condition, round(corr(value, x), 4) AS r FROM interleaved JOIN x USING (recording, t) GROUP BY 1, 2) "
       "SELECT component, max(CASE WHEN condition = 'a' THEN r END) AS corr_a, max(CASE WHEN condition = 'b' THEN r END) AS corr_b, max(abs(r)) AS max_abs_corr FROM r GROUP BY 1")
def _(spark, sf):
    s = ad.interleaved(spark, sf)
    reg = s.where("channel IN (1, 2)").select(F.when(F.col("channel") == 1, "a").otherwise("b").alias("condition"), "recording", "t", "value")
    return A.component_regressor_correlation(s.withColumnRenamed("channel", "component"), reg, ["a", "b"])


@query("agg_54_best_component", "kind component:l score:6",
       with_("interleaved") + ", r AS (SELECT s.channel AS component, corr(s.value, x.value) AS r FROM interleaved s JOIN interleaved x ON x.recording = s.recording AND x.t = s.t AND x.channel = 7 WHERE s.channel <> 7 GROUP BY 1), "
       "b AS (SELECT t AS component, coalesce(sum(value ** 2) FILTER (channel * 2.0 BETWEEN 38 AND 42), 0) / (sum(value ** 2) + 1e-12) AS q FROM samples GROUP BY 1) "
       "SELECT 'time' AS kind, arg_max(component, abs(r)) AS component, arg_max(r, abs(r)) AS score FROM r UNION ALL SELECT 'band', arg_max(component, q), max(q) FROM b")
def _(spark, sf):
    s, i = ad.samples(spark, sf), ad.interleaved(spark, sf)
    t = A.best_component(i.where("channel <> 7").withColumnRenamed("channel", "component"), i.where("channel = 7"), "t")
    b = A.best_component_by_band(s.select(F.col("t").alias("component"), (F.col("channel") * 2.0).alias("freq"), (F.col("value") ** 2).alias("power")), 40.0)
    return t.select(F.lit("time").alias("kind"), "component", F.col("r").alias("score")).unionByName(
        b.select(F.lit("band").alias("kind"), "component", F.col("ratio").alias("score")))


@query("agg_55_sensor_connectivity", "i:l j:l r:6",
       with_("samples", **WEIGHTS) + ", p AS (SELECT t, i, sum(v * value) AS s FROM samples JOIN w ON j = channel GROUP BY 1, 2) "
       "SELECT a.i, b.i AS j, corr(a.s, b.s) AS r FROM p a JOIN p b ON a.t = b.t AND a.i < b.i GROUP BY 1, 2")
def _(spark, sf):
    from ondula.operators.joins import project_frames
    return A.connectivity(project_frames(ad.frames(spark, sf), weights(spark, sf))).where("i < j")


@query("agg_56_sensor_evoked", "rel:l i:l s:9",
       with_("samples", **WEIGHTS) + "SELECT t - 90 AS rel, i, sum(v * value) AS s FROM samples JOIN w ON j = channel WHERE t >= 90 AND t < 140 GROUP BY 1, 2")
def _(spark, sf):
    from ondula.operators.joins import evoked_window, project_frames
    ev = evoked_window(ad.frames(spark, sf), onset=100.0, dt=1.0, pre=10.0, post=40.0)
    return project_frames(ev, weights(spark, sf)).select((F.col("t") - 90).alias("rel"), F.posexplode("x").alias("i", "s"))


@query("agg_57_subject_vector", "subject mean_strength:6 fo_state0:6 mean_exponent:6",
       with_("trade", "states") + "SELECT 'trade' AS subject, (SELECT sum(weight) / 25 FROM trade) AS mean_strength, "
       "(SELECT avg(CAST(state = 0 AS DOUBLE)) FROM states) AS fo_state0, (SELECT avg(value) FROM events) AS mean_exponent")
def _(spark, sf):
    e, n = ad.trade(spark, sf), ad.trade_nodes(spark, sf)
    conn = A.connectome_features(e, n, G.clustering(G.above_median(e), n)).select(
        F.col("graph").alias("subject"), F.lit("mean_strength").alias("name"), F.col("mean_strength").alias("value"))
    occ = A.occupancy(ad.states(spark, sf), "recording", "state", 10).select(
        F.lit("trade").alias("subject"), F.concat(F.lit("fo_state"), "state").alias("name"), F.col("occupancy").alias("value"))
    exp = ad.table(spark, sf, "events").select(F.lit("trade").alias("subject"), F.lit("mean_exponent").alias("name"), "value")
    return A.subject_vector(conn, occ, exp, names=["mean_strength", "fo_state0", "mean_exponent"])


@query("agg_58_structure_table", "subject " + " ".join(f"{s}:4" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")),
       "SELECT n_name AS subject, " + ", ".join(f"max(CASE WHEN c_mktsegment = '{s}' THEN c_acctbal END) AS {s}" for s in
       ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def _(spark, sf):
    from ondula.sources.text import structure_table
    rows = ad.table(spark, sf, "customer").join(ad.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("n_name").alias("subject"), F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("value"))
    return structure_table(rows, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


@query("agg_59_band_mean_power", "recording power:6",
       with_("samples4") + "SELECT recording, avg(power(10.0, value)) AS power FROM samples4 WHERE channel * 2.0 BETWEEN 8 AND 13 GROUP BY 1")
def _(spark, sf):
    return A.band_mean_power(ad.samples(spark, sf, split=True).select("recording", (F.col("channel") * 2.0).alias("freq"), F.col("value").alias("logp")),
                             "recording", 8, 13)
