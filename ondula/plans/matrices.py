"""Matrix, model and decomposition queries. Sign- and order-free quantities are returned where a factor is ambiguous."""

import numpy as np
from pyspark.sql import functions as F

from ondula.operators import keyed as K
from ondula.operators import matrix as M
from ondula.operators import spectral as S
from ondula.operators import windows as Wn
from ondula.operators.gram import gram
from ondula.operators.hmm import GaussianHMM
from ondula.operators.sweep import Registry, recovery_sweep
from ondula.plans import adapters as ad
from ondula.plans.adapters import with_
from ondula.plans.aggregates import WEIGHTS, weights
from ondula.plans.registry import query


def frames8(spark, sf):
    """The first eight channels, in recordings of their own by label."""
    return ad.frames(spark, sf).withColumn("x", F.slice("x", 1, 8))


def _table(spark, names, rows):
    return spark.createDataFrame(rows, names)




@query("mat_01_principal_components", "total:7 n:l", with_("samples") + "SELECT sum(v) AS total, 64 AS n FROM (SELECT var_pop(value) AS v FROM samples GROUP BY channel)")
def _(spark, sf):
    f = ad.frames(spark, sf)
    scores = M.principal(f).transform(f).select("recording", "t", F.posexplode("x").alias("component", "v"))
    return scores.groupBy("component").agg(F.var_pop("v").alias("v")).agg(F.sum("v").alias("total"), F.count("*").alias("n"))


@query("mat_01b_components_of_recordings", "recording total:7 squares:7 off:7",
       "WITH e AS (SELECT 'r' || (label % 4) AS recording, vec_id AS t, unnest(range(64)) AS channel, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings), "
       "c AS (SELECT a.recording, a.channel AS i, b.channel AS j, covar_pop(a.v, b.v) AS c FROM e a JOIN e b ON a.recording = b.recording AND a.t = b.t GROUP BY 1, 2, 3) "
       "SELECT recording, sum(CASE WHEN i = j THEN c ELSE 0 END) AS total, sum(c * c) AS squares, 0 AS off FROM c GROUP BY 1")
def _(spark, sf):
    f = ad.frames(spark, sf, split=True)
    own = F.col("i") == F.col("j")
    g = gram(K.transform(f, K.principal(f)))
    return g.groupBy("recording").agg(F.sum(F.when(own, F.col("cov"))).alias("total"), F.sum(F.when(own, F.col("cov") ** 2)).alias("squares"),
                                      F.max(F.when(~own, F.abs("cov"))).alias("off"))


@query("mat_02_invertible_components", "t:l channel:l value:8", with_("samples") + "SELECT t, channel, value FROM samples")
def _(spark, sf):
    f = ad.frames(spark, sf)
    p = M.principal(f)
    return p.inverse(p.transform(f)).select("t", F.posexplode("x").alias("channel", "value"))


@query("mat_03_embedded_components", "component:l variance:8 n:l")
def _(spark, sf):
    p = M.prepare(ad.frames(spark, sf), {"tde_pca": {"n_embeddings": 5, "n_components": 10}})
    return p.select(F.posexplode("x").alias("component", "v")).groupBy("component").agg(F.var_pop("v").alias("variance"), F.count("*").alias("n"))


def customer_rows(spark, sf):
    """Row number, two order features and the balance of each customer with orders."""
    o = ad.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("a"), F.max("o_totalprice").alias("b"))
    c = ad.table(spark, sf, "customer").join(o, "c_custkey").select(F.col("c_custkey").alias("row"), F.array("a", "b").alias("x"), F.col("c_acctbal").alias("y"))
    return c


RIDGE = ("WITH o AS (SELECT o_custkey AS k, CAST(count(*) AS DOUBLE) AS a, max(o_totalprice) AS b FROM orders GROUP BY 1), r AS (SELECT c_custkey AS row, a, b, c_acctbal AS y FROM customer JOIN o ON k = c_custkey), ")
SOLVE = ("q{s} AS (SELECT {g} count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) * count(*) AS ab, "
         "covar_pop(a, y) / stddev_pop(a) * count(*) AS ay, covar_pop(b, y) / stddev_pop(b) * count(*) AS byy FROM {t} {w}), "
         "f{s} AS (SELECT *, ((n + 1) * ay - ab * byy) / ((n + 1) * (n + 1) - ab * ab) AS ba, ((n + 1) * byy - ab * ay) / ((n + 1) * (n + 1) - ab * ab) AS bb FROM q{s}) ")


@query("mat_04_ridge", "beta_a:5 beta_b:5 r2:8 mse:2",
       RIDGE + SOLVE.format(s="", g="", t="r", w="") + ", p AS (SELECT y, (a - ma) / sa * ba + (b - mb) / sb * bb + my AS p, ba, bb, my FROM r, f) "
       "SELECT any_value(ba) AS beta_a, any_value(bb) AS beta_b, 1 - sum((y - p) ** 2) / (sum((y - my) ** 2) + 1e-10) AS r2, avg((y - p) ** 2) AS mse FROM p")
def _(spark, sf):
    fit, pred = M.ridge(customer_rows(spark, sf))
    return pred.agg(F.lit(float(fit["beta"][0])).alias("beta_a"), F.lit(float(fit["beta"][1])).alias("beta_b"), F.lit(float(fit["r2"])).alias("r2"),
                    F.avg(F.pow(F.col("y") - F.col("y_pred"), 2)).alias("mse"))


def folds(spark, sf):
    r = customer_rows(spark, sf)
    return r.withColumn("fold", F.col("row") % 5)


@query("mat_05_cross_validation", "row:l y_pred:3 r2:7",
       RIDGE + "t AS (SELECT g, r.* FROM r, (SELECT unnest(range(5)) AS g) WHERE row % 5 <> g), " + SOLVE.format(s="", g="g,", t="t", w="GROUP BY g") +
       ", p AS (SELECT row, y, (a - ma) / sa * ba + (b - mb) / sb * bb + my AS p FROM r JOIN f ON g = row % 5) "
       "SELECT row, p AS y_pred, 1 - (SELECT sum((y - p) ** 2) FROM p) / ((SELECT var_pop(y) * count(*) FROM r) + 1e-10) AS r2 FROM p")
def _(spark, sf):
    fit, pred = M.cross_validate(folds(spark, sf))
    return pred.withColumn("r2", F.lit(float(fit["r2"])))


@query("top_04_feature_importance", "name importance:6 baseline_r2:6 permuted_r2:6")
def _(spark, sf):
    return M.feature_importance(folds(spark, sf), ["orders", "largest"], seed=3)


def design(spark, sf):
    """Frames with a design of intercept, label parity and trend."""
    e = ad.table(spark, sf, "embeddings")
    d = F.array(F.lit(1.0), (F.col("label") % 2).cast("double"), F.col("vec_id") / 100.0)
    return e.select(F.col("vec_id").alias("t"), d.alias("d"), F.col("embedding").cast("array<double>").alias("x"))


GLM = ("WITH e AS (SELECT vec_id / 100e0 AS u, CAST(label % 2 AS DOUBLE) AS g, unnest(range(64)) AS sensor, unnest(CAST(embedding AS DOUBLE[])) AS y FROM embeddings), "
       "m AS (SELECT sensor, count(*) AS n, avg(g) AS mg, avg(u) AS mu, avg(y) AS my, var_pop(g) * count(*) AS gg, var_pop(u) * count(*) AS uu, covar_pop(g, u) * count(*) AS gu, covar_pop(g, y) * count(*) AS gy, covar_pop(u, y) * count(*) AS uy, var_pop(y) * count(*) AS yy FROM e GROUP BY 1), "
       "b AS (SELECT *, (uu * gy - gu * uy) / (gg * uu - gu * gu) AS bg, (gg * uy - gu * gy) / (gg * uu - gu * gu) AS bu FROM m), "
       "r AS (SELECT *, yy - bg * gy - bu * uy AS rss FROM b) ")


@query("mat_06_linear_model", "sensor:l b0:7 b1:7 b2:7 rss:6", GLM + "SELECT sensor, my - bg * mg - bu * mu AS b0, bg AS b1, bu AS b2, rss FROM r")
def _(spark, sf):
    f = design(spark, sf)
    m = M.fit_glm(f)
    res = M.residual_frames(f, m).select(F.posexplode("x").alias("sensor", "v")).groupBy("sensor").agg(F.sum(F.col("v") ** 2).alias("rss"))
    b = _table(spark, "sensor int, b0 double, b1 double, b2 double", [(i, *map(float, c)) for i, c in enumerate(m.beta.T)])
    return res.join(b, "sensor")


@query("mat_07_contrast_t", "sensor:l effect:7 t:5", GLM + "SELECT sensor, bg AS effect, bg / sqrt(rss / (n - 3) * uu / (gg * uu - gu * gu)) AS t FROM r")
def _(spark, sf):
    return M.contrast_t(design(spark, sf), [0.0, 1.0, 0.0])


@query("mat_08_permutation_test", "sensor:l t:5 p:4")
def _(spark, sf):
    return M.permutation_test(design(spark, sf), [0.0, 1.0, 0.0], 30, seed=1)


@query("mat_09_whitening", "i:l j:l cov:6", "SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS cov FROM (SELECT unnest(range(16)) AS i), (SELECT unnest(range(16)) AS j)")
def _(spark, sf):
    f = ad.frames(spark, sf)
    return gram(M.whiten(f, 16).transform(f)).select("i", "j", "cov")


def mixed(spark, sf):
    """Four non-Gaussian sources made from the frames, mixed by a fixed matrix."""
    f = ad.frames(spark, sf)
    src = F.array(*[F.signum(F.get("x", F.lit(k))) * F.pow(F.abs(F.get("x", F.lit(k))), F.lit(p)) * 10 for k, p in ((0, 0.1), (1, 0.2), (2, 2.0), (3, 0.15))])
    a = ((1.0, 0.5, 0.2, 0.1), (0.3, 1.0, 0.4, 0.2), (0.1, 0.3, 1.0, 0.5), (0.2, 0.1, 0.4, 1.0))
    mix = F.array(*[sum(float(w) * F.get("_s", F.lit(k)) for k, w in enumerate(r)) for r in a])
    return f.withColumn("_s", src).select("recording", "t", mix.alias("x"), "_s")


@query("mat_10_fast_ica", "component:l variance:5 n_sources:l")
def _(spark, sf):
    f = mixed(spark, sf).select("recording", "t", "x")
    s = M.fast_ica(f, 4, max_iter=60).apply(f).select(F.posexplode("x").alias("component", "v"))
    return s.groupBy("component").agg(F.var_pop("v").alias("variance")).withColumn("n_sources", F.lit(4))


@query("mat_11_probabilistic_ica", "component:l std:6 n:l")
def _(spark, sf):
    _, z = M.probabilistic_ica(mixed(spark, sf).select("recording", "t", "x"), 4, max_iter=60)
    return z.select(F.posexplode("x").alias("component", "v")).groupBy("component").agg(F.stddev_pop("v").alias("std"), F.count("*").alias("n"))


@query("mat_12_apply_unmixing", "t:l channel:l value:5", with_("samples") + ", m AS (SELECT channel, avg(value) AS m FROM samples GROUP BY 1) SELECT t, channel, value - m AS value FROM samples JOIN m USING (channel)")
def _(spark, sf):
    f = ad.frames(spark, sf)
    w = M.whiten(f, 64)
    model = M.Independent(w.mean, w.matrix, w.back, 0, True)
    s = model.apply(f)
    from ondula.operators.joins import project_frames
    return project_frames(s, w.back).select("t", F.posexplode("x").alias("channel", "value"))


@query("mat_13_dimension_evidence", "k:l aic:2 bic:2",
       "WITH v AS (SELECT s_suppkey + 1 AS k, 1.0 / (s_suppkey + 1) AS v FROM supplier), d AS (SELECT count(*) AS d FROM v), "
       "c AS (SELECT k, sum(ln(v)) OVER w AS l, (SELECT sum(v) FROM v) - sum(v) OVER w AS r FROM v WINDOW w AS (ORDER BY k)), "
       "e AS (SELECT k, -500 * (l + (d - k) * ln(greatest(r / (d - k), 1e-19))) AS ll, d * k - 0.5 * k * (k + 1) AS m FROM c, d WHERE k < d) SELECT k, ll - m AS aic, ll - 0.5 * m * ln(1000) AS bic FROM e")
def _(spark, sf):
    s = ad.table(spark, sf, "supplier").select((F.col("s_suppkey") + 1).alias("k"), (1.0 / (F.col("s_suppkey") + 1)).alias("value"))
    return M.evidence(s, 1000)


@query("mat_13b_dimensionality", "k_aic:l k_bic:l k:l")
def _(spark, sf):
    spec, n = M.spectrum_table(ad.frames(spark, sf))
    return M.dimensionality(M.evidence(spec, n))


def positive(spark, sf):
    return ad.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), F.transform(F.col("embedding").cast("array<double>"), lambda v: F.abs(v)).alias("v"))


@query("mat_14_nonnegative_factors", "row:l w0:4 w1:4 error:4")
def _(spark, sf):
    w, h = M.nmf(positive(spark, sf), 2, 20, seed=2)
    hs = [F.array(*[F.lit(float(v)) for v in r]) for r in h]
    fit = F.zip_with(F.transform(hs[0], lambda v: v * F.get("w", F.lit(0))), F.transform(hs[1], lambda v: v * F.get("w", F.lit(1))), lambda a, b: a + b)
    err = F.aggregate(F.zip_with("v", fit, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return w.select("row", F.get("w", F.lit(0)).alias("w0"), F.get("w", F.lit(1)).alias("w1"), err.alias("error"))


@query("mat_15_spectral_components", "state:l component:l k:l psd:6")
def _(spark, sf):
    e = ad.table(spark, sf, "embeddings").select((F.col("label") % 3).alias("state"), F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "v"))
    psd = e.groupBy("state", (F.col("p") % 8).alias("k"), F.floor(F.col("p") / 8).cast("int").alias("channel")).agg(F.avg(F.col("v") ** 2).alias("psd"))
    return M.spectral_components(psd, 2, 15)[0]


@query("mat_16_curve_resolution", "row:l c0:4 c1:4")
def _(spark, sf):
    c, _, _ = M.curve_resolution(positive(spark, sf), 2, 20)
    return c.select("row", F.get("c", F.lit(0)).alias("c0"), F.get("c", F.lit(1)).alias("c1"))


@query("mat_17_tucker", "t:l energy:6 n:l")
def _(spark, sf):
    emb = Wn.embed(frames8(spark, sf), 4)
    core = M.tucker(emb, 4, 3, 2).transform(emb)
    return core.select("t", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v).alias("energy"), F.size("x").alias("n"))


@query("mat_17b_mode_gram", "i:l j:l v:7", with_("fids") + "SELECT a.n AS i, b.n AS j, sum(a.re * b.re) AS v FROM fids a JOIN fids b ON a.dyn = b.dyn AND a.edit = b.edit GROUP BY 1, 2")
def _(spark, sf):
    return M.mode_gram(ad.fids(spark, sf).select("dyn", "edit", "n", F.col("s.re").alias("v")), "n", ["dyn", "edit", "n"])


def _hmm(spark, sf, n_epochs=4):
    f = ad.table(spark, sf, "embeddings").select(F.concat(F.lit("s"), F.floor(F.col("vec_id") / 250).cast("string")).alias("recording"), (F.col("vec_id") % 250).alias("t"),
                                                 F.col("embedding").cast("array<double>").alias("x"))
    h = GaussianHMM(2, seed=1)
    h.fit(f, n_epochs, block=64)
    return h, f


@query("mat_18_hmm_fit", "epoch:l loglik:3 state:l occupancy:4")
def _(spark, sf):
    h, f = _hmm(spark, sf)
    none = lambda kind: F.lit(None).cast(kind)
    rows = _table(spark, "epoch int, loglik double", [(i, float(v)) for i, v in enumerate(h.history)])
    occ = h.posterior(f, 64).groupBy("state").agg(F.avg("p").alias("occupancy"))
    return rows.select("epoch", "loglik", none("int").alias("state"), none("double").alias("occupancy")).unionByName(
        occ.select(none("int").alias("epoch"), none("double").alias("loglik"), "state", "occupancy"))


@query("mat_19_hmm_posterior", "recording t:l total:6 n:l", "SELECT 's' || (vec_id // 250) AS recording, vec_id % 250 AS t, 1.0 AS total, 2 AS n FROM embeddings")
def _(spark, sf):
    h, f = _hmm(spark, sf, 2)
    return h.posterior(f, 64).groupBy("recording", "t").agg(F.sum("p").alias("total"), F.count("*").alias("n"))


@query("mat_20_hmm_decode", "recording t:l state:l")
def _(spark, sf):
    h, f = _hmm(spark, sf, 2)
    return h.decode(f, 64)


def epoch_covs(spark, sf):
    """Covariance of all channels per epoch of 100 frames; with fewer frames than channels it would be singular."""
    f = ad.frames(spark, sf).select(F.floor(F.col("t") / 100).alias("epoch"), "x")
    g = gram(f, ["epoch"]).groupBy("epoch").agg(F.sort_array(F.collect_list(F.struct("i", "j", "cov"))).alias("_c"))
    return g.select("epoch", F.col("_c.cov").alias("c"))


@query("mat_21_geometric_mean", "i:l j:l v:9")
def _(spark, sf):
    m = M.covariance_mean(epoch_covs(spark, sf))
    return _table(spark, "i int, j int, v double", [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))])


@query("mat_22_spd_distance", "epoch:l distance:6")
def _(spark, sf):
    c = epoch_covs(spark, sf)
    return M.spd_distances(c, np.eye(64) * 0.01)


@query("mat_23_tangent_space", "epoch:l n:l norm:6")
def _(spark, sf):
    t = M.tangent_space(epoch_covs(spark, sf))
    return t.select("epoch", F.size("tangent").alias("n"), F.sqrt(F.aggregate("tangent", F.lit(0.0), lambda s, v: s + v * v)).alias("norm"))


# commuting matrices, for which the geometry has closed forms: the diagonal of all channels, and pairs of neighbouring channels
VARIANCES = with_("samples") + ", d AS (SELECT t // 25 AS epoch, channel, var_pop(value) AS v FROM samples GROUP BY 1, 2), m AS (SELECT channel, exp(avg(ln(v))) AS r FROM d GROUP BY 1) "


def diagonal_covs(spark, sf):
    f = ad.frames(spark, sf).select(F.floor(F.col("t") / 25).alias("epoch"), "x")
    g = gram(f, ["epoch"]).withColumn("v", F.when(F.col("i") == F.col("j"), F.col("cov")).otherwise(0.0))
    return g.groupBy("epoch").agg(F.sort_array(F.collect_list(F.struct("i", "j", "v"))).alias("_c")).select("epoch", F.col("_c.v").alias("c"))


@query("mat_21b_diagonal_mean", "i:l j:l v:9",
       VARIANCES + "SELECT a.channel AS i, b.channel AS j, CASE WHEN a.channel = b.channel THEN a.r ELSE 0 END AS v FROM m a, m b")
def _(spark, sf):
    m = M.covariance_mean(diagonal_covs(spark, sf))
    return _table(spark, "i int, j int, v double", [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))])


@query("mat_21c_geometric_means_by_key", "part:l i:l j:l v:9",
       VARIANCES + ", k AS (SELECT epoch % 4 AS part, channel, exp(avg(ln(v))) AS r FROM d GROUP BY 1, 2) "
       "SELECT a.part, a.channel AS i, b.channel AS j, CASE WHEN a.channel = b.channel THEN a.r ELSE 0 END AS v FROM k a JOIN k b ON a.part = b.part")
def _(spark, sf):
    covs = diagonal_covs(spark, sf).withColumn("part", F.col("epoch") % 4)
    cells = K.covariance_mean(covs, ["part"]).select("part", F.posexplode("mean").alias("_p", "v"))
    return cells.select("part", F.floor(F.col("_p") / 64).alias("i"), (F.col("_p") % 64).alias("j"), "v")


@query("mat_22b_pair_distances", "epoch:l pair:l distance:6",
       with_("samples") + ", p AS (SELECT a.t // 25 AS epoch, a.channel // 2 AS pair, var_pop(a.value) AS a, var_pop(b.value) AS b, covar_pop(a.value, b.value) AS c FROM samples a JOIN samples b "
       "ON a.t = b.t AND a.channel % 2 = 0 AND b.channel = a.channel + 1 GROUP BY 1, 2), r AS (SELECT *, sqrt((a - b) ** 2 / 4 + c ** 2) AS h FROM p) "
       "SELECT epoch, pair, sqrt(ln(((a + b) / 2 + h) / 0.01) ** 2 + ln(((a + b) / 2 - h) / 0.01) ** 2) AS distance FROM r")
def _(spark, sf):
    f = ad.frames(spark, sf).select(F.floor(F.col("t") / 25).alias("epoch"), F.posexplode(
        F.transform(F.sequence(F.lit(0), F.size("x") - 2, F.lit(2)), lambda k: F.slice("x", k + 1, 2))).alias("pair", "x"))
    c = gram(f, ["epoch", "pair"]).groupBy("epoch", "pair").agg(F.sort_array(F.collect_list(F.struct("i", "j", "cov"))).alias("_c"))
    return M.spd_distances(c.select("epoch", "pair", F.col("_c.cov").alias("c")), np.eye(2) * 0.01)


@query("mat_23b_diagonal_tangent", "epoch:l n:l norm:6",
       VARIANCES + "SELECT epoch, 2080 AS n, sqrt(sum((r * ln(v / r)) ** 2)) AS norm FROM d JOIN m USING (channel) GROUP BY 1")
def _(spark, sf):
    t = M.tangent_space(diagonal_covs(spark, sf))
    return t.select("epoch", F.size("tangent").alias("n"), F.sqrt(F.aggregate("tangent", F.lit(0.0), lambda s, v: s + v * v)).alias("norm"))


@query("mat_24_artifact_epochs", "epoch:l z:5 artifact:b")
def _(spark, sf):
    return M.artifact_epochs(epoch_covs(spark, sf), 2.0)


@query("mat_25_artifact_cleaning", "t:l channel:l value:8", with_("samples") + "SELECT t, channel, value FROM samples WHERE t >= 1 AND t <= (SELECT (max(t) + 1 - 100) // 50 * 50 + 98 FROM samples)")
def _(spark, sf):
    f = ad.frames(spark, sf)
    out = M.clean_artifacts(f, M.calibrate(f, 50.0))  # a cutoff nothing reaches: the windows must add up to the input
    end = f.agg(F.floor((F.max("t") + 1 - 100) / 50) * 50 + 98).first()[0]
    return out.where((F.col("t") >= 1) & (F.col("t") <= end))


@query("mat_26_sign_alignment", "recording channel:l sign:1")
def _(spark, sf):
    return M.align_signs(ad.frames(spark, sf, split=True), n_outer=2)


SIGN = with_("samples4") + (", s AS (SELECT recording, channel, t, value, CASE WHEN recording = 'r1' AND channel % 2 = 0 THEN -value ELSE value END AS v2 FROM samples4), "
                            "f AS (SELECT recording, channel, sign(sum(value)) AS a, sign(sum(v2)) AS b FROM s GROUP BY 1, 2), "
                            "c AS (SELECT a.recording, a.channel AS i, b.channel AS j, avg(a.value * b.value) AS x, avg(a.v2 * b.v2) AS y FROM s a JOIN s b USING (recording, t) WHERE a.channel < b.channel GROUP BY 1, 2, 3), "
                            "r AS (SELECT a.recording AS p, b.recording AS q, corr(a.x, b.x) AS rx, corr(a.y, b.y) AS ry FROM c a JOIN c b ON a.i = b.i AND a.j = b.j AND a.recording < b.recording GROUP BY 1, 2) ")


@query("mat_27_sign_metrics", "n_flips:l mean_correlation_before:6 mean_correlation_after:6",
       SIGN + "SELECT (SELECT count(*) FROM f WHERE a <> b) AS n_flips, avg(rx) AS mean_correlation_before, avg(ry) AS mean_correlation_after FROM r")
def _(spark, sf):
    f = ad.frames(spark, sf, split=True)
    g = f.withColumn("x", F.transform("x", lambda v, i: F.when((F.col("recording") == "r1") & (i % 2 == 0), -v).otherwise(v)))
    return M.sign_metrics(f, g)


@query("mat_28_mixture_binarise", "t:l state:l active:l")
def _(spark, sf):
    g = ad.samples(spark, sf).select("t", F.col("channel").alias("state"), F.abs("value").alias("p"))
    return M.mixture_binarise(g, 5)


VFA = ("WITH s AS (SELECT l_partkey AS voxel, 0.03 + 0.005 * l_quantity AS flip, 100 + l_extendedprice / 1000 AS value FROM lineitem), "
       "f AS (SELECT voxel, CASE WHEN regr_sxx(value / sin(flip), value / tan(flip)) > 1e-10 THEN regr_slope(value / sin(flip), value / tan(flip)) ELSE 0 END AS b, avg(value / sin(flip)) AS y, avg(value / tan(flip)) AS x FROM s GROUP BY 1), "
       "g AS (SELECT voxel, b, least(greatest(b, 0.001), 0.9999) AS e1, y, x FROM f), "
       "m AS (SELECT voxel, least(greatest(-0.004 / ln(e1), 0.1), 6.0) AS t1, (y - b * x) / (1 - e1) AS m0 FROM g) ")


@query("mat_29_vfa_fit", "voxel:l t1:6 m0:3",
       (VFA + "SELECT voxel, t1, least(greatest(m0, 0), (SELECT quantile_cont(m0, 0.999) FROM m WHERE m0 > 0)) AS m0 FROM m").replace("regr_sxx(value / sin(flip), value / tan(flip))", "var_pop(value / tan(flip)) * count(*)"))
def _(spark, sf):
    s = ad.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("voxel"), (0.03 + 0.005 * F.col("l_quantity")).alias("flip"), (100 + F.col("l_extendedprice") / 1000).alias("value"))
    return M.vfa_fit(s, ["voxel"], 0.004)


@query("mat_30_decay_fit", "voxel:l s0:3 r2star:6 t2star_ms:5",
       "WITH f AS (SELECT l_partkey AS voxel, -regr_slope(ln(l_extendedprice + 1e-10), l_quantity / 1000) AS r, exp(regr_intercept(ln(l_extendedprice + 1e-10), l_quantity / 1000)) AS s0 FROM lineitem GROUP BY 1), "
       "g AS (SELECT voxel, s0, CASE WHEN r > 0 AND r <= 200 THEN r ELSE 0 END AS r FROM f) "
       "SELECT voxel, s0, r AS r2star, CASE WHEN r > 0 AND 1000 / r <= 100 THEN 1000 / r ELSE 0 END AS t2star_ms FROM g")
def _(spark, sf):
    e = ad.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("voxel"), (F.col("l_quantity") / 1000).alias("te"), F.col("l_extendedprice").alias("value"))
    return M.decay_fit(e, ["voxel"])


def exponential(p, protocol):
    """S0 exp(-te / t2) for many voxels."""
    return p[:, [0]] * np.exp(-protocol["te"] / p[:, [1]])


@query("mat_31_bounded_fit", "voxel:l s0:2 t2:5 rmse:5",
       "SELECT p_partkey AS voxel, p_retailprice AS s0, 0.02 + p_size / 1000.0 AS t2, 0.0 AS rmse FROM part")
def _(spark, sf):
    te = np.array([0.005, 0.01, 0.02, 0.04, 0.08])
    p = ad.table(spark, sf, "part")
    sig = F.array(*[F.col("p_retailprice") * F.exp(-float(t) / (0.02 + F.col("p_size") / 1000.0)) for t in te])
    f = M.VoxelFitter(exponential, (1.0, 0.001), (10000.0, 1.0), 60).fit(p.select(F.col("p_partkey").alias("voxel"), sig.alias("x")), {"te": te}, (800.0, 0.05))
    return f.select("voxel", F.get("params", F.lit(0)).alias("s0"), F.get("params", F.lit(1)).alias("t2"), "rmse")


@query("mat_32_voxel_map", "i:l t1:5 m0:2", "SELECT p_partkey AS i, 0.5 + p_size / 50.0 AS t1, p_retailprice AS m0 FROM part")
def _(spark, sf):
    from ondula.functions.scalar import spgr
    p = ad.table(spark, sf, "part").select(F.lit("a").alias("subject"), F.col("p_partkey").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("k"),
                                           (0.5 + F.col("p_size") / 50.0).alias("t1"), F.col("p_retailprice").alias("m0"))
    flips = spark.createDataFrame([(v, d) for v, d in enumerate((2.0, 5.0, 10.0, 15.0))], "vol int, degrees double")
    v = p.withColumn("vol", F.explode(F.sequence(F.lit(0), F.lit(3)))).join(F.broadcast(flips), "vol")
    v = v.select("subject", "i", "j", "k", "vol", spgr(F.col("m0"), F.col("t1"), F.radians("degrees"), 0.004).alias("value"))
    return M.vfa_map(v, flips, 0.004)


@query("mat_33_basis_fit", "key:l a:4 b:4", "SELECT p_partkey AS key, 29697 * 1.206 * (1 + p_size) / 100 AS a, 29697 * 1.206 * (2 + p_partkey % 7) / 100 AS b FROM part")
def _(spark, sf):
    t = np.arange(16)
    basis = np.column_stack([np.exp(-t / 4.0), np.cos(t / 2.0)])
    p = ad.table(spark, sf, "part")
    x = F.array(*[(1 + F.col("p_size")) * float(basis[i, 0]) + (2 + F.col("p_partkey") % 7) * float(basis[i, 1]) for i in range(16)])
    return M.basis_fit(p.select(F.col("p_partkey").alias("key"), F.lit(100.0).alias("water"), x.alias("x")), basis, ["a", "b"], "key", "water")


def identity(samples, keys):
    return samples


def band(samples, keys):
    return S.band_filter(samples, 250.0, 5.0, 60.0, keys)


@query("mat_34_recovery_sweep", "cleaning signal level:1 trial:l correlation:5 snr_db:4 improvement:4")
def _(spark, sf):
    reg = Registry()
    reg.add("none", identity)
    reg.add("band", band)
    s = ad.interleaved(spark, sf)
    t = s.select("t").distinct()
    signals = t.select(F.lit("slow").alias("signal"), "t", F.sin(F.col("t") * 0.25).alias("value")).unionByName(
        t.select(F.lit("fast").alias("signal"), "t", F.sin(F.col("t") * 1.1).alias("value")))
    return recovery_sweep(s, signals, (-10.0, 0.0), reg)


@query("mat_35_variant_sweep", "variant source:l amplitude:8 peak_error:l spread:8 leakage:8",
       with_(**WEIGHTS) + ", v AS (SELECT 'plain' AS variant, i, j, v FROM w UNION ALL SELECT 'squared', i, j, v * abs(v) FROM w), m AS (SELECT variant, a.i, b.i AS j, sum(a.v * b.v) AS v FROM v a JOIN w b ON a.j = b.j GROUP BY 1, 2, 3) "
       "SELECT variant, c.j AS source, amplitude, abs(peak - c.j) AS peak_error, spread, leakage FROM (SELECT variant, j, sum(v) FILTER (i = j) AS amplitude, arg_max(i, abs(v)) AS peak, sum(v * v) FILTER (i <> j) AS spread FROM m GROUP BY 1, 2) c "
       "JOIN (SELECT variant, i, sum(v * v) FILTER (i <> j) AS leakage FROM m GROUP BY 1, 2) r USING (variant) WHERE r.i = c.j")
def _(spark, sf):
    w = weights(spark, sf)
    both = w.withColumn("variant", F.lit("plain")).unionByName(w.withColumn("v", F.col("v") * F.abs("v")).withColumn("variant", F.lit("squared")))
    return M.variant_metrics(both, w.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
