"""Recurrence, entropy, visibility, surrogate and windowed-dynamics queries."""

import numpy as np
from pyspark.sql import functions as F

from ondula.operators import graph as G
from ondula.operators import nonlinear as N
from ondula.operators import visibility as V
from ondula.operators import windows as Wn
from ondula.operators.lines import recurrence_lines
from ondula.operators.tiles import count_within, template_counts
from ondula.plans import adapters as ad
from ondula.plans.adapters import with_
from ondula.plans.registry import query
from ondula.session import cut

DIST = ", d AS (SELECT a.t AS i, b.t AS j, sqrt(sum((a.value - b.value) ** 2)) AS e, sum(abs(a.value - b.value)) AS m, max(abs(a.value - b.value)) AS s FROM samples a JOIN samples b ON a.channel = b.channel AND a.t < b.t GROUP BY 1, 2) "


@query("nlt_01_pairwise_distance", "i:l j:l euclidean:7 manhattan:7 supremum:7", with_("samples") + DIST + "SELECT i, j, e AS euclidean, m AS manhattan, s AS supremum FROM d", many=True)
def _(spark, sf):
    f = ad.frames(spark, sf)
    return N.distance_pairs(f, ("euclidean", "manhattan", "supremum"), block=128)


@query("nlt_02_recurrence", "kind i:l j:l",
       with_("samples") + DIST + ", q AS (SELECT quantile_cont(e, 0.05) AS q FROM (SELECT e FROM d UNION ALL SELECT e FROM d UNION ALL SELECT 0.0 FROM frames)) "
       "SELECT 'fixed' AS kind, i, j FROM d WHERE s <= 0.35 UNION ALL SELECT 'rate', i, j FROM d WHERE e <= (SELECT q FROM q)")
def _(spark, sf):
    f = ad.frames(spark, sf)
    return N.recurrence(f, 0.35, metric="supremum", block=128).select(F.lit("fixed").alias("kind"), "i", "j").unionByName(
        N.recurrence(f, rate=0.05, block=128).select(F.lit("rate").alias("kind"), "i", "j"))


RP = with_("samples") + DIST + ", p AS (SELECT i, j FROM d WHERE s <= 0.35), n AS (SELECT count(*) AS n FROM frames) "


def _lines(spark, sf):
    f = ad.frames(spark, sf)
    return cut(recurrence_lines(f, 0.35, metric="supremum", block=128)), f


@query("nlt_03_recurrence_rate", "points:l recurrence_rate:8", RP + "SELECT 2 * (SELECT count(*) FROM p) AS points, 2 * (SELECT count(*) FROM p) / (n * (n - 1)) AS recurrence_rate FROM n")
def _(spark, sf):
    f = ad.frames(spark, sf)
    return N.rate_of_counts(count_within(f, 0.35, metric="supremum", block=128), f)


DIAG = ", dl AS (SELECT d, count(*) AS l FROM (SELECT j - i AS d, i, i - row_number() OVER (PARTITION BY j - i ORDER BY i) AS g FROM p) GROUP BY d, g) "
DM = ("coalesce(2 * (SELECT sum(l) FROM dl WHERE l >= 2) / (2 * (SELECT count(*) FROM p)), 0) AS determinism, coalesce((SELECT avg(l) FROM dl WHERE l >= 2), 0) AS average_diagonal_length, "
      "(SELECT max(l) FROM dl) AS max_diagonal_length, coalesce((SELECT -sum(c / t * ln(c / t)) FROM (SELECT l, count(*) AS c, sum(count(*)) OVER () AS t FROM dl WHERE l >= 2 GROUP BY 1)), 0) AS diagonal_entropy")
VERT = (", cells AS (SELECT i AS r, j AS c FROM p UNION ALL SELECT j, i FROM p UNION ALL SELECT t, t FROM frames), "
        "vl AS (SELECT c, count(*) AS l FROM (SELECT c, r, r - row_number() OVER (PARTITION BY c ORDER BY r) AS g FROM cells) GROUP BY c, g) ")
VM = ("coalesce((SELECT sum(l) FROM vl WHERE l >= 2) / (2 * (SELECT count(*) FROM p) + n), 0) AS laminarity, coalesce((SELECT avg(l) FROM vl WHERE l >= 2), 0) AS trapping_time, (SELECT max(l) FROM vl) AS max_vertical_length")


@query("nlt_04_diagonal_lines", "determinism:6 average_diagonal_length:6 max_diagonal_length:l diagonal_entropy:6", RP + DIAG + f"SELECT {DM} FROM n")
def _(spark, sf):
    lines, f = _lines(spark, sf)
    return N.diagonal_measures(lines, N.rate_of_lines(lines, f))


@query("nlt_05_vertical_lines", "laminarity:6 trapping_time:6 max_vertical_length:l", RP + VERT + f"SELECT {VM} FROM n")
def _(spark, sf):
    lines, f = _lines(spark, sf)
    return N.vertical_measures(lines, N.rate_of_lines(lines, f))


@query("nlt_06_recurrence_summary", "recurrence_rate:8 determinism:6 laminarity:6 average_diagonal_length:6 trapping_time:6 max_diagonal_length:l max_vertical_length:l diagonal_entropy:6",
       RP + DIAG + VERT + f"SELECT 2 * (SELECT count(*) FROM p) / (n * (n - 1)) AS recurrence_rate, {DM}, {VM} FROM n")
def _(spark, sf):
    return N.recurrence_measures(*_lines(spark, sf))


TEMPL = with_("samples") + (", r AS (SELECT channel, 0.2 * stddev_samp(value) AS r FROM samples GROUP BY 1), "
                            "e AS (SELECT channel, t, value AS x0, lead(value) OVER w AS x1, lead(value, 2) OVER w AS x2 FROM samples WINDOW w AS (PARTITION BY channel ORDER BY t)), "
                            "c AS (SELECT a.channel, a.t, any_value(a.x2 IS NOT NULL) AS f, count(*) AS c_all, count(b.x2) AS c_full, count(*) FILTER (abs(a.x2 - b.x2) <= r) AS c_next "
                            "FROM e a JOIN e b USING (channel) JOIN r USING (channel) WHERE a.x1 IS NOT NULL AND b.x1 IS NOT NULL AND abs(a.x0 - b.x0) <= r AND abs(a.x1 - b.x1) <= r GROUP BY 1, 2) ")
SE = "SELECT channel, -ln(greatest((sum(c_next - 1) FILTER (f) / (count(*) FILTER (f) * (count(*) FILTER (f) - 1))) / greatest(sum(c_full - 1) FILTER (f) / (count(*) FILTER (f) * (count(*) FILTER (f) - 1)), 1e-10), 1e-10)) AS sample_entropy FROM c GROUP BY 1"
AE = "SELECT channel, avg(ln(c_all)) - ln(count(*)) - (avg(ln(c_next)) FILTER (f) - ln(count(*) FILTER (f))) AS approximate_entropy FROM c GROUP BY 1"


def _counts(spark, sf):
    s = ad.samples(spark, sf)
    return template_counts(N.templates(s, block=128), N.KEY, 2)


@query("nlt_07_sample_entropy", "channel:l sample_entropy:6", TEMPL + SE)
def _(spark, sf):
    return N.sample_entropy(_counts(spark, sf))


@query("nlt_08_approximate_entropy", "channel:l approximate_entropy:6", TEMPL + AE)
def _(spark, sf):
    return N.approximate_entropy(_counts(spark, sf))


@query("nlt_09_svd_entropy", "channel:l svd_entropy:6")
def _(spark, sf):
    return N.svd_entropy(ad.samples(spark, sf), block=128)


@query("nlt_09b_svd_entropy_of_pairs", "channel:l svd_entropy:6",
       with_("samples") + "SELECT channel, -(p * log2(greatest(p, 1e-10)) + (1 - p) * log2(greatest(1 - p, 1e-10))) AS svd_entropy FROM (SELECT channel, sqrt(m + h) / (sqrt(m + h) + sqrt(m - h)) AS p "
       "FROM (SELECT channel, (a + b) / 2 AS m, sqrt(((a - b) / 2) ** 2 + c ** 2) AS h FROM (SELECT x.channel, sum(x.value ** 2) AS a, sum(y.value ** 2) AS b, sum(x.value * y.value) AS c "
       "FROM samples x JOIN samples y ON y.channel = x.channel AND y.t = x.t + 2 GROUP BY 1)))")
def _(spark, sf):
    return N.svd_entropy(ad.samples(spark, sf), dim=2, block=128)


SPECTRAL = (", n AS (SELECT max(t) + 1 AS n FROM samples), f AS (SELECT channel, k, power(sum(value * cos(2 * pi() * ((k * t) % n) / n)), 2) + power(sum(value * sin(2 * pi() * ((k * t) % n) / n)), 2) AS p FROM samples, n, "
            "(SELECT unnest(range(1, (SELECT n // 2 + 1 FROM n))) AS k) GROUP BY 1, 2), q AS (SELECT channel, p / sum(p) OVER (PARTITION BY channel) AS p FROM f) ")


@query("nlt_10_spectral_entropy", "channel:l spectral_entropy:6", with_("samples") + SPECTRAL + "SELECT channel, -sum(p * log2(greatest(p, 1e-10))) AS spectral_entropy FROM q GROUP BY 1")
def _(spark, sf):
    return N.spectral_entropy(ad.samples(spark, sf), limit=100)


@query("nlt_11_all_entropies", "channel:l sample_entropy:6 approximate_entropy:6 spectral_entropy:6",
       TEMPL + SPECTRAL.replace("f AS (", "ff AS (").replace("FROM f)", "FROM ff)") + f"SELECT * FROM ({SE}) JOIN ({AE}) USING (channel) JOIN (SELECT channel, -sum(p * log2(greatest(p, 1e-10))) AS spectral_entropy FROM q GROUP BY 1) USING (channel)")
def _(spark, sf):
    return N.all_entropies(ad.samples(spark, sf), block=128)


VG = {"natural": with_("series") + ", p AS (SELECT a.channel, a.t AS i, b.t AS j, (b.value - a.value) / (b.t - a.t) AS s FROM series a JOIN series b ON a.channel = b.channel AND a.t < b.t), "
                 "m AS (SELECT *, max(s) OVER (PARTITION BY channel, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p), e AS (SELECT channel, i, j FROM m WHERE b IS NULL OR s > b) ",
      "horizontal": with_("series") + ", p AS (SELECT a.channel, a.t AS i, b.t AS j, a.value AS x, b.value AS y FROM series a JOIN series b ON a.channel = b.channel AND a.t < b.t), "
                    "m AS (SELECT *, max(y) OVER (PARTITION BY channel, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p), e AS (SELECT channel, i, j FROM m WHERE b IS NULL OR (b < x AND b < y)) "}


def _edges(spark, sf, kind):
    return V.visibility_edges(ad.series(spark, sf), kind, block=256)


@query("nlt_12_natural_visibility", "channel i:l j:l", VG["natural"] + "SELECT * FROM e")
def _(spark, sf):
    return _edges(spark, sf, "natural")


@query("nlt_13_horizontal_visibility", "channel i:l j:l", VG["horizontal"] + "SELECT * FROM e")
def _(spark, sf):
    return _edges(spark, sf, "horizontal")


DEG = ", dg AS (SELECT channel, node, count(*) AS degree FROM (SELECT channel, i AS node FROM e UNION ALL SELECT channel, j FROM e) GROUP BY 1, 2) "


@query("nlt_14_visibility_degrees", "channel degree:l n:l mean_degree:6",
       VG["natural"] + DEG + "SELECT channel, degree, count(*) AS n, any_value(m) AS mean_degree FROM dg JOIN (SELECT channel, avg(degree) AS m FROM dg GROUP BY 1) USING (channel) GROUP BY 1, 2")
def _(spark, sf):
    s = ad.series(spark, sf)
    e = cut(V.visibility_edges(s, "natural", block=256))
    return V.degree_distribution(V.degrees(e)).join(V.mean_degree(e, s), ["recording", "channel"])


@query("nlt_15_assortativity", "channel assortativity:6 clustering:6",
       VG["horizontal"] + DEG + ", u AS (SELECT channel, i, j FROM e UNION ALL SELECT channel, j, i FROM e), tri AS (SELECT a.channel, a.i AS node, count(*) AS n FROM u a JOIN u b ON a.channel = b.channel AND a.i = b.i AND a.j <> b.j "
       "JOIN u c ON c.channel = a.channel AND c.i = a.j AND c.j = b.j GROUP BY 1, 2), cl AS (SELECT channel, avg(CASE WHEN degree > 1 THEN coalesce(n, 0) / (degree * (degree - 1)) ELSE 0 END) AS c FROM dg LEFT JOIN tri USING (channel, node) GROUP BY 1) "
       "SELECT channel, coalesce(corr(x.degree, y.degree), 0) AS assortativity, any_value(c) AS clustering FROM e JOIN dg x USING (channel) JOIN dg y USING (channel) JOIN cl USING (channel) WHERE x.node = e.i AND y.node = e.j GROUP BY 1")
def _(spark, sf):
    s = ad.series(spark, sf)
    e = cut(V.visibility_edges(s, "horizontal", block=256))
    both = e.select(F.col("channel").alias("graph"), F.col("i").alias("src"), F.col("j").alias("dst")).unionByName(
        e.select(F.col("channel").alias("graph"), F.col("j").alias("src"), F.col("i").alias("dst")))
    cl = G.global_clustering(both, s.select(F.col("channel").alias("graph"), F.col("t").alias("node"))).withColumnRenamed("graph", "channel")
    return V.assortativity(e, V.degrees(e)).join(cl, "channel")


SAME = "SELECT channel, count(*) AS n, sum(value) AS total, sum(value * value) AS energy, min(t) AS first, max(t) AS last, count(DISTINCT t) AS times FROM series GROUP BY 1"


def _same(df):
    return df.groupBy("channel").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") ** 2).alias("energy"),
                                     F.min("t").alias("first"), F.max("t").alias("last"), F.count_distinct("t").alias("times"))


@query("nlt_16_shuffle_surrogate", "channel n:l total:3 energy:2 first:l last:l times:l", with_("series") + SAME)
def _(spark, sf):
    return _same(N.shuffle(ad.series(spark, sf), 3))


@query("nlt_17_block_shuffle_surrogate", "channel n:l total:3 energy:2 first:l last:l times:l", with_("series") + SAME)
def _(spark, sf):
    return _same(N.block_shuffle(ad.series(spark, sf), 50, 3))


@query("nlt_18_phase_randomised", "channel k:l magnitude:3",
       with_("series", "sn") + ", f AS (SELECT channel, k, sqrt(power(sum(value * cos(2 * pi() * ((k * t) % n) / n)), 2) + power(sum(value * sin(2 * pi() * ((k * t) % n) / n)), 2)) AS magnitude FROM series JOIN sn USING (channel), "
       "(SELECT unnest(range((SELECT max(n) // 2 + 1 FROM sn))) AS k) WHERE k <= n // 2 GROUP BY 1, 2) SELECT * FROM f")
def _(spark, sf):
    from ondula.operators.spectral import spectrum
    return spectrum(N.phase_randomise(ad.series(spark, sf), 5, limit=512), 1.0, limit=512).withColumn("magnitude", F.hypot("re", "im"))


@query("nlt_19_amplitude_adjusted", "channel n:l total:3 energy:2 first:l last:l times:l", with_("series") + SAME)
def _(spark, sf):
    return _same(N.amplitude_adjusted(ad.series(spark, sf), 5))


@query("nlt_20_surrogate_test", "channel observed:6 p:4 significant:b")
def _(spark, sf):
    return N.surrogate_test(ad.series(spark, sf), lambda d, k: N.shuffle(d, 1, k), N.lag_one_correlation, 20)


@query("nlt_21_path_signature", "win:l n:l s_time:6 s_a:8 s_time_a:8 s_a_b:9",
       with_("frames") + ", w AS (SELECT win, t - win * 20 AS p, x[1] AS a, x[2] AS b FROM frames, (SELECT unnest(range((SELECT (max(t) + 1 - 50) // 20 + 1 FROM frames))) AS win) WHERE t >= win * 20 AND t < win * 20 + 50), "
       "d AS (SELECT win, p, a - first(a) OVER o AS a0, lead(a) OVER o - a AS da, lead(b) OVER o - b AS db, p / 49.0 AS u FROM w WINDOW o AS (PARTITION BY win ORDER BY p)) "
       "SELECT win, 39 AS n, 1.0 AS s_time, sum(da) AS s_a, sum(u * da + da / 98) AS s_time_a, sum(a0 * db + da * db / 2) AS s_a_b FROM d WHERE da IS NOT NULL GROUP BY 1")
def _(spark, sf):
    f = ad.frames(spark, sf).withColumn("x", F.slice("x", 1, 2))
    s = N.path_signatures(f, 50, 20, 3)
    at = lambda k, n: F.get("x", F.lit(k)).alias(n)
    return s.select("win", F.size("x").alias("n"), at(0, "s_time"), at(1, "s_a"), at(3 + 1, "s_time_a"), at(3 + 3 + 2, "s_a_b"))


@query("nlt_22_log_signature_changes", "win:l centre:l distance:5 change:b")
def _(spark, sf):
    return N.log_signature_changes(ad.frames(spark, sf), 50, 20, 3)


@query("nlt_23_dynamic_modes", "win:l rank:l freq:4 growth:4")
def _(spark, sf):
    return N.dynamic_modes(ad.frames(spark, sf), 100, 50, 4, 0.004)


@query("nlt_24_sparse_dynamics", "win:l max_real:5 n_terms:l")
def _(spark, sf):
    return N.sparse_dynamics(ad.frames(spark, sf), 100, 50, 3).withColumn("n_terms", F.size("coefficients"))


@query("nlt_25_stability_share", "recording stable_share:6 median_freq:7",
       with_("frames") + "SELECT recording, avg(CAST(x[1] < 0 AS DOUBLE)) AS stable_share, median(abs(x[2])) AS median_freq FROM frames GROUP BY 1")
def _(spark, sf):
    f = ad.frames(spark, sf)
    modes = f.select("recording", F.lit(1).alias("rank"), F.abs(F.get("x", F.lit(1))).alias("freq"))
    return N.stability_share(f.select("recording", F.get("x", F.lit(0)).alias("max_real")), modes)


def lag_product(x: np.ndarray, seed: int) -> float:
    """A user statistic: mean product of neighbours after a seeded shuffle."""
    y = np.random.default_rng(seed).permutation(x) if seed else x
    return float(np.mean(y[1:] * y[:-1])) if len(y) > 1 else 0.0


@query("udf_01_user_statistic", "win:l channel:l seed:l value:8",
       with_("samples") + ", w AS (SELECT win, t, channel, value FROM samples, (SELECT unnest(range((SELECT (max(t) + 1 - 100) // 100 + 1 FROM samples))) AS win) WHERE t >= win * 100 AND t < win * 100 + 100), "
       "p AS (SELECT win, channel, value * lead(value) OVER (PARTITION BY win, channel ORDER BY t) AS v FROM w) SELECT win, channel, 0 AS seed, avg(v) AS value FROM p GROUP BY 1, 2")
def _(spark, sf):
    s = Wn.slide(ad.samples(spark, sf), 100, 100).withColumn("seed", F.lit(0))
    return N.user_statistic(s, lag_product, ["recording", "channel", "win", "seed"])
