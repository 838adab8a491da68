"""Queries over the scalar column functions."""

from pyspark.sql import functions as F

from ondula.functions import complex as cx
from ondula.functions import scalar as sc
from ondula.operators.joins import label_lookup
from ondula.plans import adapters as ad
from ondula.plans.adapters import with_
from ondula.plans.registry import query


def li(spark, sf):
    """Plausible tissue values per line item: T1 0.3 - 3 s, T2 0.02 - 0.12 s, proton density, flip angle, B1."""
    return ad.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_extendedprice").alias("m0"), (F.col("l_quantity") / 20 + 0.3).alias("t1"),
        (F.col("l_discount") + 0.02).alias("t2"), (F.col("l_tax") * 5 + 0.05).alias("flip"), (F.col("l_discount") * 5 + 0.7).alias("b1"), F.col("l_tax").alias("tax"))


LI = ("WITH v AS (SELECT l_orderkey AS o, l_linenumber AS l, l_extendedprice AS m0, l_quantity / 20 + 0.3 AS t1, l_discount + 0.02 AS t2, "
      "l_tax * 5 + 0.05 AS flip, l_discount * 5 + 0.7 AS b1, l_tax AS tax FROM lineitem) ")


@query("sca_01_complex_arithmetic", "dyn:l edit:l n:l prod_re:7 prod_im:7 modulus:7 angle:6",
       with_("fids") + "SELECT dyn, edit, n, re * cos(n) - im * sin(n) AS prod_re, re * sin(n) + im * cos(n) AS prod_im, sqrt(re * re + im * im) AS modulus, atan2(-im, re) AS angle FROM fids")
def _(spark, sf):
    f = ad.fids(spark, sf).withColumn("p", cx.multiply(F.col("s"), cx.unit(F.col("n").cast("double"))))
    return f.select("dyn", "edit", "n", F.col("p.re").alias("prod_re"), F.col("p.im").alias("prod_im"), cx.modulus(F.col("s")).alias("modulus"),
                    cx.angle(cx.conjugate(F.col("s"))).alias("angle"))


def _fid_query(name, sql_re, sql_im, column):
    @query(name, "dyn:l edit:l n:l re:7 im:7", with_("fids") + f"SELECT dyn, edit, n, {sql_re} AS re, {sql_im} AS im FROM fids")
    def _(spark, sf):
        return ad.fids(spark, sf).select("dyn", "edit", "n", column().alias("s")).select("dyn", "edit", "n", "s.re", "s.im")


PH = "(2 * pi() * 3.5 * n * 0.001 + 0.4)"
_fid_query("sca_02_phase_correction", f"re * cos({PH}) - im * sin({PH})", f"re * sin({PH}) + im * cos({PH})",
           lambda: cx.shift_phase(F.col("s"), F.lit(3.5), F.lit(0.4), F.col("n") * 0.001))
EX = "exp(-pi() * 5 * n * 0.001)"
_fid_query("sca_03_exponential_window", f"re * {EX}", f"im * {EX}", lambda: sc.exponential_window(F.col("s"), F.col("n") * 0.001, 5.0))
GA = "exp(-power(pi() * 5 * n * 0.001, 2) / (4 * ln(2)))"
_fid_query("sca_04_gaussian_window", f"re * {GA}", f"im * {GA}", lambda: sc.gaussian_window(F.col("s"), F.col("n") * 0.001, 5.0))


@query("sca_05_eddy_correction", "dyn:l edit:l n:l re:6 im:6",
       with_("fids") + ", w AS (SELECT n, avg(re) + 0.5 AS wr, avg(im) AS wi FROM fids GROUP BY 1) SELECT dyn, edit, n, re * cos(atan2(wi, wr)) + im * sin(atan2(wi, wr)) AS re, "
       "im * cos(atan2(wi, wr)) - re * sin(atan2(wi, wr)) AS im FROM fids JOIN w USING (n)")
def _(spark, sf):
    f = ad.fids(spark, sf)
    w = f.groupBy("n").agg(cx.pack(F.avg("s.re") + 0.5, F.avg("s.im")).alias("s"))
    return sc.eddy_correction(f, w, ["n"]).select("dyn", "edit", "n", "s.re", "s.im")


@query("sca_06_ppm_axes", "k:l up:6 down:6",
       "WITH b AS (SELECT vec_id AS k, (SELECT count(*) FROM embeddings) AS n FROM embeddings) SELECT k, (k - n // 2) / (n * 0.0005) / 123.0 + 4.65 AS up, 4.7 - (k - n // 2) / (n * 0.0005) / 123.0 AS down FROM b")
def _(spark, sf):
    e = ad.table(spark, sf, "embeddings")
    b = e.select(F.col("vec_id").alias("k")).join(F.broadcast(e.agg(F.count("*").alias("n"))), how="inner")
    return b.select("k", sc.ppm_up(F.col("k"), F.col("n"), 0.0005, 123.0e6).alias("up"), sc.ppm_down(F.col("k"), F.col("n"), 0.0005, 123.0).alias("down"))


CONC = ("l_discount / l_quantity * ((g * 0.78 * (1 - exp(-2.0 / {g1})) * exp(-0.068 / {g2}) + w * 0.65 * (1 - exp(-2.0 / {w1})) * exp(-0.068 / {w2}) + c * 0.97 * (1 - exp(-2.0 / {c1})) * exp(-0.068 / {c2})) "
        "/ ((1 - exp(-2.0 / 1.31)) * exp(-0.068 / 0.088))) * 55556.0 / (g + w)")
LOW = dict(g1=1.33, g2=0.110, w1=0.83, w2=0.080, c1=4.16, c2=1.650)
HIGH = dict(g1=2.13, g2=0.045, w1=1.22, w2=0.027, c1=4.43, c2=0.800)


@query("sca_07_water_concentration", "o:l l:l low:4 high:4",
       f"SELECT l_orderkey AS o, l_linenumber AS l, {CONC.format(**LOW)} AS low, {CONC.format(**HIGH)} AS high FROM (SELECT *, 0.4 + l_tax AS g, 0.3 AS w, 0.3 - l_tax AS c FROM lineitem)")
def _(spark, sf):
    v = ad.table(spark, sf, "lineitem").withColumn("g", 0.4 + F.col("l_tax")).withColumn("w", F.lit(0.3)).withColumn("c", 0.3 - F.col("l_tax"))
    conc = lambda field: sc.water_concentration(F.col("l_discount"), F.col("l_quantity"), F.col("g"), F.col("w"), F.col("c"), 0.068, 2.0, 1.31, 0.088, field)
    return v.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), conc(3.0).alias("low"), conc(7.0).alias("high"))


@query("sca_08_spectral_snr", "dyn:l edit:l snr:5",
       with_("fids") + "SELECT dyn, edit, max(abs(re)) FILTER (n * 0.4 BETWEEN 2.8 AND 3.8) / stddev_pop(re) FILTER (n * 0.4 BETWEEN 8 AND 10) AS snr FROM fids GROUP BY 1, 2")
def _(spark, sf):
    f = ad.fids(spark, sf).select("dyn", "edit", F.col("n").alias("bin"), F.lit(32).alias("n"), (F.col("n") * 0.4).alias("ppm"), F.col("s.re").alias("re"))
    return sc.spectral_snr(f, ["dyn", "edit"], signal=(2.8, 3.8))


def _li_query(name, digits, sql, column):
    @query(name, f"o:l l:l value:{digits}", LI + f"SELECT o, l, {sql} AS value FROM v")
    def _(spark, sf):
        return li(spark, sf).select("o", "l", column().alias("value"))


c = F.col
_li_query("sca_09_spgr_signal", 4, "m0 * sin(flip) * (1 - exp(-0.004 / t1)) / (1 - exp(-0.004 / t1) * cos(flip))", lambda: sc.spgr(c("m0"), c("t1"), c("flip"), 0.004))
_li_query("sca_10_bssfp_signal", 4, "abs(m0 * sin(flip) * (1 - exp(-0.004 / t1)) * sqrt(exp(-0.004 / t2)) / (1 - (exp(-0.004 / t1) - exp(-0.004 / t2)) * cos(flip) - exp(-0.004 / t1) * exp(-0.004 / t2)))",
          lambda: sc.bssfp(c("m0"), c("t1"), c("t2"), c("flip"), 0.004))
_li_query("sca_11_ir_spgr_signal", 4, "m0 * sin(flip) * abs(1 - 1.95 * exp(-0.45 / t1) + exp(-0.004 / t1)) / (1 - exp(-0.004 / t1) * cos(flip))",
          lambda: sc.ir_spgr(c("m0"), c("t1"), c("flip"), 0.004, F.lit(0.45), 0.95))
_li_query("sca_12_echo_decay", 4, "m0 * exp(-0.03 / t2)", lambda: sc.echo_decay(c("m0"), c("t2"), F.lit(0.03)))
S1, S2 = "(sin(0.07) * (1 - 2 * exp(-0.7 / t1)))", "(sin(0.09) * (1 - 2 * exp(-2.5 / t1)))"
_li_query("sca_13_uniform_image", 7, f"{S1} * {S2} / ({S1} * {S1} + {S2} * {S2} + 1e-10)", lambda: sc.uniform_image(c("t1"), 0.7, 2.5, 0.07, 0.09))
_li_query("sca_14_oxygen_decay", 4, "m0 * exp(-0.05 * (1 / t2 + tax * 30))", lambda: sc.oxygen_decay(c("m0"), 1 / c("t2"), c("tax") * 30, F.lit(0.05)))
K = "(4.0 / 3.0 * pi() * 267.522e6 * 0.264e-6 * 0.42 * 0.03 * 3.0)"
_li_query("sca_15_extraction_fraction", 7, f"least(greatest(tax * 200 / {K}, 0), 1)", lambda: sc.extraction_fraction(c("tax") * 200))
CAO2 = "(15e0 * 1.34e0 * 0.98e0 / 100 / 0.0224e0)"
_li_query("sca_16_oxygen_metabolism", 9, f"t1 * 20 * tax * 5 * {CAO2} + least(greatest(m0 * tax * {CAO2}, 0), 500)",
          lambda: sc.oxygen_metabolism(c("t1") * 20, c("tax") * 5) + sc.oxygen_metabolism(c("m0"), c("tax"), clip=True))
_li_query("sca_17_b1_correction", 6, "flip * b1 + t1 * least(greatest(tan(radians(10)) / tan(radians(10) * b1), 0.5), 2)", lambda: sc.corrected_flip(c("flip"), c("b1")) + sc.corrected_t1(c("t1"), c("b1")))
_li_query("sca_18_transfer_ratio", 7, "CASE WHEN t1 > 1 AND m0 > 10 THEN least(greatest((m0 - 30000) / m0, 0), 1) ELSE 0 END", lambda: sc.transfer_ratio(c("m0"), F.lit(30000.0), c("t1") > 1))
MVF = "least(greatest(tax * 4 * 1.86, 0), 0.5)"
_li_query("sca_19_g_ratio", 7, f"CASE WHEN {MVF} > 0.01 THEN least(greatest(sqrt(1 - {MVF}), 0.5), 1) ELSE 0 END", lambda: sc.g_ratio(c("tax") * 4))
DISC = "(47.1 * 47.1 - 4 * 55.5 * (4.5 - 1 / (t2 * 4)))"
_li_query("sca_20_venous_oxygen", 6, f"CASE WHEN {DISC} >= 0 THEN (0.98 - (1 - (-47.1 + sqrt(greatest({DISC}, 0))) / 111)) / 0.98 ELSE 0.35 END", lambda: sc.venous_oxygen(c("t2") * 4)["oef"])


@query("sca_21_conductivity_lookup", "label_id:l sigma:4 n:l",
       "SELECT p_size AS label_id, CASE WHEN p_size IN (2, 41, 7, 46, 16, 13, 34) THEN 0.126 WHEN p_size IN (3, 42, 8, 47, 10, 49, 11, 50, 12, 17, 18, 26, 28) THEN 0.276 "
       "WHEN p_size IN (24, 4, 43, 5, 44, 14, 15) THEN 1.654 WHEN p_size = 30 THEN 0.7 WHEN p_size = 31 THEN 1.0 ELSE 0 END AS sigma, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, sf):
    seg = ad.table(spark, sf, "part").select(F.col("p_size").alias("label_id"))
    return label_lookup(seg, sc.conductivity_table(spark)).groupBy("label_id", "sigma").agg(F.count("*").alias("n"))


SP = lambda x: f"ln(1 + exp({x}))"


@query("sca_22_spectral_model", "o:l l:l fixed:6 knee:6",
       f"SELECT l_orderkey AS o, l_linenumber AS l, l_discount - 1.2 * log10(l_quantity) + {SP('0.3')} * exp(-power(l_quantity - 10, 2) / (2 * power({SP('2.0')}, 2))) + {SP('l_tax')} * exp(-power(l_quantity - 20, 2) / (2 * power({SP('3.0')}, 2))) AS fixed, "
       f"l_discount - log10({SP('0.5')} + power(l_quantity, {SP('1.2')})) + {SP('0.3')} * exp(-power(l_quantity - 10, 2) / (2 * power({SP('2.0')} + 0.1, 2))) + {SP('l_tax')} * exp(-power(l_quantity - 20, 2) / (2 * power({SP('3.0')} + 0.1, 2))) AS knee FROM lineitem")
def _(spark, sf):
    peak = lambda cf, pw, bw: F.struct(F.lit(cf).alias("cf"), pw.alias("pw"), F.lit(bw).alias("bw"))
    peaks = F.array(peak(10.0, F.lit(0.3), 2.0), peak(20.0, F.col("l_tax"), 3.0))
    return ad.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"),
        sc.spectral_model(F.col("l_quantity"), F.col("l_discount"), F.lit(1.2), peaks).alias("fixed"),
        sc.spectral_model(F.col("l_quantity"), F.col("l_discount"), F.lit(1.2), peaks, F.lit(0.5)).alias("knee"))


MIX = (0.8, 0.15, 0.05, 400.0, 2.0, 30.0, 20.0)
GP = "CASE WHEN {x} > 0 THEN {x} * exp(-({x}) / 30) / 900 ELSE 0 END"
PARTS = ("0.8 * exp(-power(value - 20, 2) / 800) / sqrt(2 * pi() * 400) AS g, 0.15 * (" + GP.format(x="(value - 20)") + ") AS p, 0.05 * (" + GP.format(x="(20 - value)") + ") AS q")


@query("sca_23_mixture_density", "t:l density:9 background:6 positive:6 negative:6",
       with_("esamples") + f", m AS (SELECT t, {PARTS} FROM esamples) SELECT t, g + p + q AS density, g / (g + p + q + 1e-12) AS background, p / (g + p + q + 1e-12) AS positive, q / (g + p + q + 1e-12) AS negative FROM m")
def _(spark, sf):
    e = ad.event_samples(spark, sf)
    return e.select("t", sc.mixture_density(F.col("value"), *MIX).alias("density"), sc.mixture_posteriors(F.col("value"), *MIX).alias("_p")).select("t", "density", "_p.*")


@query("sca_24_robust_z", "channel t:l z:6",
       with_("esamples") + ", q AS (SELECT channel, median(value) AS m, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 AS s FROM esamples GROUP BY 1) SELECT channel, t, (value - m) / s AS z FROM esamples JOIN q USING (channel)")
def _(spark, sf):
    return sc.robust_z(ad.event_samples(spark, sf), ["channel"])


@query("sca_25_tangent_entries", "i:l j:l v:9", with_("trade") + "SELECT src AS i, dst AS j, CASE WHEN src < dst THEN weight * sqrt(2) ELSE weight END AS v FROM trade WHERE src <= dst")
def _(spark, sf):
    return sc.tangent_entries(ad.trade(spark, sf).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("v")))


@query("sca_26_field_p", "recording p1:9 p2:9",
       with_("esamples") + ", m AS (SELECT recording, max(value) / 60 AS t FROM esamples GROUP BY 1) SELECT recording, least(3 * sqrt(4 * ln(2)) / (2 * pi()) * exp(-t * t / 2), 1) AS p1, least(3 * 4 * ln(2) / power(2 * pi(), 1.5) * exp(-t * t / 2) * t, 1) AS p2 FROM m")
def _(spark, sf):
    e = ad.event_samples(spark, sf).withColumn("value", F.col("value") / 60)
    one, two = (sc.field_p(e, ["recording"], 3.0, d).withColumnRenamed("p", f"p{d}") for d in (1, 2))
    return one.join(two.drop("top"), "recording")


@query("sca_27_signal_injection", "channel:l t:l value:7 injected:7",
       with_("samples") + ", i AS (SELECT channel, t, value, CASE WHEN channel < 8 AND t % 3 = 0 THEN (channel - 3) / 4e0 * sin(t * 0.1) ELSE 0 END AS injected FROM samples) "
       "SELECT channel, t, value + injected AS value, injected FROM i")
def _(spark, sf):
    s = ad.samples(spark, sf)
    pattern = s.select("channel").distinct().where("channel < 8").select("channel", (F.col("channel") - 3.0).alias("weight"))
    signal = s.select("t").distinct().where("t % 3 = 0").withColumn("value", F.sin(F.col("t") * 0.1))
    return sc.inject(s, signal, pattern)


@query("sca_28_window_kernels", "k:l periodic:8 closed:8 gauss:8",
       "SELECT vec_id AS k, 0.5 * (1 - cos(2 * pi() * vec_id / 64)) AS periodic, 0.5 * (1 - cos(2 * pi() * vec_id / 63)) AS closed, exp(-power(vec_id - 31.5, 2) / 200) AS gauss FROM embeddings")
def _(spark, sf):
    k = F.col("vec_id").cast("double")
    return ad.table(spark, sf, "embeddings").select(F.col("vec_id").alias("k"), sc.hann(k, 64, True).alias("periodic"), sc.hann(k, 64, False).alias("closed"),
                                                    sc.gaussian_kernel(k, 64, 10.0).alias("gauss"))
