"""Source, sink and projection queries. File names and text lines are built from the tables."""

import gzip
import io
import tarfile

import pandas as pd
from pyspark.sql import functions as F

from ondula.operators import projections as P
from ondula.plans import adapters as ad
from ondula.plans.adapters import with_
from ondula.plans.registry import query
from ondula.session import fresh_folder
from ondula.sources import arrays, catalog, npy, sinks, text

NAMES = ("rec/sflip_parc.npy", "run-1_preproc-raw.fif", "task-rest_run-2_meg.dat", "task-rest_run-2_meg.hdr", "atlas-aal_desc-sift2_connectivity.csv",
         "atlas-aal_desc-count_connectivity.csv", "atlas-dk.v2_desc-siftcount_connectivity.csv", "atlas-aal_desc-meanlength_connectivity.csv",
         "task-RestingState_eeg.set", "task-movie_run-1_eeg.set")
LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
FILES = (f"WITH files AS MATERIALIZED (SELECT '/d/sub-' || o_custkey || '/ses-1/sub-' || o_custkey || '_' || {LIST}[1 + o_orderkey % 10] AS path, "
         "CAST(o_totalprice AS BIGINT) % 3000 AS length FROM orders) ")


def files(spark, sf):
    """A file catalog with one file per order, named by customer and order key."""
    o = ad.table(spark, sf, "orders")
    sub = F.concat(F.lit("/d/sub-"), F.col("o_custkey"), F.lit("/ses-1/sub-"), F.col("o_custkey"), F.lit("_"))
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("o_orderkey") % 10).cast("int"))
    return o.select(F.concat(sub, name).alias("path"), (F.rint("o_totalprice").cast("bigint") % 3000).alias("length"))  # halves to even, as the SQL's cast


def _array_name(path):
    """The name of an array file without folders and ending. A regular expression for it would search each path anew from every letter, for every cell."""
    name = F.substring_index(path, "/", -1)
    return F.substring(name, F.lit(1), F.length(name) - 4)


@query("src_01_recording_scan", "recording n_t:l n_channels:l total:6",
       with_("samples4") + "SELECT recording, count(DISTINCT t) AS n_t, 64 AS n_channels, sum(value) AS total FROM samples4 GROUP BY 1")
def _(spark, sf):
    folder = fresh_folder(spark, "arrays")
    arrays.write_arrays(ad.frames(spark, sf, split=True), folder)
    per = arrays.array_frames(spark, folder).withColumn("recording", _array_name("recording"))
    return per.groupBy("recording").agg(F.count("t").alias("n_t"), F.max(F.size("x")).alias("n_channels"),
                                        F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query("src_02_parcellated_files", "path", FILES + "SELECT path FROM files WHERE path LIKE '%/sflip_parc.npy'")
def _(spark, sf):
    return catalog.parcellated_files(files(spark, sf))


@query("src_03_preprocessed_files", "path", FILES + "SELECT path FROM files WHERE path LIKE '%\\_preproc-raw.fif' ESCAPE '\\'")
def _(spark, sf):
    return catalog.preprocessed_files(files(spark, sf))


@query("src_04_subjects", "subject", "SELECT DISTINCT 'sub-' || o_custkey AS subject FROM orders")
def _(spark, sf):
    return catalog.subjects(files(spark, sf))


@query("src_05_tasks_runs", "subject task run:l",
       FILES + "SELECT DISTINCT regexp_extract(path, '/(sub-[^/]+)/', 1) AS subject, regexp_extract(path, 'task-([^_.]+)', 1) AS task, "
       "TRY_CAST(regexp_extract(path, 'run-([0-9]+)', 1) AS INTEGER) AS run FROM files WHERE path LIKE '%task-%'")
def _(spark, sf):
    return catalog.tasks(files(spark, sf))


@query("src_06_availability", "recording available:b",
       FILES + "SELECT regexp_replace(path, '\\.[^./]+$', '') AS recording, bool_and(length > 1000) AND count(DISTINCT path) = 2 AS available "
       "FROM files WHERE path LIKE '%.dat' OR path LIKE '%.hdr' GROUP BY 1")
def _(spark, sf):
    return catalog.availability(files(spark, sf), "dat", "hdr")


def files_of(spark, lines, headers):
    """The folder of text files, one per ``file`` of ``file, line_no, line``, written by as many tasks; each begins with its header."""
    path = fresh_folder(spark, "text")
    whole = lines.select("file", "line_no", "line").unionByName(headers.select("file", F.lit(-1).cast("bigint").alias("line_no"), "line"))
    whole.repartition("file").sortWithinPartitions("file", "line_no").select("file", "line").write.partitionBy("file").text(path)
    return path


FILE_ROWS = 256


def _file_name(path="path"):
    return F.regexp_extract(path, "file=([^/]+)/", 1)


@query("src_07_matrix_scan", "path i:l j:l v:6",
       f"SELECT 'm' || vec_id // {FILE_ROWS} AS path, row_number() OVER (PARTITION BY vec_id // {FILE_ROWS} ORDER BY vec_id) - 1 AS i, unnest(range(64)) AS j, "
       "unnest(list_transform(embedding, lambda v: CAST(printf('%.6f', CAST(v AS DOUBLE)) AS DOUBLE))) AS v FROM embeddings")
def _(spark, sf):
    rows = ad.frames(spark, sf).select(F.concat(F.lit("m"), F.floor(F.col("t") / FILE_ROWS)).alias("file"), F.col("t").alias("line_no"), F.array_join(
        F.transform("x", lambda v: F.format_string("%.6f", v)), ",").alias("line"))
    headers = rows.select("file").distinct().where(F.crc32("file") % 2 == 0).withColumn("line", F.lit(",".join(f"c{k}" for k in range(64))))
    return text.matrix_scan(spark, files_of(spark, rows, headers), "part-*").withColumn("path", _file_name())


@query("src_07b_array_matrix_scan", "path i:l j:l v:6",
       f"SELECT 'm' || vec_id // {FILE_ROWS} AS path, row_number() OVER (PARTITION BY vec_id // {FILE_ROWS} ORDER BY vec_id) - 1 AS i, unnest(range(64)) AS j, "
       "unnest(embedding) AS v FROM embeddings")
def _(spark, sf):
    folder = fresh_folder(spark, "arrays")
    arrays.write_arrays(ad.frames(spark, sf).withColumn("recording", F.concat(F.lit("m"), F.floor(F.col("t") / FILE_ROWS))), folder)
    return text.matrix_scan(spark, folder).withColumn("path", _array_name("path"))


@query("src_08_region_labels", "path region:l label",
       f"SELECT 'l' || p_partkey // {FILE_ROWS} AS path, row_number() OVER (PARTITION BY p_partkey // {FILE_ROWS} ORDER BY p_partkey) - 1 AS region, p_brand AS label FROM part")
def _(spark, sf):
    p = ad.table(spark, sf, "part").select(F.concat(F.lit("l"), F.floor(F.col("p_partkey") / FILE_ROWS)).alias("file"), F.col("p_partkey").cast("bigint").alias("line_no"),
                                           F.concat_ws("\t", "p_partkey", "p_type", "p_brand").alias("line"))
    headers = p.select("file").distinct().withColumn("line", F.lit("key\ttype\tlabel"))
    return text.label_scan(spark, files_of(spark, p, headers), "part-*").withColumn("path", _file_name())


@query("src_09_atlases", "atlas", FILES + "SELECT DISTINCT regexp_extract(path, 'atlas-([^_.]+)', 1) AS atlas FROM files WHERE path LIKE '%\\_connectivity.%' ESCAPE '\\'")
def _(spark, sf):
    return catalog.atlases(files(spark, sf))


@query("src_10_preferred_matrix", "subject atlas variant weights lengths delays",
       FILES + ", c AS (SELECT regexp_extract(path, '(sub-[^/_]+)', 1) AS subject, regexp_extract(path, 'atlas-([^_.]+)', 1) AS atlas, "
       "regexp_extract(path, 'desc-([^_.]+)', 1) AS d, path FROM files WHERE path LIKE '%connectivity.%'), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY subject, atlas ORDER BY list_position(['sift2', 'siftcount', 'count'], d), path) AS k FROM c "
       "WHERE d IN ('sift2', 'siftcount', 'count')), l AS (SELECT subject, atlas, min(path) AS lengths FROM c WHERE d = 'meanlength' GROUP BY 1, 2) "
       "SELECT subject, atlas, d AS variant, path AS weights, lengths, NULL AS delays FROM r LEFT JOIN l USING (subject, atlas) WHERE k = 1")
def _(spark, sf):
    return catalog.preferred_matrix(files(spark, sf))


@query("src_11_normalised_weights", "src:l dst:l weight:9", with_("trade0") + "SELECT src, dst, raw / (SELECT max(raw) FROM trade0) AS weight FROM trade0")
def _(spark, sf):
    return P.normalise_weights(ad.trade(spark, sf))


@query("src_12_skipped_subjects", "subject",
       "SELECT c_custkey AS subject FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, sf):
    return catalog.skipped_subjects(ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject")),
                                    ad.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("subject")))


@query("src_13_delays", "src:l dst:l delay:6",
       with_("trade") + "SELECT src, dst, CASE WHEN src < dst THEN weight WHEN src % 2 = 0 THEN (src + dst) / 7.0 ELSE 0 END AS delay FROM trade")
def _(spark, sf):
    e = ad.trade(spark, sf).withColumn("delay", F.when(F.col("src") < F.col("dst"), F.col("weight"))).withColumn(
        "length", F.when(F.col("src") % 2 == 0, (F.col("src") + F.col("dst")).cast("double")))
    return P.resolve_delays(e)


def archives_of(spark, lines):
    """The folder of one tar archive per ``archive`` with a compressed text per trial, from ``archive, trial, line_no, line``."""
    folder = fresh_folder(spark, "archives")

    def put(key, pdf):
        store, path, _ = npy.open_store(folder)
        store.create_dir(path, recursive=True)
        body = io.BytesIO()
        with tarfile.open(fileobj=body, mode="w:gz") as tar:
            for trial, rows in pdf.groupby("trial"):
                raw = gzip.compress("\n".join(rows.sort_values("line_no")["line"]).encode())
                info = tarfile.TarInfo(f"{trial}.rd.gz")
                info.size = len(raw)
                tar.addfile(info, io.BytesIO(raw))
        with store.open_output_stream(f"{path}/{key[0]}.tar.gz", compression=None) as out:
            out.write(body.getvalue())
        return pd.DataFrame({"n": [len(pdf)]})

    lines.groupBy("archive").applyInPandas(put, "n bigint").agg(F.sum("n")).first()  # an archive holds the trials of one subject
    return folder


@query("src_14_trial_ingest", "archive trial channel t:l value:2",
       "SELECT 'u' || user_id || '.tar.gz' AS archive, 'x.rd.gz' AS trial, event_type AS channel, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS t, value FROM events "
       "WHERE event_id % 11 <> 0")
def _(spark, sf):
    e = ad.table(spark, sf, "events")
    line = F.when(F.col("event_id") % 11 == 0, F.lit("# comment 1 2 3")).otherwise(
        F.concat_ws(" ", F.lit("0"), "event_type", F.lit("0"), F.col("value").cast("string")))
    rows = e.select(F.concat(F.lit("u"), "user_id").alias("archive"), F.lit("x").alias("trial"), F.col("event_id").alias("line_no"), line.alias("line"))
    return arrays.parse_trials(arrays.trial_lines(spark, archives_of(spark, rows)))


@query("src_15_common_length", "recording channel t:l value:4",
       with_("esamples") + ", r AS (SELECT *, row_number() OVER (PARTITION BY recording, channel ORDER BY t) - 1 AS k FROM esamples) "
       "SELECT recording, channel, k AS t, value FROM r WHERE k < (SELECT min(n) FROM (SELECT max(k) + 1 AS n FROM r GROUP BY recording, channel))")
def _(spark, sf):
    from pyspark.sql import Window as W
    w = W.partitionBy("recording", "channel").orderBy("t")
    s = ad.event_samples(spark, sf).withColumn("k", F.row_number().over(w) - 1).drop("t").withColumnRenamed("k", "t")
    return P.trim_to_shortest(s, ["recording", "channel"])


@query("src_16_condition_from_name", "archive condition n:l",
       "SELECT p_name AS archive, CASE WHEN p_name LIKE '%a\\_m%' ESCAPE '\\' OR p_name LIKE '%c\\_m%' ESCAPE '\\' THEN 'matched' ELSE 'non-matched' END AS condition, count(*) AS n "
       "FROM (SELECT replace(p_name, ' ', '_') AS p_name FROM part) GROUP BY 1, 2")
def _(spark, sf):
    p = ad.table(spark, sf, "part").select(F.regexp_replace("p_name", " ", "_").alias("archive"))
    return p.withColumn("condition", catalog.matched_condition()).groupBy("archive", "condition").agg(F.count("*").alias("n"))


@query("src_17_event_table", "recording onset:2 duration:2 trial_type",
       "SELECT 'u' || user_id % 16 AS recording, event_id AS onset, value AS duration, event_type AS trial_type FROM events WHERE event_id % 7 <> 0")
def _(spark, sf):
    e = ad.table(spark, sf, "events")
    line = F.when(F.col("event_id") % 7 == 0, F.col("event_id").cast("string")).otherwise(F.concat_ws("\t", "event_id", "value", "event_type"))
    rows = e.select(F.concat(F.lit("u"), F.col("user_id") % 16).alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))
    headers = rows.select("file").distinct().withColumn("line", F.lit("onset\tduration\ttrial_type"))
    return text.event_scan(spark, files_of(spark, rows, headers), "part-*").withColumn("recording", _file_name("recording"))


@query("src_18_structure_stats", "path name value:2",
       "SELECT 'a' AS path, p_name AS name, p_retailprice AS value FROM (SELECT replace(p_name, ' ', '_') AS p_name, p_retailprice FROM part) UNION ALL SELECT 'a', s_name, s_acctbal FROM supplier")
def _(spark, sf):
    p = ad.table(spark, sf, "part").select(F.concat_ws(" ", "p_partkey", "p_size", "p_size", "p_retailprice", F.regexp_replace("p_name", " ", "_")).alias("line"))
    s = ad.table(spark, sf, "supplier").select(F.concat_ws(", ", F.lit("# Measure Brain"), "s_name", F.lit("volume"), F.col("s_acctbal").cast("string"), F.lit("mm^3")).alias("line"))
    return text.structure_stats(p.unionByName(s).withColumn("path", F.lit("a")))


@query("src_19_cortical_stats", "name area:4 volume:4 thickness:4 thickness_std:4",
       "SELECT o_orderkey AS name, o_custkey AS area, o_totalprice AS volume, o_orderkey % 5 AS thickness, o_custkey % 3 AS thickness_std FROM orders")
def _(spark, sf):
    o = ad.table(spark, sf, "orders")
    c = lambda n: F.col(n).cast("string")
    line = F.concat_ws(" ", c("o_orderkey"), F.lit("1"), c("o_custkey"), c("o_totalprice"), (F.col("o_orderkey") % 5).cast("string"),
                       (F.col("o_custkey") % 3).cast("string"), F.lit("0 0 0 0"))
    return text.cortical_stats(o.select(F.lit("lh").alias("path"), line.alias("line")))


@query("src_20_topology_holes", "path hemi holes:l",
       "SELECT o_custkey AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'lh' ELSE 'rh' END AS hemi, arg_max(o_orderkey % 97, o_orderkey) AS holes FROM "
       "(SELECT o_custkey, o_orderkey FROM orders) GROUP BY 1, 2")
def _(spark, sf):
    o = ad.table(spark, sf, "orders")
    line = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "lh").otherwise("rh"), F.lit(".orig.nofix has "), F.col("o_orderkey") % 97, F.lit(" holes"))
    return text.topology_holes(o.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("line_no"), line.alias("line")))


@query("src_21_head_shape", "point x:4 y:4 z:4",
       "SELECT ['EXTRA', 'Nasion', 'LPA', 'RPA'][1 + c_custkey % 5] AS point, c_nationkey AS x, c_acctbal AS y, c_custkey AS z FROM customer WHERE c_custkey % 5 < 4")
def _(spark, sf):
    c = ad.table(spark, sf, "customer")
    name = F.get(F.array(*[F.lit(n) for n in ("EXTRA", "Nasion", "LPA", "RPA", "other")]), (F.col("c_custkey") % 5).cast("int"))
    return text.head_shape(c.select(F.lit("p").alias("path"), F.concat_ws(" ", name, *[F.col(n).cast("string") for n in ("c_nationkey", "c_acctbal", "c_custkey")]).alias("line")))


@query("src_22_volume_selection", "vol:l n:l total:4",
       "SELECT l_linenumber AS vol, count(*) AS n, sum(l_quantity) AS total FROM lineitem WHERE l_linenumber IN (1, 3) GROUP BY 1")
def _(spark, sf):
    v = ad.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("vol"), F.col("l_quantity").alias("value"))
    return P.select_volumes(v, [1, 3]).groupBy("vol").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("src_23_reorientation", "i:l j:l k:l value:4",
       "SELECT l_partkey AS i, l_orderkey AS j, l_linenumber AS k, l_quantity AS value FROM lineitem")
def _(spark, sf):
    v = ad.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").cast("bigint").alias("j"),
                                               F.col("l_partkey").alias("k"), F.col("l_quantity").alias("value"))
    a = [[0.1, 0.2, -2.0], [1.5, 0.0, 0.3], [0.2, -1.1, 0.1]]
    affine = spark.createDataFrame([(w, c, a[w][c]) for w in range(3) for c in range(3)], "world int, axis int, a double")
    return P.reorient(v, affine)


@query("src_24_fast_series", "name rate:4",
       "SELECT 'c' || c_custkey AS name, c_acctbal AS rate FROM customer WHERE c_acctbal >= 5000 UNION ALL SELECT 's' || s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= 5000")
def _(spark, sf):
    c = ad.table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.col("c_acctbal").alias("rate"))
    s = ad.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.col("s_acctbal").alias("rate"))
    return catalog.fast_series(c, s, 5000.0)


@query("src_25_asset_prefix", "path", FILES + "SELECT path FROM files WHERE path LIKE '/d/sub-1%'")
def _(spark, sf):
    return catalog.assets_below(files(spark, sf), "/d/sub-1")


@query("src_26_task_file", "subject path",
       FILES + "SELECT subject, min(path) AS path FROM (SELECT regexp_extract(path, '(sub-[^/_]+)', 1) AS subject, path FROM files WHERE path LIKE '%.set' AND path LIKE '%movie%' AND path LIKE '%run-1%') GROUP BY 1")
def _(spark, sf):
    return catalog.task_file(files(spark, sf), "movie", 1)


def _written(spark, kind, write):
    """A fresh folder below the session's checkpoint folder for a sink query."""
    path = fresh_folder(spark, f"sink-{kind}")
    write(path)
    return path


@query("snk_01_stats_csv", "name mean:6 n:l", "SELECT p_brand AS name, avg(p_retailprice) AS mean, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    s = ad.table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.avg("p_retailprice").alias("mean"), F.count("*").alias("n"))
    p = _written(spark, "stats", lambda path: sinks.write_stats(s, path))
    return spark.read.schema("name string, mean double, n bigint").option("header", True).csv(p)


@query("snk_02_comparison_csv", "tissue tool mean:6",
       "SELECT p_type AS tissue, p_brand AS tool, avg(p_retailprice) AS mean FROM part WHERE p_size < 49 GROUP BY 1, 2 HAVING avg(p_retailprice) IS NOT NULL")
def _(spark, sf):
    p = ad.table(spark, sf, "part")
    s = p.groupBy(F.col("p_type").alias("tissue"), F.col("p_brand").alias("tool")).agg(F.avg(F.when(F.col("p_size") < 49, F.col("p_retailprice"))).alias("mean"))
    out = _written(spark, "comparison", lambda path: sinks.write_comparison(s, path))
    return spark.read.schema("tissue string, tool string, mean double").option("header", True).csv(out)


@query("snk_03_quality_json_tsv", "recording n_noisy:l json_rows:l",
       with_("esamples") + ", c AS (SELECT recording, count(*) AS n FROM esamples WHERE value > 100 GROUP BY 1) SELECT recording, n AS n_noisy, (SELECT count(*) FROM c) AS json_rows FROM c")
def _(spark, sf):
    r = ad.event_samples(spark, sf).where("value > 100").groupBy("recording").agg(
        F.count("*").alias("n_noisy"), F.collect_set("channel").alias("noisy_channels"), F.array().cast("array<string>").alias("flat_channels"))
    base = _written(spark, "quality", lambda path: sinks.write_quality(r, path + "/json", path + "/tsv"))
    n = spark.read.schema("recording string, n_noisy bigint, noisy_channels array<string>").json(base + "/json").count()
    return spark.read.schema("recording string, n_noisy bigint").option("sep", "\t").option("header", True).csv(base + "/tsv").withColumn("json_rows", F.lit(n))


@query("snk_04_series_sink", "subject task n:l total:4", with_("esamples") + "SELECT recording AS subject, channel AS task, count(*) AS n, sum(value) AS total FROM esamples GROUP BY 1, 2")
def _(spark, sf):
    s = ad.event_samples(spark, sf).withColumnRenamed("recording", "subject").withColumnRenamed("channel", "task")
    s = s.withColumn("hour", F.col("t")).where("true")
    p = _written(spark, "series", lambda path: sinks.write_series(s.withColumn("task", F.col("task")), path, ("task",)))
    return spark.read.schema("subject string, t bigint, value double, task string").parquet(p).groupBy("subject", "task").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"))


# ------------------------------------------------------------------ projections


@query("prj_01_channel_pick", "recording channel n:l",
       with_("esamples") + "SELECT recording, channel, count(*) AS n FROM esamples WHERE channel IN ('click', 'view') AND recording NOT IN ('u3', 'u5') GROUP BY 1, 2")
def _(spark, sf):
    s = ad.event_samples(spark, sf)
    ch = s.select("recording", "channel").distinct().withColumn("kind", F.when(F.col("channel").isin("click", "view"), "meg").otherwise("eog")).withColumn(
        "bad", F.col("recording").isin("u3", "u5"))
    return P.pick_channels(s, ch, kinds=["meg"]).groupBy("recording", "channel").agg(F.count("*").alias("n"))


@query("prj_02_time_crop", "channel n:l first:l last:l",
       with_("esamples") + "SELECT channel, count(*) AS n, min(t) AS first, max(t) AS last FROM esamples WHERE t BETWEEN 100 AND 400 GROUP BY 1")
def _(spark, sf):
    return P.crop(ad.event_samples(spark, sf), 10.0, 40.0, fs=10.0).groupBy("channel").agg(
        F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("prj_03_valid_values", "map n:l total:4", with_("voxels") + "SELECT map, count(*) AS n, sum(value) AS total FROM voxels WHERE value <> 0 AND value BETWEEN 0.02 AND 5000 GROUP BY 1")
def _(spark, sf):
    from ondula.operators.aggregates import valid_values
    return valid_values(ad.voxels(spark, sf), low=0.02, high=5000).groupBy("map").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


STANDARD = "(value - m) / CASE WHEN s > 0 THEN s ELSE 1 END"


@query("prj_04_standardise", "recording channel t:l value:6",
       with_("esamples") + f", q AS (SELECT recording, channel, avg(value) AS m, stddev_pop(value) AS s FROM esamples GROUP BY 1, 2) SELECT recording, channel, t, {STANDARD} AS value FROM esamples JOIN q USING (recording, channel)")
def _(spark, sf):
    return P.standardise(ad.event_samples(spark, sf))


@query("prj_05_log_standardise", "channel t:l value:6",
       with_("esamples") + f", l AS (SELECT channel, t, ln(value + 1e-6) AS value FROM esamples), q AS (SELECT channel, avg(value) AS m, stddev_pop(value) AS s FROM l GROUP BY 1) SELECT channel, t, {STANDARD} AS value FROM l JOIN q USING (channel)")
def _(spark, sf):
    return P.log_standardise(ad.event_samples(spark, sf), ["channel"])


@query("prj_06_sign_flip", "recording channel t:l value:4",
       with_("esamples") + "SELECT recording, channel, t, CASE WHEN channel IN ('click', 'error') THEN -value ELSE value END AS value FROM esamples")
def _(spark, sf):
    s = ad.event_samples(spark, sf)
    signs = s.select("channel").distinct().withColumn("sign", F.when(F.col("channel").isin("click", "error"), -1.0).otherwise(1.0))
    return P.flip_signs(s, signs, ["channel"])


@query("prj_07_soft_threshold", "t:l channel:l value:7 modulus:7",
       with_("fids") + "SELECT dyn * 2 + edit AS t, n AS channel, sign(re) * greatest(abs(re) - 0.1, 0) AS value, greatest(sqrt(re * re + im * im) - 0.1, 0) AS modulus FROM fids")
def _(spark, sf):
    f = ad.fids(spark, sf).withColumn("c", P.soft_threshold_complex(F.col("s"), 0.1))
    return f.select((F.col("dyn") * 2 + F.col("edit")).alias("t"), F.col("n").alias("channel"), P.soft_threshold(F.col("s.re"), 0.1).alias("value"),
                    F.hypot("c.re", "c.im").alias("modulus"))


@query("prj_08_binarise", "t:l state:l active:1", with_("samples") + "SELECT t, channel AS state, CAST(value >= 0.1 AS INTEGER) AS active FROM samples")
def _(spark, sf):
    return P.binarise(ad.samples(spark, sf).select("t", F.col("channel").alias("state"), F.col("value").alias("p")), 0.1)


@query("prj_09_lesion", "src:l dst:l weight:10",
       with_("trade") + "SELECT src, dst, weight * CASE WHEN src IN (1, 2) THEN 0.5 ELSE 1 END * CASE WHEN dst IN (1, 2) THEN 0.5 ELSE 1 END AS weight FROM trade")
def _(spark, sf):
    return P.lesion(ad.trade(spark, sf), [1, 2], 0.5)


@query("prj_10_edit_contrasts", "n:l first_re:8 second_im:8",
       with_("fids") + ", m AS (SELECT n, " + ", ".join(f"avg({p}) FILTER (dyn % 4 = {k}) AS m{k}{p}" for k in range(4) for p in ("re", "im")) +
       " FROM fids GROUP BY 1) SELECT n, m0re + m1re - (m2re + m3re) AS first_re, m0im + m2im - (m1im + m3im) AS second_im FROM m")
def _(spark, sf):
    return P.edit_contrasts(ad.fids(spark, sf).withColumn("condition", F.col("dyn") % 4), ["n"], (0, 1, 2, 3))


@query("prj_11_intensity_mask", "subject n:l lowest:4",
       with_("voxels") + ", q AS (SELECT subject, quantile_cont(value, 0.6) AS q FROM voxels WHERE map = 'price' AND value > 0 GROUP BY 1) "
       "SELECT subject, count(*) AS n, min(value) AS lowest FROM voxels JOIN q USING (subject) WHERE map = 'price' AND value > q GROUP BY 1")
def _(spark, sf):
    return P.intensity_mask(ad.voxels(spark, sf).where("map = 'price'"), 60.0).groupBy("subject").agg(F.count("*").alias("n"), F.min("value").alias("lowest"))


@query("prj_12_tissue_rule", "tissue n:l total:4",
       "SELECT tissue, count(*) AS n, sum(b) AS total FROM (SELECT CASE WHEN t > 0.3 AND t < 1 AND b > 0.01 THEN 'WM' WHEN t >= 1 AND t < 2.5 AND b > 0.01 THEN 'GM' END AS tissue, b FROM "
       "(SELECT l_quantity / 20 AS t, l_discount AS b FROM lineitem)) GROUP BY 1")
def _(spark, sf):
    li = ad.table(spark, sf, "lineitem").select((F.col("l_quantity") / 20).alias("t1"), F.col("l_discount").alias("bpf"))
    return li.withColumn("tissue", P.tissue_rule()).groupBy("tissue").agg(F.count("*").alias("n"), F.sum("bpf").alias("total"))
