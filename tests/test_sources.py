import gzip
import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ondula.plans.tables import _array_name
from ondula.sources import arrays, catalog, npy, sinks, text


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    d = root / "sub-01" / "dwi"
    d.mkdir(parents=True)
    m = np.arange(16.0).reshape(4, 4)
    np.savetxt(d / "sub-01_atlas-aal_desc-sift2_connectivity.csv", m, delimiter=",")
    (d / "sub-01_atlas-aal_desc-count_connectivity.csv").write_text("a,b\n1,2\n3,4\n")
    (d / "sub-01_atlas-aal_desc-meanlength_connectivity.csv").write_text("1,2\n3,4\n")
    (d / "sub-01_atlas-dk_desc-count_connectivity.tsv").write_text("1\t2\n3\t4\n")
    (d / "labels.tsv").write_text("index\tlabel\n1\tA\n2\tB\n")
    (d / "events.tsv").write_text("onset\tduration\ttrial_type\n1.5\t2\tgo\n3\n4\t1\tstop\n")
    (d / "aseg.stats").write_text("# Measure Brain, BrainVol, Brain volume, 123.5, mm^3\n# other\n 1 2 300 400.5 Left-X 1 2\n short row\n")
    (d / "recon.log").write_text("lh.orig has 12 holes\nrh.orig has 3 holes\nlh.orig.nofix: 7 holes\n")
    a = root / "series"
    a.mkdir()
    np.save(a / "b.npy", np.arange(6.0).reshape(3, 2))
    np.save(a / "a.npy", np.arange(4.0))
    trial = "# 64 chans\n# x\n0 FP1 0 -1.5\n0 FP1 1 2.0\n0 FP2 0 3.0\nbad\n".encode()
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w:gz") as t:
        raw = gzip.compress(trial)
        info = tarfile.TarInfo("x/co2a.rd.000.gz")
        info.size = len(raw)
        t.addfile(info, io.BytesIO(raw))
    z = root / "zip"
    z.mkdir()
    with tarfile.open(z / "outer.tar.gz", mode="w:gz") as t:
        info = tarfile.TarInfo("data/a_m_1.tar.gz")
        info.size = len(inner.getvalue())
        t.addfile(info, io.BytesIO(inner.getvalue()))
    return root


def test_arrays(spark, tree):
    got = arrays.array_samples(spark, str(tree / "series")).toPandas()
    assert len(got) == 10
    b = got[got["recording"].str.endswith("b.npy")].pivot(index="t", columns="channel", values="value").to_numpy()
    np.testing.assert_array_equal(b, np.arange(6.0).reshape(3, 2))
    with pytest.raises(FileNotFoundError):
        arrays.array_frames(spark, str(tree / "zip"))


def test_catalog(spark, tree):
    c = catalog.file_catalog(spark, str(tree))
    assert [r["atlas"] for r in catalog.atlases(c).collect()] == ["aal", "dk"]
    best = {r["atlas"]: r for r in catalog.preferred_matrix(c).collect()}
    assert best["aal"]["variant"] == "sift2" and best["aal"]["lengths"].endswith("meanlength_connectivity.csv")
    assert best["dk"]["variant"] == "count" and best["dk"]["delays"] is None
    assert [r["subject"] for r in catalog.subjects(c).collect()] == ["sub-01"]
    with pytest.raises(ValueError):
        catalog.parcellated_files(c, "mat")


def test_text(spark, tree):
    m = text.matrix_scan(spark, str(tree), "*_connectivity.*").toPandas()
    sift = m[m["path"].str.contains("sift2")].pivot(index="i", columns="j", values="v").to_numpy()
    np.testing.assert_array_equal(sift, np.arange(16.0).reshape(4, 4))
    count = m[m["path"].str.contains("aal_desc-count")].pivot(index="i", columns="j", values="v").to_numpy()
    np.testing.assert_array_equal(count, [[1, 2], [3, 4]])
    tsv = m[m["path"].str.contains("dk")].pivot(index="i", columns="j", values="v").to_numpy()
    np.testing.assert_array_equal(tsv, [[1, 2], [3, 4]])
    assert [(r["region"], r["label"]) for r in text.label_scan(spark, str(tree), "labels.tsv").orderBy("region").collect()] == [(0, "A"), (1, "B")]
    ev = text.event_scan(spark, str(tree), "events.tsv").orderBy("onset").collect()
    assert [(r["onset"], r["trial_type"]) for r in ev] == [(1.5, "go"), (4.0, "stop")]
    st = {r["name"]: r["value"] for r in text.structure_stats(text.lines(spark, str(tree), "aseg.stats")).collect()}
    assert st == {"BrainVol": 123.5, "Left-X": 400.5}
    holes = {r["hemi"]: r["holes"] for r in text.topology_holes(text.lines(spark, str(tree), "recon.log")).collect()}
    assert holes == {"lh": 7, "rh": 3}


def test_trials(spark, tree):
    got = arrays.parse_trials(arrays.trial_lines(spark, str(tree / "zip"))).orderBy("channel", "t").collect()
    assert [(r["channel"], r["t"], r["value"]) for r in got] == [("FP1", 0, -1.5), ("FP1", 1, 2.0), ("FP2", 0, 3.0)]
    cond = arrays.trial_lines(spark, str(tree / "zip")).select(catalog.matched_condition("archive").alias("c")).first()["c"]
    assert cond == "matched"


def test_unreadable_trials_are_counted(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", mode="w:gz") as t:
        for name, raw in (("x.rd.gz", b"no gzip"), ("y.rd.000", b"\xff\xfe"), ("z.rd.001", b"0 FP1 0 1.5"), ("w.rd.gz", gzip.compress(b"0 FP1 0 1.5" * 99)[:-20])):
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
    lines = arrays.trial_lines(spark, str(tmp_path))
    assert lines.where("line IS NULL").count() == 3
    assert [r["value"] for r in arrays.parse_trials(lines).collect()] == [1.5]


def test_array_files_are_split_by_rows(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((200_000, 3))
    np.save(tmp_path / "c.npy", x)
    np.save(tmp_path / "f.npy", np.asfortranarray(x.astype(">f4")))
    np.save(tmp_path / "i.npy", np.arange(7, dtype=np.int16))
    np.save(tmp_path / "none.npy", np.empty((0, 2)))
    df = arrays.array_frames(spark, str(tmp_path), split_bytes=1 << 20)
    assert df.rdd.getNumPartitions() >= 7
    got = df.toPandas()
    for name, want in (("c", x), ("f", x.astype("f4").astype(float)), ("i", np.arange(7.0)[:, None])):
        rows = got[got["recording"].str.endswith(f"/{name}.npy")].sort_values("t")
        np.testing.assert_array_equal(np.stack(rows["x"]), want)
        assert rows["t"].tolist() == list(range(len(want)))
    assert len(got) == 400_007
    small = arrays.array_frames(spark, str(tmp_path), "[in]*.npy")
    assert small.rdd.getNumPartitions() == 1 and small.count() == 7


def test_array_files_keep_every_core_busy(spark, tmp_path):
    """Files of less than a split of 32 MB in all went to a single task."""
    cores = spark.sparkContext.defaultParallelism
    x = np.arange(64 * 2048.0 * cores).reshape(-1, 64)
    for k, part in enumerate(np.array_split(x, 4 * cores)):
        np.save(tmp_path / f"m{k:03}.npy", part)
    got = arrays.array_frames(spark, str(tmp_path))
    assert cores <= got.rdd.getNumPartitions() <= cores + 1
    assert got.count() == len(x)
    assert got.agg(F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v))).first()[0] == x.sum()
    few = [("a", npy.Header(100, 2, False, "<f8", 0)), ("b", npy.Header(100, 2, False, "<f8", 0))]
    assert [len(r.parts) for r in npy.planned(few, npy.SPLIT_BYTES, 8)] == [2]  # too little to split


def test_array_names_without_a_search(spark):
    """A regular expression for the name took 27 microseconds a cell, as it began anew at every letter of the path."""
    paths = ["file:/a/b.npy/m12.npy", "m3.npy", "/x/y.npy.npy", "/x/.npy.npy"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("name", _array_name("path"))
    assert "regexp" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r["name"] for r in df.collect()] == ["m12", "m3", "y.npy", ".npy"]


def test_bad_array_files(spark, tmp_path):
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="one or two axes"):
        arrays.array_frames(spark, str(tmp_path)).count()


def test_arrays_are_written_and_read(spark, tmp_path):
    rows = [(f"r{k % 3}", k, [float(k), -float(k)]) for k in range(5000)]
    df = spark.createDataFrame(rows, "recording string, t long, x array<double>").repartition(5)
    paths = arrays.write_arrays(df, str(tmp_path / "out")).orderBy("path").collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["rows"]) for r in paths] == [("r0.npy", 1667), ("r1.npy", 1667), ("r2.npy", 1666)]
    np.testing.assert_array_equal(np.load(tmp_path / "out" / "r1.npy"), [[k, -k] for k in range(1, 5000, 3)])
    assert arrays.array_frames(spark, str(tmp_path / "out")).count() == 5000


@pytest.fixture
def many_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_numbers_over_splits(spark, tmp_path, many_splits):
    (tmp_path / "a.txt").write_text("".join(f"a{k}\n" if k % 10 else "  \n" for k in range(9000)))
    (tmp_path / "b.txt").write_text("\r\n".join(f"b{k}" for k in range(3)))
    got = text.lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 5
    rows = [(r["path"].rsplit("/", 1)[-1], r["line_no"], r["line"]) for r in got.collect()]
    want = [("a.txt", n, f"a{k}") for n, k in enumerate(k for k in range(9000) if k % 10)] + [("b.txt", k, f"b{k}") for k in range(3)]
    assert sorted(rows) == sorted(want)


def test_matrices_over_splits(spark, tmp_path, many_splits):
    m = np.round(np.random.default_rng(1).standard_normal((2000, 5)), 4)
    np.savetxt(tmp_path / "x_connectivity.csv", m, delimiter=",", header="a,b,c,d,e", comments="", fmt="%.4f")
    np.savetxt(tmp_path / "y_connectivity.tsv", m, delimiter="\t", fmt="%.4f")
    np.save(tmp_path / "z_connectivity.npy", m)
    got = text.matrix_scan(spark, str(tmp_path), "*_connectivity.*").toPandas()
    assert got["path"].nunique() == 3
    for _, part in got.groupby("path"):
        np.testing.assert_array_equal(part.pivot(index="i", columns="j", values="v").to_numpy(), m)
    (tmp_path / "labels.tsv").write_text("index\tname\n" + "".join(f"{k}\tR{k}\n" for k in range(3000)))
    labels = text.label_scan(spark, str(tmp_path), "labels.tsv").collect()
    assert sorted((r["region"], r["label"]) for r in labels) == [(k, f"R{k}") for k in range(3000)]
    (tmp_path / "events.tsv").write_text("onset\tduration\ttrial_type\n" + "".join(f"{k}\t1\tgo\n" for k in range(3000)))
    assert sorted(r["onset"] for r in text.event_scan(spark, str(tmp_path), "events.tsv").collect()) == [float(k) for k in range(3000)]


def test_sinks(spark, tmp_path):
    empty = spark.createDataFrame([], "a int")
    assert sinks.write_stats(empty, str(tmp_path / "none")) is False and not (tmp_path / "none").exists()
    s = spark.createDataFrame([("s1", "rest", i, float(i)) for i in range(20)], "subject string, task string, t long, value double")
    sinks.write_series(s, str(tmp_path / "series"))
    assert spark.read.parquet(str(tmp_path / "series")).where(F.col("subject") == "s1").count() == 20
