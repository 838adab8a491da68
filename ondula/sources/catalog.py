"""Queries over a file catalog ``path, length``; no file body is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SMALLEST = 1000  # fixed: a shorter file is a pointer, not data
VARIANTS = ("sift2", "siftcount", "count")  # fixed order of preference
PARCELLATED = {"npy": "sflip_parc.npy", "fif": "sflip_parc-raw.fif"}


def file_catalog(spark: SparkSession, root: str | Sequence[str], glob: str = "*") -> DataFrame:
    """Paths and sizes below ``root``."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root))
    return files.select("path", "length")


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def parcellated_files(catalog: DataFrame, form: str = "npy") -> DataFrame:
    if form not in PARCELLATED:
        raise ValueError(f"form must be one of {sorted(PARCELLATED)}")
    return catalog.where(_name() == PARCELLATED[form]).select("path").orderBy("path")


def preprocessed_files(catalog: DataFrame) -> DataFrame:
    return catalog.where(_name().endswith("_preproc-raw.fif")).select("path").orderBy("path")


def subjects(catalog: DataFrame) -> DataFrame:
    s = F.regexp_extract("path", r"/(sub-[^/]+)/", 1).alias("subject")
    return catalog.select(s).where("subject <> ''").distinct().orderBy("subject")


def tasks(catalog: DataFrame) -> DataFrame:
    """Distinct tasks and runs of each subject from the entities in the file names."""
    e = lambda n: F.regexp_extract(_name(), rf"{n}-([^_.]+)", 1)
    rows = catalog.select(F.regexp_extract("path", r"/(sub-[^/]+)/", 1).alias("subject"), e("task").alias("task"),
                          F.expr("try_cast(regexp_extract(element_at(split(path, '/'), -1), 'run-([0-9]+)', 1) AS int)").alias("run"))
    return rows.where("task <> ''").distinct().orderBy("subject", "task", "run")


def availability(catalog: DataFrame, data_ext: str, header_ext: str) -> DataFrame:
    """Per recording: both files exist and neither is a pointer."""
    stem = F.regexp_replace("path", r"\.[^./]+$", "").alias("recording")
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1).alias("ext")
    rows = catalog.select(stem, ext, "length").where(F.col("ext").isin(data_ext, header_ext))
    return rows.groupBy("recording").agg(
        (F.bool_and(F.col("length") > SMALLEST) & (F.count_distinct("ext") == 2)).alias("available"))


def atlases(catalog: DataFrame) -> DataFrame:
    a = F.regexp_extract(_name(), r"atlas-([^_.]+)", 1).alias("atlas")
    return catalog.where(_name().rlike(r"_connectivity\.")).select(a).where("atlas <> ''").distinct().orderBy("atlas")


def preferred_matrix(catalog: DataFrame) -> DataFrame:
    """One weights file per subject and atlas by preference, with optional length and delay files."""
    e = lambda n: F.regexp_extract(_name(), rf"{n}-([^_.]+)", 1)
    rows = catalog.where(_name().rlike(r"_connectivity\.")).select(
        F.regexp_extract("path", r"(sub-[^/_]+)", 1).alias("subject"), e("atlas").alias("atlas"), e("desc").alias("desc"), "path")
    order = F.array_position(F.array(*[F.lit(v) for v in VARIANTS]), F.col("desc"))
    w = W.partitionBy("subject", "atlas").orderBy(order, "path")
    best = rows.where(order > 0).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
        "subject", "atlas", F.col("desc").alias("variant"), F.col("path").alias("weights"))
    side = lambda d, n: rows.where(F.col("desc") == d).groupBy("subject", "atlas").agg(F.min("path").alias(n))
    return best.join(side("meanlength", "lengths"), ["subject", "atlas"], "left").join(
        side("axondelay", "delays"), ["subject", "atlas"], "left")


def skipped_subjects(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Subjects asked for that have no matrix."""
    return wanted.join(found.select("subject").distinct(), "subject", "left_anti")


def fast_series(acquisition: DataFrame, processing: DataFrame, min_rate: float) -> DataFrame:
    """Series of both groups sampled at ``min_rate`` or faster."""
    return acquisition.unionByName(processing).where(F.col("rate") >= min_rate)


def assets_below(assets: DataFrame, prefix: str) -> DataFrame:
    return assets.where(F.col("path").startswith(prefix))


def task_file(catalog: DataFrame, task: str, run: int | None = 1) -> DataFrame:
    """First ``.set`` file of a task: with the run, else any resting file, in path order per subject."""
    rows = catalog.where(F.col("path").endswith(".set")).where(F.col("path").contains(task))
    if run is None:
        rank = F.lit(0)
    else:
        rest = F.lit("RestingState" in task)
        rank = F.when(F.col("path").contains(f"run-{run}") | rest, 0)
    subject = F.regexp_extract("path", r"(sub-[^/_]+)", 1)
    rows = rows.withColumn("_p", rank).where("_p IS NOT NULL").withColumn("subject", subject)
    w = W.partitionBy("subject").orderBy("path")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("subject", "path")


def matched_condition(name: str = "archive") -> Column:
    """``matched`` when the archive name has a_m or c_m."""
    return F.when(F.col(name).contains("a_m") | F.col(name).contains("c_m"), "matched").otherwise("non-matched")
