"""Scans of text sidecars: matrices, labels, events and statistics files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ondula.operators.attach import attach
from ondula.sources import npy
from ondula.sources.arrays import array_frames


def lines(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None, but: str = "") -> DataFrame:
    """Lines of all files but those that end in ``but``: lines that are not blank, numbered from 0 in each file: ``path, line_no, line``.

    Files are read split by split, not whole. A line's number is its place in the split plus the lines of the file's earlier splits. Only these counts are
    gathered, so text is read twice, once to count, and no line is shuffled.
    """
    r = spark.read.option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    t = r.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.col("value").alias("line"))
    if but:
        t = t.where(~F.col("path").endswith(but))
    t = t.where(F.trim("line") != "").withColumn("_id", F.monotonically_increasing_id())
    splits = t.groupBy("path", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("path").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    splits = splits.select("path", "_at", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return attach(t, splits, ["path", "_at"], ["_id"]).select("path", (F.col("_id") + F.col("_shift")).alias("line_no"), "line")


def below_header(rows: DataFrame, is_header: Column) -> DataFrame:
    """``rows`` without first lines that are headers, and ``row``: the number of each line among those of its file that stay."""
    heads = rows.where("line_no = 0").groupBy("path").agg(F.max(is_header.cast("int")).alias("_h"))
    return attach(rows, heads, ["path"], ["line_no"]).where(F.col("line_no") >= F.col("_h")).withColumn("row", F.col("line_no") - F.col("_h")).drop("_h")


def matrix_scan(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Matrices from CSV, TSV, TXT or NPY files below folders: ``path, i, j, v``; a first line that is not numeric is skipped.

    An NPY file is split by rows, a text by lines.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    found = []
    names = {root: npy.listed(root, glob or "*")[2] for root in roots}
    texts = [root for root, n in names.items() if any(not p.endswith(".npy") for p in n)]
    if texts:
        found.append(matrix_cells(lines(spark, texts, glob, but=".npy")))
    for root, n in names.items():
        if any(p.endswith(".npy") for p in n):
            x = array_frames(spark, root, (glob or "*").removesuffix(".npy").removesuffix(".*") + ".npy")
            found.append(x.select(F.col("recording").alias("path"), F.col("t").alias("i"), F.posexplode("x").alias("j", "v")))
    if not found:
        raise FileNotFoundError(f"no {glob} below {paths}")
    return reduce(DataFrame.unionByName, found)


def matrix_cells(rows: DataFrame) -> DataFrame:
    """Cells of matrices from lines numbered without gaps, as ``lines`` gives them; what is no number becomes NULL."""
    sep = F.when(F.col("path").endswith(".tsv"), "\t").when(F.col("path").endswith(".txt"), "\\s+|,").otherwise(",")
    t = rows.withColumn("_v", F.transform(F.split(F.trim("line"), sep), lambda c: F.trim(c).try_cast("double")))
    body = below_header(t.drop("line"), F.exists("_v", lambda c: c.isNull()))
    return body.select("path", F.col("row").alias("i"), F.posexplode("_v").alias("j", "v"))


def label_scan(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Region labels, last field of each line; a header naming label, name or region is skipped."""
    return label_rows(lines(spark, paths, glob))


def label_rows(rows: DataFrame) -> DataFrame:
    """Labels of lines numbered without gaps."""
    body = below_header(rows, F.lower("line").rlike("label|name|region"))
    return body.select("path", F.col("row").alias("region"), F.trim(F.element_at(F.split("line", "[\t,]"), -1)).alias("label"))


def event_scan(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Event tables ``onset, duration, trial_type``; short rows are left out."""
    return event_rows(lines(spark, paths, glob))


def event_rows(rows: DataFrame) -> DataFrame:
    f = F.split("line", "\t")
    ok = rows.where(F.col("line_no") > 0).where(F.size(f) >= 3)
    return ok.select(F.col("path").alias("recording"), f[0].cast("double").alias("onset"), f[1].cast("double").alias("duration"),
                     F.trim(f[2]).alias("trial_type"))


def structure_stats(rows: DataFrame) -> DataFrame:
    """Volume rows and ``# Measure`` rows of structure statistics: ``path, name, value``."""
    s = F.trim("line")
    head = s.startswith("# Measure")
    part = F.split(s, ",")
    measure = rows.where(head).where(F.size(part) >= 4).select(
        "path", F.trim(part[1]).alias("name"), F.expr("try_cast(trim(split(line, ',')[3]) AS double)").alias("value"))
    f = F.split(s, "\\s+")
    body = rows.where(~s.startswith("#")).where(F.size(f) >= 5).select("path", f[4].alias("name"), f[3].cast("double").alias("value"))
    return measure.unionByName(body)


def cortical_stats(rows: DataFrame) -> DataFrame:
    """Parcel rows with at least ten fields: ``name, area, volume, thickness, thickness_std``."""
    f = F.split(F.trim("line"), "\\s+")
    ok = rows.where(~F.trim("line").startswith("#")).where(F.size(f) >= 10)
    return ok.select("path", f[0].alias("name"), f[2].cast("double").alias("area"), f[3].cast("double").alias("volume"),
                     f[4].cast("double").alias("thickness"), f[5].cast("double").alias("thickness_std"))


def topology_holes(rows: DataFrame) -> DataFrame:
    """Holes per log and hemisphere; the last matching line counts."""
    hemi = F.regexp_extract("line", r"\b(lh|rh)\.orig", 1)
    n = F.regexp_extract("line", r"(\d+)\s+holes", 1)
    m = rows.select("path", "line_no", hemi.alias("hemi"), n.alias("n")).where("hemi <> '' AND n <> ''")
    return m.groupBy("path", "hemi").agg(F.max_by(F.col("n").cast("int"), "line_no").alias("holes"))


def head_shape(rows: DataFrame) -> DataFrame:
    """Head points: rows named EXTRA, Nasion, LPA or RPA with at least four fields."""
    f = F.split(F.trim("line"), "\\s+")
    ok = rows.where(F.size(f) >= 4).where(f[0].isin("EXTRA", "Nasion", "LPA", "RPA"))
    return ok.select("path", f[0].alias("point"), *[f[k].cast("double").alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))])


def structure_table(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Subjects by structures from rows ``subject, name, value``."""
    return rows.groupBy("subject").pivot("name", list(names)).agg(F.max("value"))
