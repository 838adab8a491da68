"""Array files and trial archives as DataFrames."""

from __future__ import annotations

import gzip
import io
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ondula.operators.attach import attach
from ondula.session import cut
from ondula.sources import npy

def array_frames(spark: SparkSession, root: str, glob: str = "*.npy", split_bytes: int = npy.SPLIT_BYTES) -> DataFrame:
    """``.npy`` files of layout (time, channel) as frames; a 1-D array is one channel, one file one recording.

    Files are split by rows, about ``split_bytes`` to a task, or less if not every core had a task then. The store has to be one that the Python workers can open: local or
    shared folders, HDFS, S3 and the like. Integers and floats of any width become doubles.
    """
    if not npy.listed(root, glob)[2]:
        raise FileNotFoundError(f"no {glob} below {root}")
    spark.dataSource.register(npy.ArrayFiles)
    return spark.read.format("npy").option("glob", glob).option("splitBytes", split_bytes).option("tasks", spark.sparkContext.defaultParallelism).load(root)


def array_samples(spark: SparkSession, root: str, glob: str = "*.npy") -> DataFrame:
    return array_frames(spark, root, glob).select("recording", "t", F.posexplode("x").alias("channel", "value"))


def write_arrays(frames: DataFrame, folder: str) -> DataFrame:
    """Frames as one ``.npy`` file of doubles per recording below ``folder``: ``path, rows``.

    Rows are counted first, as the header has their number, then go to the file in the order of ``t``, whatever their number. A file gets its name
    when it is whole, so a task that is run again replaces it.
    """
    size = frames.groupBy("recording").agg(F.count("*").alias("_n"), F.max(F.size("x")).alias("_c"))
    rows = attach(frames.select("recording", "t", "x"), size, ["recording"], ["t"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path, before = npy.open_store(folder)
        out, name, done = None, None, []

        def close() -> None:
            out.close()
            store.move(f"{path}/{name}.part-{token}", f"{path}/{name}.npy")
            done.append((f"{before}{path}/{name}.npy", wrote))

        token, wrote = uuid.uuid4().hex, 0
        for b in batches:
            names = b.column(0).to_pylist()
            first = [0, *[k for k in range(1, len(names)) if names[k] != names[k - 1]], len(names)]
            for lo, hi in zip(first, first[1:]):
                if hi == lo:
                    continue
                if names[lo] != name:
                    if out:
                        close()
                    name, wrote = names[lo], 0
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}.part-{token}", compression=None)
                    out.write(npy.file_bytes(b.column(3)[lo].as_py(), b.column(4)[lo].as_py()))
                out.write(np.asarray(b.column(2).slice(lo, hi - lo).flatten(), dtype="<f8").tobytes())
                wrote += hi - lo
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "rows"])

    ordered = rows.repartition("recording").sortWithinPartitions("recording", "t").select("recording", "t", "x", "_n", "_c")
    return cut(ordered.mapInArrow(put, "path string, rows bigint"))


def trial_lines(spark: SparkSession, root: str, glob: str = "*.tar*") -> DataFrame:
    """Lines of the ASCII trials inside (nested) subject archives: ``archive, trial, line_no, line``.

    A trial that cannot be read gives one row without number and line, so that it can be counted.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)

    def members(name: str, body: bytes) -> Iterator[tuple[str, str, str | None]]:
        with tarfile.open(fileobj=io.BytesIO(body), mode="r:*") as tar:
            for m in tar:
                if not m.isfile():
                    continue
                raw = tar.extractfile(m).read()
                if m.name.endswith((".tar.gz", ".tgz", ".tar")):
                    yield from members(m.name, raw)
                elif ".rd." in m.name:
                    try:
                        text = (gzip.decompress(raw) if m.name.endswith(".gz") else raw).decode("ascii")
                    except (OSError, EOFError, UnicodeDecodeError, zlib.error):
                        text = None
                    yield name, m.name, text

    def unpack(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for path, body in zip(pdf["path"], pdf["content"]):
                for archive, trial, text in members(path.rsplit("/", 1)[-1], body):
                    ls = [None] if text is None else text.strip().split("\n")
                    yield pd.DataFrame({"archive": archive, "trial": trial, "line_no": pd.array([None] if text is None else range(len(ls)), "Int64"), "line": ls})

    return files.select("path", "content").mapInPandas(unpack, "archive string, trial string, line_no bigint, line string")


def parse_trials(lines: DataFrame) -> DataFrame:
    """Trial samples: comment lines, unreadable trials and rows of fewer than four fields are skipped, samples keep file order."""
    f = F.split(F.trim("line"), "\\s+")
    rows = lines.where(~F.col("line").startswith("#")).where(F.size(f) >= 4)
    w = W.partitionBy("archive", "trial", "channel").orderBy("line_no")
    return rows.select("archive", "trial", "line_no", f[1].alias("channel"), f[3].cast("double").alias("value")).withColumn(
        "t", F.row_number().over(w) - 1).select("archive", "trial", "channel", F.col("t").cast("bigint").alias("t"), "value")
