"""Sinks: statistics CSV, quality JSON and TSV, partitioned series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stats(stats: DataFrame, path: str) -> bool:
    """CSV with header; nothing is written for an empty table."""
    if stats.isEmpty():
        return False
    stats.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_comparison(comparison: DataFrame, path: str) -> None:
    """Tissue x tool rows that have a mean."""
    comparison.where("mean IS NOT NULL").write.mode("overwrite").option("header", True).csv(path)


def quality_row(report: DataFrame) -> DataFrame:
    """The flat record: everything but the channel name lists."""
    return report.drop("noisy_channels", "flat_channels")


def write_quality(report: DataFrame, json_path: str, tsv_path: str) -> None:
    report.write.mode("overwrite").json(json_path)
    quality_row(report).write.mode("overwrite").option("sep", "\t").option("header", True).csv(tsv_path)


def write_series(samples: DataFrame, path: str, by: Sequence[str] = ("subject", "task"), files: int | None = None) -> None:
    """Parquet partitioned by subject and task.

    Rows are spread over ``files`` tasks by key and a hash of the time, so a
    recording with a large share of the rows is written by many tasks.
    """
    salt = F.pmod(F.xxhash64("t"), F.lit(16))
    spread = samples.repartition(files, *by, salt) if files else samples.repartition(*by, salt)
    spread.write.mode("overwrite").partitionBy(*by).parquet(path)
