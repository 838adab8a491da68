"""Run a stream over the files that are there and read back what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ondula.session import fresh_folder


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input into Parquet below the checkpoint folder and return it as a table."""
    return drain_counted(stream, mode)[0]


def drain_counted(stream: DataFrame, mode: str = "append") -> tuple[DataFrame, int]:
    """``drain``, and the number of rows that came too late: those that stateful operators dropped by the watermark."""
    spark: SparkSession = stream.sparkSession
    base = fresh_folder(spark, "stream")
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", base + "/out").option("checkpointLocation", base + "/log")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(base + "/out"), late
