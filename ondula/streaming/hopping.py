"""Event-time windows on live samples ``ts, recording, channel, value``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hopping_power(samples: DataFrame, length: str = "30 seconds", hop: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    """Mean, mean square and count per hopping window and channel; append mode, late rows beyond ``delay`` are left out."""
    live = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    w = live.groupBy(F.window("ts", length, hop), "recording", "channel").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg(F.col("value") ** 2).alias("power"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "recording", "channel", "n", "mean", "power")


def project_live(samples: DataFrame, weights: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """S = W x of live samples ``ts, recording, channel, value``: one row ``ts, recording, source, value`` per time and source.

    The channels of a time may come in any order and in different batches; their sum is kept until the watermark has passed the time, then
    comes out once. Channels that come later than ``delay`` are left out; Spark counts them as rows dropped by the watermark.
    """
    w = weights.select(F.col("i").alias("source"), F.col("j").alias("channel"), "v")
    live = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).join(w, "channel")
    return live.groupBy("ts", "recording", "source").agg(F.sum(F.col("v") * F.col("value")).alias("value"))


def project_frames_live(frames: DataFrame, weights) -> DataFrame:
    """S = W x of live frames; every micro-batch is one matrix product per Arrow batch."""
    from ondula.operators.joins import project_frames
    return project_frames(frames, weights)


def flag_artifacts(samples: DataFrame, thresholds: DataFrame, length: str, hop: str, delay: str) -> DataFrame:
    """Windows whose root mean square reaches the calibrated threshold ``channel, level``."""
    w = hopping_power(samples, length, hop, delay)
    return w.join(thresholds, "channel").withColumn("rms", F.sqrt("power")).withColumn("artifact", F.col("rms") >= F.col("level"))
