"""Recovery of injected signals by cleaning functions, over a grid of scenarios."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondula.operators.aggregates import recovery
from ondula.session import cut

Cleaning = Callable[[DataFrame, Sequence[str]], DataFrame]


class Registry:
    """Named cleaning functions: samples and series keys in, samples out."""

    def __init__(self) -> None:
        self._functions: dict[str, tuple[Cleaning, str]] = {}

    def add(self, name: str, function: Cleaning, description: str = "") -> None:
        self._functions[name] = (function, description)

    def apply(self, name: str, samples: DataFrame, keys: Sequence[str]) -> DataFrame:
        if name not in self._functions:
            raise ValueError(f"unknown cleaning function: {name}")
        return samples.transform(self._functions[name][0], keys)

    def names(self) -> list[str]:
        return list(self._functions)


def recovery_sweep(samples: DataFrame, signals: DataFrame, levels: Sequence[float], cleaning: Registry, n_trials: int = 1,
                   seed: int = 0) -> DataFrame:
    """Recovery metrics per cleaning function, level (dB), signal and trial.

    ``signals`` has ``signal, t, value`` at unit amplitude; a level scales it
    against the root mean square of the recording. Every trial has its own
    spatial pattern with a largest magnitude of 1. All scenarios are rows of
    one plan; the scenario is a further series key for the cleaning function.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("level"), F.lit(t).alias("trial")) for v in levels for t in range(n_trials)])).alias("_g")
    rms = samples.agg(F.sqrt(F.avg(F.col("value") ** 2)).alias("_rms"))
    uni = lambda part: (F.pmod(F.xxhash64(F.lit(seed), F.lit(part), "signal", "level", "trial", "channel"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    names = signals.select("signal").distinct()
    ch = samples.select("channel").distinct().withColumn("_k", F.lit(0))
    pat = ch.join(names.withColumn("_k", F.lit(0)), "_k").select("channel", "signal", grid).select("channel", "signal", "_g.*")
    pat = pat.withColumn("_w", F.sqrt(-2 * F.log(uni(1))) * F.cos(2 * math.pi * uni(2)))
    top = pat.groupBy("signal", "level", "trial").agg((F.max(F.abs("_w")) + 1e-20).alias("_top"))
    pat = cut(pat.join(top, ["signal", "level", "trial"]).join(F.broadcast(rms), how="inner").select(
        "signal", "level", "trial", "channel", (F.col("_w") / F.col("_top") * F.col("_rms") * F.pow(F.lit(10.0), F.col("level") / 20)).alias("_w")))
    injected = pat.join(signals, "signal").select("signal", "level", "trial", "channel", "t", (F.col("_w") * F.col("value")).alias("value"))
    scenario = ["signal", "level", "trial"]
    mixed = samples.join(injected.withColumnRenamed("value", "_add"), ["channel", "t"]).select(
        *scenario, "recording", "channel", "t", (F.col("value") + F.col("_add")).alias("value"))
    parts = []
    for name in cleaning.names():
        with_signal = cleaning.apply(name, mixed, [*scenario, "recording", "channel"])
        without = cleaning.apply(name, samples, ["recording", "channel"])
        m = recovery(with_signal, without, injected, scenario)
        parts.append(m.withColumn("cleaning", F.lit(name)).withColumn("improvement", F.col("snr_db") - F.col("level")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
