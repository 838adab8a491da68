"""Runs of equal states as samples arrive."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "recording string, state bigint, first bigint, last bigint, length bigint, dropped bigint"
PENDING = "ms bigint, t bigint, state bigint"
OPEN = "state bigint, first bigint, last bigint, length bigint, dropped bigint, ms bigint"


class RunLengths(StatefulProcessor):
    """Keeps the rows of a recording that the watermark has not reached, and its open run.

    A timer at the earliest such row takes those that the watermark has passed, in order of event time, so rows may arrive in any order within the
    delay. A run is closed by another state, by a row without a state, by a silence longer than ``gap`` before the next row, and by the
    watermark once it lies ``gap`` behind the last row: no end needs to be sent. A row at the ``t`` of the last one or before is dropped and counted.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", OPEN)
        self._pending = handle.getListState("pending", PENDING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        ms = batch["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000
        state = [None if pd.isna(s) else int(s) for s in batch["state"]]
        self._pending.appendList(list(zip(ms.tolist(), batch["t"].tolist(), state)))
        self._handle.registerTimer(int(ms.min()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self._pending.get()) if self._pending.exists() else []
        due, later = sorted(r for r in held if r[0] <= now), [r for r in held if r[0] > now]
        run = tuple(self._open.get()) if self._open.exists() else None
        state, first, last, length, dropped, at = run if run else (None, 0, -(1 << 62), 0, 0, -(1 << 62))
        closed = []

        def close() -> None:
            if state is not None:
                closed.append((key[0], state, first, last, length, dropped))

        for ms, t, s in due:
            if t <= last:
                dropped += 1
                continue
            if s == state and ms - at <= self.gap:
                length += 1
            else:
                close()
                state, first, length = s, t, 1
            last, at = t, ms
        if state is not None and at + self.gap <= now:
            close()
            state = None
        self._open.update((state, first, last, length, dropped, at))
        if later:
            self._pending.put(later)
        else:
            self._pending.clear()
        wake = [r[0] for r in later] + ([at + self.gap] if state is not None else [])
        if wake:
            self._handle.registerTimer(min(wake))
        if closed:
            yield pd.DataFrame(closed, columns=["recording", "state", "first", "last", "length", "dropped"])

    def close(self) -> None:
        pass


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """The session's state store is ``PROVIDER`` inside, and what it was before outside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_lengths(states: DataFrame, delay: str = "10 seconds", gap_seconds: float = 60.0) -> DataFrame:
    """Closed runs ``recording, state, first, last, length, dropped`` of a live state table ``ts, recording, t, state``.

    Rows later than ``delay`` behind the latest time are left out by the watermark. ``dropped`` counts a recording's repeated rows so far. The session must use the
    state store ``PROVIDER``, as ``with_state_store`` sees to while a stream starts.
    """
    live = states.select(F.col("ts").cast("timestamp").alias("ts"), "recording", "t", F.col("state").cast("bigint").alias("state")).withWatermark("ts", delay)
    return live.groupBy("recording").transformWithStateInPandas(RunLengths(int(gap_seconds * 1000)), OUTPUT, "Append", "EventTime")
