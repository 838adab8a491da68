import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ondula.streaming import hopping, runs
from ondula.streaming.sinks import drain_counted

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def stream_of(spark, folder, parts, schema, row):
    """A stream that reads one part after the other."""
    for k, part in enumerate(parts):
        path = folder / f"{k}.json"
        names = [c.split()[0] for c in schema.split(", ")]
        path.write_text("\n".join(json.dumps(dict(zip(names, row(r))), default=datetime.isoformat) for r in part))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def at(second):
    return START + timedelta(seconds=second)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in"


def test_projection_sums_the_channels_of_a_time(spark, folder):
    parts = [[(0, "a", 1.0), (10, "a", 5.0), (10, "b", 7.0)], [(0, "b", 2.0), (60, "a", 1.0)], [(60, "b", 1.0)], [(3, "a", 99.0), (200, "a", 0.0)]]
    schema = "ts timestamp, recording string, channel string, value double"
    s = stream_of(spark, folder, parts, schema, lambda r: (at(r[0]), "r", r[1], r[2]))
    w = spark.createDataFrame([("sum", "a", 1.0), ("sum", "b", 1.0), ("diff", "a", 1.0), ("diff", "b", -1.0)], "i string, j string, v double")
    out, late = drain_counted(hopping.project_live(s, w, "30 seconds"))
    got = {(int((r["ts"].replace(tzinfo=timezone.utc) - START).total_seconds()), r["source"]): r["value"] for r in out.collect()}
    assert got == {(0, "sum"): 3.0, (0, "diff"): -1.0, (10, "sum"): 12.0, (10, "diff"): -2.0, (60, "sum"): 2.0, (60, "diff"): 0.0}
    assert late >= 1


def test_runs_close_by_state_silence_and_watermark(spark, folder):
    # (second, recording, t, state): rows of a part out of order, one late row, a repeated t, a row without a state
    parts = [[(3, "r", 3, 1), (1, "r", 1, 0), (2, "r", 2, 0), (2, "r", 2, 0), (1, "q", 1, 5)], [(4, "r", 4, 1), (100, "r", 5, 1)], [(101, "r", 6, None), (102, "r", 7, 2)],
             [(2, "r", 9, 7), (500, "z", 1, 0)]]
    schema = "ts timestamp, recording string, t bigint, state bigint"
    s = stream_of(spark, folder, parts, schema, lambda r: (at(r[0]), *r[1:]))
    with runs.with_state_store(spark):
        out, late = drain_counted(runs.run_lengths(s, "10 seconds", 30.0))
    got = sorted((r["recording"], r["state"], r["first"], r["last"], r["length"]) for r in out.collect())
    assert got == [("q", 5, 1, 1, 1), ("r", 0, 1, 2, 2), ("r", 1, 3, 4, 2), ("r", 1, 5, 5, 1), ("r", 2, 7, 7, 1)]
    assert late == 1
    assert max(r["dropped"] for r in out.where(F.col("recording") == "r").collect()) == 1
