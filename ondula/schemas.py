"""The fixed table schemas; nothing in the library infers one."""

from pyspark.sql.types import StructType

_DDL = {
    "samples": "recording STRING, channel STRING, t BIGINT, value DOUBLE",
    "frames": "recording STRING, t BIGINT, x ARRAY<DOUBLE>",
    "recordings": "recording STRING, subject STRING, task STRING, fs DOUBLE, n_t BIGINT",
    "channels": "recording STRING, channel STRING, kind STRING, x DOUBLE, y DOUBLE, z DOUBLE, bad BOOLEAN",
    "events": "recording STRING, onset DOUBLE, duration DOUBLE, trial_type STRING",
    "states": "recording STRING, t BIGINT, state INT",
    "gamma": "recording STRING, t BIGINT, state INT, p DOUBLE",
    "edges": "graph STRING, src INT, dst INT, weight DOUBLE, length DOUBLE, delay DOUBLE",
    "regions": "graph STRING, region INT, label STRING",
    "voxels": "subject STRING, map STRING, i INT, j INT, k INT, vol INT, value DOUBLE",
    "segmentation": "subject STRING, i INT, j INT, k INT, label_id INT",
    "labels": "label_id INT, name STRING, tissue STRING, sigma DOUBLE",
    "fids": "acq STRING, coil INT, edit INT, dyn INT, n INT, s STRUCT<re:DOUBLE,im:DOUBLE>",
    "spectra": "key STRING, channel STRING, win INT, freq DOUBLE, s STRUCT<re:DOUBLE,im:DOUBLE>, power DOUBLE",
    "features": "subject STRING, name STRING, modality STRING, value DOUBLE",
    "matrix": "id STRING, i INT, j INT, v DOUBLE",
    "vertices": "mesh STRING, v INT, x DOUBLE, y DOUBLE, z DOUBLE",
    "faces": "mesh STRING, f INT, v0 INT, v1 INT, v2 INT",
    "runs": "optimizer STRING, seed INT, fitness DOUBLE, wall_time DOUBLE, evals BIGINT",
}

TABLES = tuple(_DDL)


def schema(table: str) -> StructType:
    """StructType of a table; parsing needs a running session."""
    return StructType.fromDDL(_DDL[table])
