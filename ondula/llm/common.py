"""Shared pieces: tables written to the cluster's shared folder, size-checked joins and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Upper bound, in bytes of rows, of a table that is sent to every executor.
BROADCAST_BYTES = 32 << 20
SALTS = 32
#: Cells of the count that finds crowded keys: a table of fixed size.
CELLS = 65536


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a local session without one gets its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = "file://" + tempfile.mkdtemp(prefix="ondula-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: lineage ends there, executors may be lost."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: str) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_key(source: str) -> Column:
    """A non-null key for a nullable string: '' stands for null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def shuffle_hash(key: str, seed: str) -> Column:
    """60 bits of the MD5 of the seed and the key; a fixed shuffle that any SQL engine can repeat."""
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def look_up(rows: DataFrame, table: DataFrame, on: list[str], row_bytes: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` with a table of one row per key.

    Up to ``BROADCAST_BYTES`` (counted rows times ``row_bytes``) the table is broadcast; a larger one is repeated over
    ``SALTS`` salts, so that a key with a large share of ``rows`` is dealt to as many tasks.
    """
    if table.count() * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), on, how)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    return dealt.join(salted, [*on, "__salt"], how).drop("__salt")


def units(placed: DataFrame, key: str, member: str, crowd: int) -> DataFrame:
    """``placed`` with ``unit`` (long), ``own`` and ``other`` (int): all members of a key share a unit, but for crowded keys.

    Rows are counted in ``CELLS`` cells first, then the keys of cells with over ``crowd`` rows one by one. A key with over ``crowd`` rows, whatever the size of
    the table, is dealt to tiles by a hash of
    the member; every two tiles make a unit, so each pair of members meets, and many tasks share the work. A member's own tile is ``own``; ``other`` is the second tile of
    the unit, the same one in the unit of a tile with itself. So one row tells which tiles its unit is for, whoever else is in it.
    """
    placed = placed.withColumn("__cell", F.pmod(F.hash(key), F.lit(CELLS)))
    counts = written(placed.groupBy("__cell").agg(F.count("*").alias("n"))).where(F.col("n") > crowd).select("__cell")
    alone = placed.drop("__cell").withColumn("unit", F.col(key).cast("long")).withColumn("own", F.lit(0)).withColumn("other", F.lit(0))
    if counts.isEmpty():
        return alone
    sizes = placed.join(F.broadcast(counts), "__cell", "left_semi").groupBy(key).agg(F.count("*").alias("n"))
    crowded = written(sizes.where(F.col("n") > crowd).select(key, F.ceil(F.col("n") / crowd).cast("int").alias("__tiles")))
    if crowded.isEmpty():
        return alone
    tiled = look_up(placed.drop("__cell"), crowded, [key], 24, "left").withColumn("__tiles", F.coalesce("__tiles", F.lit(1)))
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64(member), F.col("__tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)))
    pair = F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))
    return tiled.withColumn("unit", F.when(F.col("__tiles") == 1, F.col(key).cast("long")).otherwise(pair)).drop("__tiles")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)`` of longs: every node that has an edge to another node, and the smallest node reachable.

    Each task first replaces its edges by a star per local component. Then every node points to the smallest node of its closed
    neighbourhood, edges move to the targets, and this repeats until none is left: a round at least halves the nodes that remain. Maps
    are composed from the last round back. All tables are written to the shared folder; nothing but a row count reaches the driver.
    Edges with a null end and loops are ignored.
    """
    left = written(edges.where("u <> v").mapInArrow(_stars, "u long, v long").distinct())
    maps = []
    while left.count():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")))
        maps.append(to)
        moved = left.join(to.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u")
        moved = moved.join(to.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
        moved = moved.where("ru <> rv").select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v"))
        left = written(moved.distinct())
    if not maps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = maps[-1]
    for to in reversed(maps[:-1]):
        last = out.select(F.col("node").alias("root"), F.col("root").alias("further"))
        out = written(to.join(last, "root", "left").select("node", F.coalesce("further", "root").alias("root")))
    return out


def _stars(batches):
    """The edges of a task as stars around the smallest node of each component, a batch of edges after the other."""
    held = [], []
    size = 0
    for batch in batches:
        held[0].append(batch.column(0).to_numpy(zero_copy_only=False))
        held[1].append(batch.column(1).to_numpy(zero_copy_only=False))
        size += batch.num_rows
        if size >= 1 << 20:
            yield _star(np.concatenate(held[0]), np.concatenate(held[1]))
            held, size = ([], []), 0
    if size:
        yield _star(np.concatenate(held[0]), np.concatenate(held[1]))


def _star(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u):]
    label = smallest_labels(len(nodes), a, b)
    off = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[off], pa.int64()), pa.array(nodes[label[off]], pa.int64())], names=["u", "v"])


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links a-b: the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            nxt = label[label]
            if np.array_equal(nxt, label):
                break
            label = nxt
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label
