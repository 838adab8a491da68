"""Join per-group statistics back to the rows they came from without shuffling the rows by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ondula.session import cut

SMALL_BYTES = 64 << 20
SALTS = 32


def table_bytes(small: DataFrame) -> int:
    """About how many bytes a table takes in memory: what arrays and strings hold, and a fixed share per row."""
    def of(kind: T.DataType, c: Column) -> Column:
        if isinstance(kind, T.ArrayType):
            width = 8 * len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 8
            return F.coalesce(F.size(c), F.lit(0)) * width
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.length(c), F.lit(0))
        return F.lit(8 * len(kind.fields) if isinstance(kind, T.StructType) else 8)

    row = sum((of(f.dataType, F.col(f"`{f.name}`")) for f in small.schema.fields), F.lit(16))
    return small.agg(F.sum(row.cast("bigint"))).first()[0] or 0


def sized_broadcast(small: DataFrame) -> DataFrame:
    """A broadcast hint for a parameter table that was measured to be small; a larger one is left to the planner."""
    return F.broadcast(small) if table_bytes(small) <= SMALL_BYTES else small


def attach(rows: DataFrame, stats: DataFrame, on: Sequence[str], spread: Sequence[str], written: bool = False) -> DataFrame:
    """Inner join of ``rows`` with one row of ``stats`` per group.

    ``stats`` is computed and written once (unless it is ``written`` already), so its size is known: up to
    ``SMALL_BYTES`` it is broadcast. Beyond that both sides are salted, by a
    hash of the ``spread`` columns, so that a group with a large share of the
    rows is still spread over ``SALTS`` tasks.
    """
    on = list(on)
    small = stats if written else cut(stats)
    if table_bytes(small) <= SMALL_BYTES:
        return rows.join(F.broadcast(small), on)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"]).drop("_salt")
