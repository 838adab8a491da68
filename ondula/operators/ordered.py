"""Ordered operators that never need one series in one task.

Every function cuts a series into blocks of its order column, does the window
work inside ``(keys, block)`` and hands only one summary row per block to the
next block. A recording that holds a third of all rows is then spread over as
many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1 << 18


def _block(order: str, block: int) -> Column:
    return F.floor(F.col(order) / F.lit(block)).cast("bigint")


def _sort_key(order: str, tie: Sequence[str]) -> Column:
    return F.struct(order, *tie) if tie else F.col(order)


def neighbour(df: DataFrame, keys: Sequence[str], order: str, cols: dict[str, str], *,
              ahead: bool = False, tie: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Previous (or next, ``ahead=True``) row's values; ``cols`` maps source to new name."""
    keys, tie = list(keys), list(tie)
    step = F.lead if ahead else F.lag
    pick = F.min_by if ahead else F.max_by
    inner = W.partitionBy(*keys, "_blk").orderBy(order, *tie)
    tagged = df.withColumn("_blk", _block(order, block))
    packed = F.struct(*[F.col(c).alias(n) for c, n in cols.items()])
    edge = tagged.groupBy(*keys, "_blk").agg(pick(packed, _sort_key(order, tie)).alias("_edge"))
    edge = edge.select(*keys, "_blk", step("_edge").over(W.partitionBy(*keys).orderBy("_blk")).alias("_carry"))
    out = tagged.withColumn("_near", step(packed).over(inner)).join(edge, [*keys, "_blk"], "left")
    near = F.coalesce("_near", "_carry")
    return out.select(*df.columns, *[near.getField(n).alias(n) for n in cols.values()])


def running(df: DataFrame, keys: Sequence[str], order: str, value: str | Column, name: str, *,
            how: str = "sum", tie: Sequence[str] = (), block: int = BLOCK, inclusive: bool = True) -> DataFrame:
    """Running ``sum``, ``max`` or ``min`` of ``value`` along ``order``."""
    keys, tie = list(keys), list(tie)
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    value = F.col(value) if isinstance(value, str) else value
    tagged = df.withColumn("_blk", _block(order, block)).withColumn("_v", value)
    inner = W.partitionBy(*keys, "_blk").orderBy(order, *tie).rowsBetween(
        W.unboundedPreceding, 0 if inclusive else -1)
    outer = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    totals = tagged.groupBy(*keys, "_blk").agg(agg("_v").alias("_tot"))
    totals = totals.select(*keys, "_blk", agg("_tot").over(outer).alias("_before"))
    out = tagged.withColumn("_in", agg("_v").over(inner)).join(totals, [*keys, "_blk"], "left")
    if how == "sum":
        total = F.coalesce("_in", F.lit(0)) + F.coalesce("_before", F.lit(0))
    elif how == "max":
        total = F.greatest("_in", "_before")
    else:
        total = F.least("_in", "_before")
    return out.select(*df.columns, total.alias(name))


def fill(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, *,
         ahead: bool = False, tie: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Last non-null ``value`` up to this row, or the next one with ``ahead=True``."""
    keys, tie = list(keys), list(tie)
    tagged = df.withColumn("_blk", _block(order, block))
    pick = F.min_by if ahead else F.max_by
    some = F.when(F.col(value).isNotNull(), _sort_key(order, tie))
    edge = tagged.groupBy(*keys, "_blk").agg(pick(F.col(value), some).alias("_edge"))
    w = W.partitionBy(*keys).orderBy("_blk")
    inner = W.partitionBy(*keys, "_blk").orderBy(order, *tie)
    if ahead:
        carry = F.first("_edge", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
        local = F.first(value, ignorenulls=True).over(inner.rowsBetween(0, W.unboundedFollowing))
    else:
        carry = F.last("_edge", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
        local = F.last(value, ignorenulls=True).over(inner.rowsBetween(W.unboundedPreceding, 0))
    edge = edge.select(*keys, "_blk", carry.alias("_carry"))
    out = tagged.withColumn("_in", local).join(edge, [*keys, "_blk"], "left")
    return out.select(*df.columns, F.coalesce("_in", "_carry").alias(name))


def halo(df: DataFrame, keys: Sequence[str], order: str, before: int, after: int, *,
         block: int = BLOCK) -> DataFrame:
    """Copy the rows near a block border into the neighbouring block.

    Adds ``_blk`` and ``_own``. A frame of ``before`` rows back and ``after``
    rows ahead on a dense ``order`` can then run inside ``(keys, _blk)``; keep
    the rows with ``_own``. A wider frame widens the blocks.
    """
    block = max(block, before, after)
    b = _block(order, block)
    touched = F.sequence(F.floor((F.col(order) - F.lit(after)) / block).cast("bigint"),
                         F.floor((F.col(order) + F.lit(before)) / block).cast("bigint"))
    return (df.withColumn("_home", b).withColumn("_blk", F.explode(touched))
            .withColumn("_own", F.col("_blk") == F.col("_home")).drop("_home"))


def frame(df: DataFrame, keys: Sequence[str], order: str, before: int, after: int,
          columns: dict[str, Column], *, block: int = BLOCK) -> DataFrame:
    """Aggregate columns over ``before`` rows back to ``after`` rows ahead of a dense ``order``."""
    w = W.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(-before, after)
    out = halo(df, keys, order, before, after, block=block)
    for name, agg in columns.items():
        out = out.withColumn(name, agg.over(w))
    return out.where("_own").drop("_own", "_blk")


def runs(df: DataFrame, keys: Sequence[str], order: str, state: str, *, tie: Sequence[str] = (),
         block: int = BLOCK) -> DataFrame:
    """Runs of equal ``state``: one row per run with ``first``, ``last`` and ``length``."""
    prev = neighbour(df, keys, order, {state: "_prev"}, tie=tie, block=block)
    change = (F.col("_prev").isNull() | (F.col("_prev") != F.col(state))).cast("bigint")
    islands = running(prev, keys, order, change, "run", tie=tie, block=block)
    return islands.groupBy(*keys, "run", state).agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length"))
