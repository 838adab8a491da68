"""Query registry: a Spark plan, its output columns and, where SQL can say it, the oracle.

The column list drives both sides. ``i:l r:6 name`` means ``i`` as BIGINT,
``r`` as DOUBLE rounded to six digits and ``name`` as STRING; ``:b`` is BOOLEAN.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    columns: tuple[tuple[str, str], ...]
    sql: str | None
    many: bool = False

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.plan(spark, sf_dir).select(*[_spark_column(n, k, self.many) for n, k in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return f"SELECT {', '.join(_sql_column(n, k) for n, k in self.columns)} FROM ({self.sql}) AS q"


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None, many: bool = False) -> Callable[[Plan], Plan]:
    """``many``: the result has a row per pair, so rounding is most of the work."""
    spec = tuple(tuple(c.split(":")) if ":" in c else (c, "s") for c in columns.split())

    def register(plan: Plan) -> Plan:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, plan, spec, sql, many)
        return plan

    return register


def rounded(c: Column, digits: int) -> Column:
    """``round`` of doubles, digit for digit, without a decimal number per value: only products that are near a half or large need one."""
    unit = F.lit(10.0 ** digits)
    product = c * unit
    clear = (F.abs(product) < F.lit(2.0 ** 40)) & (F.abs(product - F.floor(product) - 0.5) > 1e-3)
    return F.when(clear, F.floor(product + 0.5) / unit).otherwise(F.round(c, digits))


def _spark_column(name: str, kind: str, many: bool = False):
    c = F.col(name)
    if kind == "l":
        return c.cast("bigint").alias(name)
    if kind == "b":
        return c.cast("boolean").alias(name)
    if kind == "s":
        return c.cast("string").alias(name)
    return ((rounded if many else F.round)(c.cast("double"), int(kind)) + F.lit(0.0)).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "l":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "b":
        return f"CAST({name} AS BOOLEAN) AS {name}"
    if kind == "s":
        return f"CAST({name} AS VARCHAR) AS {name}"
    return f"round(CAST({name} AS DOUBLE), {kind}) + 0.0 AS {name}"
