"""Exact, linearly interpolated quantiles of groups of any size and any distribution.

The built-in ``percentile`` keeps every distinct value of a group in one task. Here each task summarises its rows in a mergeable
quantile sketch (the one behind ``percentile_approx``). The sketch gives two values around each wanted rank, close together by rank however
the values are spread, so one outlier changes nothing. A second pass counts what lies below and above and, value by value, the few rows between them. The counts
are exact: if a rank is not between its two values, they are moved apart and counted again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ondula.operators.attach import attach
from ondula.session import cut

#: Ranks are found to about 1/10,000 of a group.
ACCURACY = 10_000
#: Parts into which splitters cut a group, a power of two.
PARTS = 1 << 10


def splitters(df: DataFrame, keys: Sequence[str], value: str, parts: int = PARTS) -> DataFrame:
    """``keys`` and ``_splits``: ascending values that cut each group into up to ``parts`` parts of about equal numbers of rows."""
    cuts = F.percentile_approx(F.col(value), [i / parts for i in range(1, parts)], 4 * parts)
    return df.groupBy(*keys).agg(F.array_sort(F.array_distinct(cuts)).alias("_splits"))


def part_of(value: Column, splits: Column, parts: int = PARTS) -> Column:
    """The number of splitters that are not above ``value``, by bisection."""
    steps = F.array(*[F.lit(parts >> k) for k in range(1, parts.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(F.get(splits, at + s - 1) <= value, s).otherwise(0))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], *, weight: str | None = None,
              also: Sequence[Column] = (), accuracy: int = ACCURACY) -> DataFrame:
    """``keys`` plus one column per entry of ``probs``; NULL and NaN values are left out, groups without others too.

    ``weight`` counts a row that many times. ``also`` are aggregates over all rows of a group, taken in the same pass. The input is
    read twice, with a weight three times; cut it first when it is costly to make.
    """
    keys = list(keys)
    by = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    v = F.col(value).cast("double")
    usable = F.when(~F.isnan(v), v)
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    names = list(probs)
    reach = 2 / accuracy
    counted = [F.sum(F.when(usable.isNotNull(), w)).alias("_n"), F.min(usable).alias("_lo"), F.max(usable).alias("_hi"), *also]
    if weight is None:
        ends = [min(1.0, max(0.0, p + side)) for p in probs.values() for side in (-reach, reach)]
        counted.append(F.percentile_approx(usable, ends, accuracy).alias("_ends"))
    span = cut(rows.groupBy(*by).agg(*counted)).where("_n > 0")
    v_w = rows.select(*by, v.alias("_v"), w.alias("_w")).where("_v IS NOT NULL AND NOT isnan(_v)")
    if weight is not None:
        span = span.join(_weighted_ends(v_w, span, by, list(probs.values())), by)
    extra = [c for c in span.columns if c not in (*by, "_n", "_lo", "_hi", "_ends")]
    while True:
        ends = [(F.get("_ends", F.lit(2 * i)), F.get("_ends", F.lit(2 * i + 1))) for i in range(len(names))]
        near = attach(v_w, span.select(*by, "_ends"), by, ["_v"], written=True)
        inside = F.lit(False)
        sides = []
        for i, (lo, hi) in enumerate(ends):
            here = F.col("_v").between(lo, hi)
            inside = inside | here
            low, high = F.col("_v") < lo, F.col("_v") > hi
            sides += [F.sum(F.when(low, F.col("_w")).otherwise(0)).alias(f"_b{i}"), F.sum(F.when(here, F.col("_w")).otherwise(0)).alias(f"_i{i}"), F.max(F.when(low, F.col("_v"))).alias(f"_m{i}"),
                      F.min(F.when(high, F.col("_v"))).alias(f"_a{i}")]
        table = cut(near.groupBy(*by, F.when(inside, F.col("_v")).alias("_at")).agg(F.sum("_w").alias("_c"), *sides))
        total = table.groupBy(*by).agg(*[f(f"{c}{i}").alias(f"{c}{i}") for i in range(len(names)) for c, f in (("_b", F.sum), ("_i", F.sum), ("_m", F.max), ("_a", F.min))])
        wanted = []
        for i, name in enumerate(names):
            pos = F.lit(float(probs[name])) * (F.col("_n") - 1)
            low = F.floor(pos).cast("bigint")
            for rank, share in ((low, 1 - (pos - low)), (F.least(low + 1, F.col("_n") - 1), pos - low)):
                wanted.append(F.struct(F.lit(name).alias("q"), ends[i][0].alias("_from"), ends[i][1].alias("_to"), rank.alias("rank"), share.alias("w"),
                                       F.col(f"_b{i}").alias("_b"), (F.col(f"_b{i}") + F.col(f"_i{i}")).alias("_last"), F.col(f"_m{i}").alias("_m"), F.col(f"_a{i}").alias("_a")))
        ranks = cut(span.join(total, by).select(*by, F.inline(F.array(*wanted))).where("w > 0"))
        if ranks.where((F.col("rank") < F.col("_b") - 1) | (F.col("rank") > F.col("_last"))).isEmpty():
            break
        span = span.withColumn("_ends", F.flatten(F.array(*[F.array("_lo", "_hi") for _ in names])))
    runs = ranks.select(*by, "q", "_from", "_to", "_b").distinct().join(table.where("_at IS NOT NULL").select(*by, "_at", "_c"), by).where("_at BETWEEN _from AND _to")
    runs = runs.withColumn("_e", F.col("_b") + F.sum("_c").over(W.partitionBy(*by, "q").orderBy("_at")))
    hit = runs.join(ranks.select(*by, "q", "rank", "w"), [*by, "q"]).where("rank < _e AND rank >= _e - _c").select(*by, "q", "w", "_at")
    edge = F.when(F.col("rank") < F.col("_b"), F.col("_m")).when(F.col("rank") >= F.col("_last"), F.col("_a"))
    outside = ranks.where("rank < _b OR rank >= _last").select(*by, "q", "w", edge.alias("_at"))
    out = hit.unionByName(outside).groupBy(*by).agg(*[F.sum(F.when(F.col("q") == name, F.col("w") * F.col("_at"))).alias(name) for name in names])
    if extra:
        out = span.select(*by, *extra).join(out, by)
    return out if keys else out.drop("_all")


def _weighted_ends(v: DataFrame, span: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """``_ends`` for rows ``_v`` that count ``_w`` times: the borders of the parts in which the wanted ranks lie."""
    cuts = splitters(v, keys, "_v")
    hist = attach(v, cuts, keys, ["_v"]).groupBy(*keys, part_of(F.col("_v"), F.col("_splits")).alias("_part")).agg(
        F.sum("_w").alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    end = F.sum("_c").over(W.partitionBy(*keys).orderBy("_part"))
    hist = hist.withColumn("_e", end).join(span.select(*keys, "_n"), keys)
    ends = []
    for p in probs:
        rank = F.floor(F.lit(float(p)) * (F.col("_n") - 1))
        holds = (F.col("_e") > rank) & (F.col("_e") - F.col("_c") <= rank + 1)
        ends += [F.min(F.when(holds, F.col("_from"))), F.max(F.when(holds, F.col("_to")))]
    return cut(hist.groupBy(*keys).agg(F.array(*ends).alias("_ends")))


def small_median_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and MAD of groups that are small by nature: channels of a recording, transients of a scan."""
    keys = list(keys)
    med = df.groupBy(*keys).agg(F.median(value).alias("med"))
    dev = df.join(med, keys).groupBy(*keys).agg(F.first("med").alias("med"), F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    return dev


def median_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and median absolute deviation per group of any size."""
    keys = list(keys)
    base = df if keys else df.withColumn("_g", F.lit(0))
    k = keys or ["_g"]
    med = cut(quantiles(base, k, value, {"med": 0.5}))
    dev = attach(base.select(*k, value), med, k, [value], written=True).withColumn("_dev", F.abs(F.col(value) - F.col("med")))
    out = med.join(quantiles(dev, k, "_dev", {"mad": 0.5}), k)
    return out if keys else out.drop("_g")
