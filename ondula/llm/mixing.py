"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, repeated at most ``repeats`` times. A document's virtual finish time is the number of
words its source has sent up to and with it, divided by the source's target; all copies are put in the order of their finish times and
the order is cut where the budget is used up.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ondula.llm.common import look_up, shuffle_hash, source_key, word_count, written

#: Documents that share a bucket of the shuffle or of the finish times, about.
BUCKET = 512
#: Buckets of the finish times that one step of the search for the cut sums up.
STEP = 4096


def cyclic_weights(docs: DataFrame, weights: Sequence[float], source: str = "source") -> DataFrame:
    """Weights by turns for the sources in the order of their code points, null last: (source key, weight)."""
    keys = docs.select(source_key(source).alias("__src")).distinct()
    turn = F.row_number().over(Window.orderBy(F.col("__src") == "", "__src")) - 1
    return keys.select("__src", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")).alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame, share: float = 1.0, repeats: int = 3) -> DataFrame:
    """Words that each source shall give: (__src, source_size, target).

    ``sizes`` is (__src, source_size), ``weights`` (__src, weight). The budget is ``share`` of all words. A source gives at most
    ``repeats`` times its words; what it can't give is shared among the others by weight. In the order of repeats * size / weight the
    sources at their limit come first, so one pass over the table of sources (a row each) finds the level of the rest.
    """
    s = sizes.join(weights, "__src").withColumn("cap", F.lit(repeats) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "__src")
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.col("before")) / F.col("rest"))
    s = s.withColumn("full", F.col("level") * F.col("weight") > F.col("cap"))
    s = s.withColumn("common", F.max(F.when(~F.col("full"), F.struct("rest", "level"))).over(everything)["level"])
    return s.select("__src", "source_size", F.when(F.col("full"), F.col("cap").cast("double"))
                    .otherwise(F.col("common") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id",
        size: str | None = None, share: float = 1.0, repeats: int = 3, seed: str = "mix") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies * size), and ``finish`` of the first copy.

    ``weights`` is (__src, weight) as of ``cyclic_weights``; ``size`` may name a column that already holds the words. Columns of these names
    in ``docs`` are replaced, all others pass through. Null or empty texts have size 0 and are taken 0 times; null sources are one source of
    their own; rows of a source without a weight do not come back; an empty table gives an empty result. Rows with the same key and size are interchangeable, so
    repeated rows count as that many documents. The same rows give the same result however they are partitioned.

    The running sum of a source is cut into buckets of its shuffle hash, whose sums are added up in two levels; so a source with most of
    the rows is spread over all tasks. The cut is found in a histogram of finish times, of which only one bucket is sorted.
    """
    size_of = F.coalesce(F.col(size).cast("long"), F.lit(0)) if size else word_count(text)
    rows = docs.withColumn("size", size_of).withColumn("__src", source_key(source)).withColumn("__hash", shuffle_hash(key, seed))
    rows = rows.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit("")))
    slim = written(rows.select("__src", "__hash", "__key", "size"))
    n = slim.count()
    bits = max(0, math.ceil(math.log2(max(n, 1) / BUCKET)))
    fine, coarse = F.shiftright("__hash", 60 - bits), F.shiftright("__hash", 60 - bits // 2)
    sources = written(targets(slim.groupBy("__src").agg(F.sum("size").alias("source_size")), weights, share, repeats))

    sums = slim.groupBy("__src", coarse.alias("__c"), fine.alias("__b")).agg(F.sum("size").alias("s"))
    above = sums.groupBy("__src", "__c").agg(F.sum("s").alias("s"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    above = above.withColumn("o", F.coalesce(F.sum("s").over(before.partitionBy("__src").orderBy("__c")), F.lit(0))).drop("s")
    sums = sums.withColumn("p", F.coalesce(F.sum("s").over(before.partitionBy("__src", "__c").orderBy("__b")), F.lit(0)))
    offsets = written(sums.join(above, ["__src", "__c"]).select("__src", "__b", (F.col("o") + F.col("p")).alias("__before")))

    def queued(df: DataFrame) -> DataFrame:
        own = Window.partitionBy("__src", "__b").orderBy("__hash", "__key", "size").rowsBetween(Window.unboundedPreceding, 0)
        df = df.drop("source_size", "target").withColumn("__b", fine).join(offsets, ["__src", "__b"])
        df = df.withColumn("__run", F.col("__before") + F.sum("size").over(own))
        return look_up(df, sources, ["__src"], 256).withColumn("finish", F.col("__run") / F.nullif(F.col("target"), F.lit(0.0)))

    last = _cut(written(queued(slim).where("size > 0 and target > 0")
                        .select("__src", "__hash", "__key", "size", "__run", "source_size", "target")), n, share, repeats)
    at = F.struct(*[F.lit(x).cast(t) for x, t in zip(last[1:], ("string", "long", "string", "long", "int"))])
    out = queued(rows)
    copies = F.lit(0)
    for e in range(repeats):
        t = (F.col("__run") + F.lit(e) * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0))
        tie = F.struct("__src", "__hash", "__key", "size", F.lit(e)) <= at
        copies = copies + F.when((F.col("size") > 0) & ((t < last[0]) | ((t == last[0]) & tie)), 1).otherwise(0)
    out = out.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("__src", "__b", "__hash", "__key", "__before", "__run")


def _cut(queue: DataFrame, n: int, share: float, repeats: int) -> tuple:
    """The last copy within the budget: (finish time, source, hash, key, size, copy). One row at a time comes to the driver."""
    epochs = queue.withColumn("e", F.explode(F.array(*[F.lit(e) for e in range(repeats)])))
    epochs = epochs.withColumn("t", (F.col("__run") + F.col("e") * F.col("source_size")) / F.col("target"))
    per = STEP * max(1, math.ceil(max(n, 1) / (BUCKET / 4 * STEP)))
    epochs = epochs.withColumn("b", F.floor(F.col("t") / (1 + F.col("t")) * per).cast("long"))
    budget = queue.agg(F.sum("size")).first()[0]
    budget = math.floor(share * budget) if budget else 0
    nothing = (-1.0, "", 0, "", 0, 0)
    if not budget:
        return nothing
    histogram = written(epochs.groupBy("b").agg(F.sum("size").alias("s")))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    spent, at = 0, None
    for width in (per // STEP, 1):
        part = histogram if at is None else histogram.where(F.floor(F.col("b") / (per // STEP)) == at)
        run = part.groupBy(F.floor(F.col("b") / width).alias("b")).agg(F.sum("s").alias("s")).withColumn("run", F.sum("s").over(before))
        over = run.where(F.col("run") > budget - spent).orderBy("b").limit(1).collect()
        if not over:
            return (math.inf, "", 0, "", 0, 0)
        at, spent = over[0]["b"], spent + over[0]["run"] - over[0]["s"]
    order = ["t", "__src", "__hash", "__key", "size", "e"]
    inside = epochs.where(F.col("b") == at).withColumn("run", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    best = inside.where(F.col("run") <= budget - spent).orderBy(*[F.desc(c) for c in order]).limit(1).collect()
    if not best:  # the cut lies at the start of this bucket
        best = epochs.where(F.col("b") < at).orderBy(*[F.desc(c) for c in order]).limit(1).collect()
    return tuple(best[0][c] for c in order) if best else nothing


def emitted(mixed: DataFrame) -> DataFrame:
    """One row for each copy that the mix takes, with ``epoch`` (0, 1, ...): the corpus itself."""
    return mixed.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
