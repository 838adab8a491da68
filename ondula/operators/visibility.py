"""Visibility graphs of long series.

A series is cut into blocks. Edges inside a block come from one kernel call.
For edges between blocks each block has a summary - its upper convex
hull for natural, its maximum for horizontal visibility. Blocks are the leaves of a tree of ``FAN`` children a node, whose summaries are
merged from below. On each level a point looks at the later siblings of the node it lies in; where a summary proves that it sees something
there, it descends from child to child to the blocks that it sees. So no row holds more than ``FAN`` summaries, and a point meets
about ``FAN`` of them on each level, whatever the length of the series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ondula.functions.types import DOUBLES, LONGS
from ondula.operators.attach import attach
from ondula.session import cut

#: Children of a node of the tree of summaries.
FAN = 32
EDGES = T.ArrayType(T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType())]))


def _hull(t: np.ndarray, v: np.ndarray) -> list[int]:
    keep: list[int] = []
    for k in range(len(t)):
        while len(keep) > 1:
            a, b = keep[-2], keep[-1]
            if (v[b] - v[a]) * (t[k] - t[a]) <= (v[k] - v[a]) * (t[b] - t[a]):
                keep.pop()
            else:
                break
        keep.append(k)
    return keep


def _seen(kind: str, ti: np.ndarray, vi: np.ndarray, limit: np.ndarray, t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which points (t, v), all later than their source, are visible past the running obstacle ``limit``."""
    ahead = t[None, :] > ti[:, None]
    if kind == "natural":
        h = np.where(ahead, (v[None, :] - vi[:, None]) / np.where(ahead, t[None, :] - ti[:, None], 1), -np.inf)
    else:
        h = np.where(ahead, np.broadcast_to(v, ahead.shape), -np.inf)
    before = np.maximum.accumulate(np.column_stack([limit, h[:, :-1]]), axis=1)
    clear = ahead & (h > before)
    return clear if kind == "natural" else clear & (before < vi[:, None])


def _sought(kind: str, own: int, t: np.ndarray, v: np.ndarray, run: np.ndarray, children) -> tuple[list[dict], np.ndarray]:
    """(what the points (t, v) ask of the nodes after ``own``, in order; their obstacles behind the last of them). ``children`` has (node, ht, hv)."""
    rows = []
    for node, ht, hv in children:
        if node <= own:
            continue
        ht, hv = np.asarray(ht), np.asarray(hv, dtype=float)
        if kind == "natural":
            best = ((hv[None, :] - v[:, None]) / (ht[None, :] - t[:, None])).max(axis=1)
            go = best > run
        else:
            best = np.full(len(t), hv.max())
            go = (best > run) & (run < v)
        if go.any():
            rows.append({"node": int(node), "ti": t[go].tolist(), "vi": v[go].tolist(), "limit": run[go].tolist()})
        run = np.maximum(run, best)
    return rows, run


def visibility_edges(samples: DataFrame, kind: str = "natural", keys: Sequence[str] = ("recording", "channel"),
                     block: int = 512) -> DataFrame:
    """Edges ``keys, i, j`` with i < j of the natural or horizontal visibility graph."""
    if kind not in ("natural", "horizontal"):
        raise ValueError("kind must be natural or horizontal")
    keys = list(keys)
    packed = samples.groupBy(*keys, F.floor(F.col("t") / block).alias("blk")).agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("_c"))
    packed = cut(packed.select(*keys, "blk", F.col("_c.t").alias("t"), F.col("_c.value").alias("v")))
    first = packed.groupBy(*keys).agg(F.min("blk").alias("_first"))
    blocks = attach(packed, first, keys, ["blk"]).select(*keys, (F.col("blk") - F.col("_first")).alias("node"), "t", "v")

    @F.pandas_udf(T.StructType([T.StructField("edges", EDGES), T.StructField("reach", DOUBLES), T.StructField("ht", LONGS), T.StructField("hv", DOUBLES)]))
    def inside(ts: pd.Series, vs: pd.Series) -> pd.DataFrame:
        out = {"edges": [], "reach": [], "ht": [], "hv": []}
        for t, v in zip(ts, vs):
            t, v = np.asarray(t), np.asarray(v, dtype=float)
            ii, jj = np.nonzero(_seen(kind, t, v, np.full(len(t), -np.inf), t, v))
            out["edges"].append([{"i": int(t[a]), "j": int(t[b])} for a, b in zip(ii, jj)])
            later = t[None, :] > t[:, None]
            h = (v[None, :] - v[:, None]) / np.where(later, t[None, :] - t[:, None], 1) if kind == "natural" else np.broadcast_to(v, later.shape)
            out["reach"].append(np.where(later, h, -np.inf).max(axis=1))
            top = _hull(t, v) if kind == "natural" else [int(np.argmax(v))]
            out["ht"].append(t[top])
            out["hv"].append(v[top])
        return pd.DataFrame(out)

    local = cut(blocks.withColumn("_r", inside("t", "v")).select(*keys, "node", "t", "v", "_r.*"))
    own = local.select(*keys, F.explode("edges").alias("_e")).select(*keys, "_e.i", "_e.j")
    ask = T.ArrayType(T.StructType([T.StructField("node", T.LongType()), T.StructField("ti", LONGS), T.StructField("vi", DOUBLES), T.StructField("limit", DOUBLES)]))

    @F.pandas_udf(T.StructType([T.StructField("rows", ask), T.StructField("reach", DOUBLES)]))
    def look(node: pd.Series, ts: pd.Series, vs: pd.Series, reach: pd.Series, sn: pd.Series, sht: pd.Series, shv: pd.Series) -> pd.DataFrame:
        found = [_sought(kind, n, np.asarray(t), np.asarray(v, dtype=float), np.asarray(m, dtype=float), zip(ids, hts, hvs))
                 for n, t, v, m, ids, hts, hvs in zip(node, ts, vs, reach, sn, sht, shv)]
        return pd.DataFrame({"rows": [rows for rows, _ in found], "reach": [run for _, run in found]})

    @F.pandas_udf(T.StructType([T.StructField("ht", LONGS), T.StructField("hv", DOUBLES)]))
    def merged(hts: pd.Series, hvs: pd.Series) -> pd.DataFrame:
        out = {"ht": [], "hv": []}
        for ht, hv in zip(hts, hvs):
            t, v = np.concatenate([np.asarray(x) for x in ht]), np.concatenate([np.asarray(x, dtype=float) for x in hv])
            top = _hull(t, v) if kind == "natural" else [int(np.argmax(v))]
            out["ht"].append(t[top])
            out["hv"].append(v[top])
        return pd.DataFrame(out)

    children = (F.col("_s.node"), F.col("_s.ht"), F.col("_s.hv"))
    state, hulls = local.select(*keys, "node", "t", "v", "reach"), local.select(*keys, "node", "ht", "hv")
    summaries, asked = [], []
    while True:
        up = F.floor(F.col("node") / FAN).alias("parent")
        summary = cut(hulls.groupBy(*keys, up).agg(F.sort_array(F.collect_list(F.struct("node", "ht", "hv"))).alias("_s")))
        summaries.append(summary)
        level = cut(state.select("*", up).join(summary, [*keys, "parent"]).select(
            *keys, "parent", "t", "v", look("node", "t", "v", "reach", *children).alias("_q")))
        asked.append(level.select(*keys, F.explode("_q.rows").alias("_r")).select(*keys, "_r.*"))
        if not summary.agg(F.max("parent")).first()[0]:
            break
        state = level.select(*keys, F.col("parent").alias("node"), "t", "v", F.col("_q.reach").alias("reach"))
        hulls = summary.select(*keys, F.col("parent").alias("node"), merged("_s.ht", "_s.hv").alias("_h")).select(*keys, "node", "_h.*")
    sent = asked.pop()
    while asked:
        inner = sent.withColumnRenamed("node", "parent").join(summaries[len(asked) - 1], [*keys, "parent"])
        inner = inner.select(*keys, look(F.lit(-1).cast("long"), "ti", "vi", "limit", *children).alias("_q"))
        sent = cut(inner.select(*keys, F.explode("_q.rows").alias("_r")).select(*keys, "_r.*").unionByName(asked.pop()))

    @F.pandas_udf(EDGES)
    def across(ti: pd.Series, vi: pd.Series, limit: pd.Series, ts: pd.Series, vs: pd.Series) -> pd.Series:
        res = []
        for a, x, m, t, v in zip(ti, vi, limit, ts, vs):
            a, t = np.asarray(a), np.asarray(t)
            ii, jj = np.nonzero(_seen(kind, a, np.asarray(x, dtype=float), np.asarray(m, dtype=float), t, np.asarray(v, dtype=float)))
            res.append([{"i": int(a[p]), "j": int(t[q])} for p, q in zip(ii, jj)])
        return pd.Series(res)

    met = sent.join(blocks, [*keys, "node"])
    far = met.select(*keys, F.explode(across("ti", "vi", "limit", "t", "v")).alias("_e")).select(*keys, "_e.i", "_e.j")
    return own.unionByName(far)


def degrees(edges: DataFrame, keys: Sequence[str] = ("recording", "channel")) -> DataFrame:
    ends = edges.select(*keys, F.explode(F.array("i", "j")).alias("node"))
    return ends.groupBy(*keys, "node").agg(F.count("*").alias("degree"))


def mean_degree(edges: DataFrame, samples: DataFrame, keys: Sequence[str] = ("recording", "channel")) -> DataFrame:
    n = samples.groupBy(*keys).agg(F.count("*").alias("_n"))
    e = edges.groupBy(*keys).agg((2 * F.count("*")).alias("_e"))
    return n.join(e, list(keys), "left").select(*keys, (F.coalesce("_e", F.lit(0)) / F.col("_n")).alias("mean_degree"))


def degree_distribution(degree: DataFrame, keys: Sequence[str] = ("recording", "channel")) -> DataFrame:
    return degree.groupBy(*keys, "degree").agg(F.count("*").alias("n"))


def assortativity(edges: DataFrame, degree: DataFrame, keys: Sequence[str] = ("recording", "channel")) -> DataFrame:
    """Pearson between the degrees at both ends of the edges; 0 when either does not vary."""
    d = lambda n, c: degree.select(*keys, F.col("node").alias(n), F.col("degree").alias(c))
    j = edges.join(d("i", "_a"), [*keys, "i"]).join(d("j", "_b"), [*keys, "j"])
    ok = (F.stddev_pop("_a") > 0) & (F.stddev_pop("_b") > 0)
    return j.groupBy(*keys).agg(F.when(ok, F.corr("_a", "_b")).otherwise(0.0).alias("assortativity"))
