"""One model per key, all keys in one plan.

Parameters are a table with one row per key. Sums over the data come as one
small matrix per task and key, solves run on the parameter rows, and iterations
drop the keys that have converged. A key may hold any share of the rows: frames
are packed into blocks, and parameters meet blocks, never groups. Rows with a NULL
key belong to no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ondula.operators import gram as G
from ondula.operators import matrix as M
from ondula.operators.attach import SMALL_BYTES, attach, table_bytes
from ondula.session import cut

BLOCK = 1024
DOUBLES = "array<double>"
MATRIX = "array<array<double>>"


# -------------------------------------------------------------------- parameters


def moments(frames: DataFrame, keys: Sequence[str] = ("recording",), x: str = "x") -> DataFrame:
    """Count, mean and covariance of every key in one row: ``keys, n, mean, cov``."""
    g = G.gram(frames, keys, x).select(*keys, "i", "n", "mean_i", "j", "cov")
    rows = g.groupBy(*keys, "i", "n", "mean_i").agg(F.sort_array(F.collect_list(F.struct("j", "cov"))).alias("_r"))
    m = rows.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("i", "mean_i", F.col("_r.cov").alias("row")))).alias("_m"))
    return m.select(*keys, "n", F.col("_m.mean_i").alias("mean"), F.col("_m.row").alias("cov"))


def _matrix(v) -> np.ndarray:
    return np.stack([np.asarray(r, dtype=float) for r in v])


def _solve(rows: DataFrame, inputs: Sequence[str], schema: str, solve: Callable[..., dict]) -> DataFrame:
    """``rows`` with the fields of ``schema`` that ``solve`` gives for the ``inputs`` of each row."""
    fields = T.StructType.fromDDL(schema).names

    @F.pandas_udf(schema)
    def run(*cols: pd.Series) -> pd.DataFrame:
        got = [solve(*v) for v in zip(*cols)]
        return pd.DataFrame({f: pd.Series([_plain(g[f]) for g in got], dtype=object) for f in fields})

    return rows.withColumn("_f", run(*[F.col(c) for c in inputs])).select(*[c for c in rows.columns if c not in fields], "_f.*")


def _plain(v):
    if isinstance(v, np.ndarray):
        return v.tolist()
    return v.item() if isinstance(v, np.generic) else v


# ------------------------------------------------------------------------ blocks


def pack(frames: DataFrame, keys: Sequence[str], x: str = "x", size: int = BLOCK) -> DataFrame:
    """Frames of a key that a task has side by side as one row: ``keys, rows, block``; nothing is shuffled, NULL frames are left out.

    ``rows`` holds the other columns as structs, ``block`` the values of all frames in their order.
    """
    keys = list(keys)
    other = [c for c in frames.columns if c not in keys and c != x]
    kinds = T.StructType([frames.schema[c] for c in other] or [T.StructField("_none", T.IntegerType())])
    schema = T.StructType([*[frames.schema[k] for k in keys], T.StructField("rows", T.ArrayType(kinds)), T.StructField("block", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, rows in G.key_slices(batch, keys):
                for a in range(0, len(rows), size):
                    part = batch.take(pa.array(rows[a:a + size]))
                    n = part.num_rows
                    cols = [part.column(c) for c in other] or [pa.nulls(n, pa.int32())]
                    structs = pa.StructArray.from_arrays(cols, names=kinds.names)
                    ends = pa.array([0, n], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array([v], type=batch.schema.field(k).type) for v, k in zip(key, keys)], pa.ListArray.from_arrays(ends, structs),
                         G._lists(G.matrix_of(part.column(x)).reshape(1, -1))], names=schema.names)

    return frames.where(F.col(x).isNotNull()).mapInArrow(run, schema)


def _applied(frames: DataFrame, model: DataFrame, keys: Sequence[str], x: str, offset: str, weights: str, product: Callable) -> DataFrame:
    """``frames`` with ``x`` replaced by ``product(block, offset, weights)`` of the parameters of their key; frames without a model are left out."""
    keys = list(keys)
    other = [c for c in frames.columns if c not in keys and c != x]
    blocks = attach(pack(frames, keys, x), model.select(*keys, F.col(offset).alias("_o"), F.col(weights).alias("_w")), keys, ["block"])

    @F.pandas_udf(MATRIX)
    def rows(block: pd.Series, o: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for b, m, v in zip(block, o, w):
            m, v = np.asarray(m, dtype=float), _matrix(v)
            out.append(list(product(np.asarray(b, dtype=float), m, v)))
        return pd.Series(out)

    long = blocks.select(*keys, F.explode(F.arrays_zip("rows", rows("block", "_o", "_w").alias("x"))).alias("_z"))
    values = {c: F.col(f"_z.rows.{c}").alias(c) for c in other} | {x: F.col("_z.x").alias(x)}
    return long.select(*[F.col(c) if c in keys else values[c] for c in frames.columns])


def transform(frames: DataFrame, model: DataFrame, keys: Sequence[str] = ("recording",), x: str = "x", weights: str = "vectors") -> DataFrame:
    """Scores W (x - mean) with the weights of each frame's key."""
    return _applied(frames, model, keys, x, "mean", weights, lambda b, m, w: (b.reshape(-1, len(m)) - m) @ w.T)


def inverse(scores: DataFrame, model: DataFrame, keys: Sequence[str] = ("recording",), x: str = "x", weights: str = "vectors") -> DataFrame:
    """Frames W^T s + mean from the scores of orthogonal weights; ``restore`` is its counterpart for ``fast_ica``."""
    return _applied(scores, model, keys, x, "mean", weights, lambda b, m, w: b.reshape(-1, len(w)) @ w + m)


def restore(sources: DataFrame, model: DataFrame, keys: Sequence[str] = ("recording",), x: str = "x") -> DataFrame:
    """Frames from the sources of ``fast_ica``: the mixing matrix of each key and its mean."""
    return _applied(sources, model, keys, x, "mean", "mixing", lambda b, m, w: b.reshape(-1, w.shape[1]) @ w.T + m)


# ------------------------------------------------------------------------ models


def principal(frames: DataFrame, keys: Sequence[str] = ("recording",), n: int | None = None, share: float | None = None, x: str = "x") -> DataFrame:
    """Principal components of every key: ``keys, n, mean, values, vectors``; their number as in the model of one key, key by key."""
    def solve(count: int, mean: np.ndarray, cov: np.ndarray) -> dict:
        lam, vec = M.Moments(int(count), np.asarray(mean), _matrix(cov)).eigen
        keep = n or len(lam)
        if share is not None:
            keep = min(keep, int(np.searchsorted(np.cumsum(lam) / lam.sum(), share - 1e-12) + 1))
        return {"values": lam[:keep], "vectors": vec[:keep]}

    m = moments(frames, keys, x)
    return cut(_solve(m, ["n", "mean", "cov"], f"values {DOUBLES}, vectors {MATRIX}", solve).drop("cov"))


def _sums(blocks: DataFrame, keys: list[str], inputs: Sequence[str], kernel: Callable[..., np.ndarray]) -> DataFrame:
    """Sum of ``kernel(*inputs)``, a vector for each row, over the rows of each key: ``keys, s``. Tasks add up what they see of a key first."""
    fields = [blocks.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for key, v in sums.items():
                cols = [pa.array([k], type=t) for k, t in zip(key, types)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([0], pa.int32()), G._lists(v[None, :])], names=[*keys, "i", "row"])
            sums.clear()

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            cols = [batch.column(c) for c in inputs]
            for key, rows in G.key_slices(batch, keys):
                for r in rows:
                    v = kernel(*[_value(c[int(r)]) for c in cols])
                    sums[key] = sums[key] + v if key in sums else v
            if len(sums) > G.KEYS_PER_TASK:
                yield from flush()
        yield from flush()

    part = blocks.select(*keys, *inputs).mapInArrow(run, ", ".join([*G._ddl(fields), "i int", "row array<double>"]))
    return G._merged(part, keys, lambda a, b: a + b).select(*keys, F.col("row").alias("s"))


def _value(cell: pa.Scalar) -> np.ndarray | float:
    return cell.values.to_numpy(zero_copy_only=False) if isinstance(cell, pa.ListScalar) else cell.as_py()


def _until_done(state: DataFrame, keys: list[str], max_iter: int, rows: DataFrame, data: str, parameter: str, kernel: Callable,
                solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Repeat, for the keys of ``state`` that are not ``done``: sum ``kernel(data, parameter)`` over ``rows``, then ``solve`` the parameter.

    Counts steps in ``iterations``. Every state is written; keys that are done wait in theirs. The size of the parameters is measured once, as keys only leave.
    """
    def sums(live: DataFrame) -> DataFrame:
        of = live.select(*keys, parameter)
        both = rows.join(F.broadcast(of), keys) if small else attach(rows, of, keys, [data], written=True)
        return live.drop("done").join(_sums(both, keys, [data, parameter], kernel), keys)

    live, over = cut(state.withColumn("iterations", F.lit(0)).withColumn("done", F.lit(False))), []
    small = table_bytes(live) <= SMALL_BYTES
    for _ in range(max_iter):
        live = cut(solve(sums(live)).withColumn("iterations", F.col("iterations") + 1))
        left = live.where("NOT done").count()
        over.append(live.where("done"))
        live = live.where("NOT done")
        if not left:
            break
    out = live
    for o in over:
        out = out.unionByName(o)
    return cut(out.withColumnRenamed("done", "converged"))


def fast_ica(frames: DataFrame, keys: Sequence[str] = ("recording",), n: int | None = None, max_iter: int = 200, tol: float = 1e-4, seed: int = 0,
             x: str = "x") -> DataFrame:
    """Parallel log-cosh FastICA of every key: ``keys, mean, unmixing, mixing, iterations, converged``.

    One pass over the whitened blocks of the keys that have not converged per iteration. Every key starts from the same rotation as a
    model of its own would, so a fit with others equals a fit alone.
    """
    keys = list(keys)

    def white(mean: np.ndarray, cov: np.ndarray) -> dict:
        lam, vec = M.Moments(0, np.asarray(mean), _matrix(cov)).eigen
        k = n or M.variance_rule(lam)
        lam, vec = np.maximum(lam[:k], 1e-12), vec[:k]
        start = M._decorrelate(np.random.default_rng(seed).normal(size=(k, k)))
        return {"white": vec / np.sqrt(lam)[:, None], "back": vec.T * np.sqrt(lam), "w": start.ravel()}

    def update(s: np.ndarray, w: np.ndarray) -> dict:
        k = int(round(len(w) ** 0.5))
        s, w = np.asarray(s, dtype=float).reshape(k, k + 2), np.asarray(w, dtype=float).reshape(k, k)
        new = M._decorrelate(s[:, :k] / s[0, k + 1] - s[:, [k]] / s[0, k + 1] * w)
        return {"w": new.ravel(), "done": bool(np.max(np.abs(1 - np.abs(np.sum(new * w, axis=1)))) < tol)}

    def kernel(block: np.ndarray, w: np.ndarray) -> np.ndarray:
        k = int(round(len(w) ** 0.5))
        m, w = block.reshape(-1, k), w.reshape(k, k)
        g = np.tanh(m @ w.T)
        return np.column_stack([g.T @ m, (1 - g * g).sum(axis=0), np.full(k, len(m), dtype=float)]).ravel()

    model = cut(_solve(moments(frames, keys, x), ["mean", "cov"], f"white {MATRIX}, back {MATRIX}, w {DOUBLES}", white).drop("cov", "n"))
    blocks = cut(pack(transform(frames.select(*keys, x), model, keys, x, "white"), keys, x).select(*keys, "block"))

    step = lambda both: _solve(both, ["s", "w"], f"w {DOUBLES}, done boolean", update).drop("s")

    def finish(white: np.ndarray, back: np.ndarray, w: np.ndarray) -> dict:
        rot = np.asarray(w, dtype=float).reshape(len(white), -1)
        return {"unmixing": rot @ _matrix(white), "mixing": _matrix(back) @ rot.T}

    fit = _until_done(model.select(*keys, "w"), keys, max_iter, blocks, "block", "w", kernel, step)
    return cut(_solve(model.drop("w").join(fit, keys), ["white", "back", "w"], f"unmixing {MATRIX}, mixing {MATRIX}", finish).select(
        *keys, "mean", "unmixing", "mixing", "iterations", "converged"))


def covariance_mean(covs: DataFrame, keys: Sequence[str], c: str = "c", max_iter: int = 50, tol: float = 1e-6) -> DataFrame:
    """Geometric mean of the flattened matrices of every key: ``keys, mean, iterations, converged``."""
    keys = list(keys)
    rows = cut(covs.where(F.col(c).isNotNull()).select(*keys, F.col(c).cast(DOUBLES).alias("_c")))

    def average(s: np.ndarray) -> dict:
        s = np.asarray(s, dtype=float)
        return {"mean": s[:-1] / s[-1]}

    def kernel(m: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return np.append(M.log_map(M._square(m), M._square(mean)).ravel(), 1.0)

    def update(s: np.ndarray, mean: np.ndarray) -> dict:
        s = np.asarray(s, dtype=float)
        move = M._square(s[:-1] / s[-1])
        return {"mean": M.exp_map(move, M._square(mean)).ravel(), "done": bool(np.linalg.norm(move) <= tol)}

    step = lambda both: _solve(both, ["s", "mean"], f"mean {DOUBLES}, done boolean", update).drop("s")
    first = _sums(rows, keys, ["_c"], lambda m: np.append(m, 1.0))
    return _until_done(_solve(first, ["s"], f"mean {DOUBLES}", average).drop("s"), keys, max_iter, rows, "_c", "mean", kernel, step)
