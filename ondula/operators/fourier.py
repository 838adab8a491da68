"""Discrete Fourier transforms of series of any length.

A series up to ``LIMIT`` samples is transformed by one numpy call. A longer
one is laid out as an n1 x n2 grid: the columns are transformed, twiddled and
regrouped, then the rows are transformed. No task ever holds more than about
sqrt(n) values of one series. A length without a usable factor goes through
the chirp form, which needs only power-of-two transforms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondula.functions.types import doubles
from ondula.operators.attach import attach
from ondula.operators.gram import Rows
from ondula.session import cut

LIMIT = 1 << 16
PIECE = 1 << 18  # values that leave a worker at a time


@F.arrow_udf(doubles("re", "im"))
def _dft(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Transform of each array row placed at ``idx`` in ``n`` zeros; sign -1 forward, +1 unscaled inverse.

    Results leave in pieces of about ``PIECE`` values, so a worker holds the batch it reads and one piece, not the transforms of the whole batch.
    """
    def piece(done: list[np.ndarray]) -> pa.Array:
        ends = pa.array(np.cumsum([0, *map(len, done)]).astype(np.int32))
        z = np.concatenate(done)
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(v))) for v in (z.real, z.imag)], names=["re", "im"])

    for *points, n, sign in batches:
        done, held = [], 0
        columns = [Rows(c) for c in points]
        for row, (size, s) in enumerate(zip(n.to_pylist(), sign.to_pylist())):
            i, a, b = (c[row] for c in columns)
            z = np.zeros(size, dtype=complex)
            z[i] = a + 1j * b
            done.append(np.fft.fft(z) if s < 0 else np.fft.ifft(z) * size)
            held += size
            if held >= PIECE:
                yield piece(done)
                done, held = [], 0
        if done:
            yield piece(done)


def _stage(rows: DataFrame, group: list[str], idx: str, size: Column, sign: int, out: str) -> DataFrame:
    packed = rows.groupBy(*group).agg(F.collect_list(F.struct(idx, "re", "im")).alias("_c"))
    f = packed.select(*group, _dft(F.col(f"_c.{idx}"), F.col("_c.re"), F.col("_c.im"), size, F.lit(sign)).alias("_f"))
    return f.select(*group, F.posexplode(F.arrays_zip("_f.re", "_f.im")).alias(out, "_z")).select(
        *group, out, F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))


def _grid(rows: DataFrame, keys: list[str], sign: int) -> DataFrame:
    """Transform rows ``keys, n, n1, n2, t, re, im`` by columns, then by rows."""
    g = [*keys, "n", "n1", "n2"]
    r = rows.withColumn("_a", F.floor(F.col("t") / F.col("n2")).cast("bigint")).withColumn("_b", F.col("t") % F.col("n2"))
    one = _stage(r, [*g, "_b"], "_a", F.col("n1"), sign, "_k1")
    phi = sign * 2 * math.pi * (F.col("_b") * F.col("_k1")) / F.col("n")
    c, s = F.cos(phi), F.sin(phi)
    one = one.select(*g, "_b", "_k1", (F.col("re") * c - F.col("im") * s).alias("re"), (F.col("re") * s + F.col("im") * c).alias("im"))
    two = _stage(one, [*g, "_k1"], "_b", F.col("n2"), sign, "_k2")
    return two.select(*keys, "n", (F.col("_k1") + F.col("n1") * F.col("_k2")).cast("bigint").alias("k"), "re", "im")


def _split(n: int, limit: int) -> tuple[int, int]:
    d = next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0)
    return d, n // d


def _chirp(rows: DataFrame, keys: list[str], sign: int, dims: DataFrame) -> DataFrame:
    """Any length by convolution with a chirp on a power-of-two grid ``m`` >= 2 n.

    The chirp depends on the length alone: it is made and transformed once per length of ``dims``, and met by a shuffle, for the planner takes its rows for few.
    """
    half = lambda t: sign * math.pi * ((t * t) % (2 * F.col("n"))) / F.col("n")
    turn = lambda re, im, p: ((re * F.cos(p) - im * F.sin(p)).alias("re"), (re * F.sin(p) + im * F.cos(p)).alias("im"))
    re, im = F.col("re"), F.col("im")
    a = rows.select(*keys, "n", "n1", "n2", "t", *turn(re, im, half(F.col("t"))))
    fa = _grid(a.withColumnRenamed("n", "_n").withColumn("n", F.col("n1") * F.col("n2")), [*keys, "_n"], -1)
    b = dims.select(F.col("n").alias("_n"), "n1", "n2").withColumn("_u", F.explode(F.sequence(1 - F.col("_n"), F.col("_n") - 1, F.lit(LIMIT).cast("bigint"))))
    b = b.withColumn("_u", F.explode(F.sequence(F.col("_u"), F.least(F.col("_u") + LIMIT, F.col("_n")) - 1)))
    m = F.col("n1") * F.col("n2")
    ph = -sign * math.pi * ((F.col("_u") * F.col("_u")) % (2 * F.col("_n"))) / F.col("_n")
    b = b.select("_n", "n1", "n2", m.alias("n"), F.pmod("_u", m).alias("t"), F.cos(ph).alias("re"), F.sin(ph).alias("im"))
    fb = _grid(b, ["_n"], -1).select("_n", "k", F.col("re").alias("_br"), F.col("im").alias("_bi"))
    p = fa.join(fb.hint("merge"), ["_n", "k"]).select(
        *keys, "_n", "n", F.col("k").alias("t"), (re * F.col("_br") - im * F.col("_bi")).alias("re"), (re * F.col("_bi") + im * F.col("_br")).alias("im"))
    p = p.withColumn("_l", F.floor(F.log2("n") / 2).cast("int")).withColumn("n1", F.expr("shiftleft(1L, _l)")).withColumn(
        "n2", (F.col("n") / F.col("n1")).cast("bigint"))
    y = _grid(p, [*keys, "_n"], 1).where(F.col("k") < F.col("_n")).select(
        *keys, F.col("_n").alias("n"), "k", (re / F.col("n")).alias("re"), (im / F.col("n")).alias("im"))
    return y.select(*keys, "n", "k", *turn(re, im, half(F.col("k"))))


def lengths(rows: DataFrame, keys: Sequence[str], limit: int = LIMIT) -> tuple[DataFrame, list[int]]:
    """The length of every series (written), and the distinct lengths beyond the limit, a handful of numbers."""
    n = cut(rows.groupBy(*keys).agg((F.max("t") + 1).cast("bigint").alias("n")))
    return n, [r[0] for r in n.where(F.col("n") > limit).select("n").distinct().collect()]


def dft(rows: DataFrame, keys: Sequence[str], inverse: bool = False, limit: int = LIMIT,
        known: tuple[DataFrame, list[int]] | None = None) -> DataFrame:
    """Transform of rows ``keys, t, re, im`` (t from 0, dense) to ``keys, n, k, re, im``.

    The inverse takes ``keys, n, k, re, im`` and gives ``keys, n, t, re, im``,
    scaled by 1 / n. The lengths of the long series, a handful of numbers,
    choose their layout on the driver; who has them ``known`` saves a pass over
    the rows, and the inverse a run of the plan before it.
    """
    keys = list(keys)
    if inverse:
        base = rows.select(*keys, "n", F.col("k").alias("t"), "re", "im")
        long = known[1] if known else [r[0] for r in base.where(F.col("n") > limit).select("n").distinct().collect()]
    else:
        n, long = known or lengths(rows, keys, limit)
        base = attach(rows, n, keys, ["t"], written=True).select(*keys, "n", F.col("t").cast("bigint").alias("t"), "re", "im")
    sign = 1 if inverse else -1
    grid, chirp = {}, {}
    for size in map(int, long):
        n1, n2 = _split(size, limit)
        if n2 <= limit:
            grid[size] = (n1, n2)
        else:
            bits = (2 * size - 1).bit_length()
            chirp[size] = (1 << (bits // 2), 1 << (bits - bits // 2))
    one = base if not (grid or chirp) else base.where(F.col("n") <= limit)
    parts = [_stage(one, [*keys, "n"], "t", F.col("n"), sign, "k")]
    for layout, how in ((grid, _grid), (chirp, _chirp)):
        if layout:
            dims = rows.sparkSession.createDataFrame([(s, a, b) for s, (a, b) in layout.items()], "n bigint, n1 bigint, n2 bigint")
            parts.append(how(base.join(F.broadcast(dims), "n"), keys, sign, *([dims] if how is _chirp else [])))
    out = parts[0].select(*keys, "n", "k", "re", "im")
    for p in parts[1:]:
        out = out.unionByName(p.select(*keys, "n", "k", "re", "im"))
    if not inverse:
        return out
    return out.select(*keys, "n", F.col("k").alias("t"), (F.col("re") / F.col("n")).alias("re"), (F.col("im") / F.col("n")).alias("im"))


def real_rows(samples: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return samples.select(*keys, "t", F.col(value).alias("re"), F.lit(0.0).alias("im"))


def bin_frequency(fs: float) -> Column:
    """Absolute frequency of bin k of n."""
    return F.least("k", F.col("n") - F.col("k")) * fs / F.col("n")


def spectral_map(samples: DataFrame, keys: Sequence[str], gain: Column, limit: int = LIMIT) -> DataFrame:
    """Multiply the spectrum of each series by a real ``gain`` of (k, n) and go back: ``keys, t, re, im``."""
    rows = real_rows(samples, keys)
    known = lengths(rows, keys, limit)
    f = dft(rows, keys, limit=limit, known=known)
    g = f.withColumn("_g", gain).where("_g <> 0").select(
        *keys, "n", "k", (F.col("re") * F.col("_g")).alias("re"), (F.col("im") * F.col("_g")).alias("im"))
    return dft(g, keys, inverse=True, limit=limit, known=known).select(*keys, "t", "re", "im")
