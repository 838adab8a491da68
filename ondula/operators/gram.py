"""Second moments of array rows as partial sums per partition.

Each task multiplies its Arrow batches with BLAS and emits one small matrix
per key it has seen; the shuffle carries the rows of these matrices as arrays,
never the rows of the data and never single cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS_PER_TASK = 64
ROWS_OUT = 1 << 12  # rows of a matrix that leave a task at once


def matrix_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of one width as a 2-D array, without a Python loop; a NULL row is a row of NaN."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not n or column.null_count == n:
        return np.zeros((n, 0))
    widths = np.diff(column.offsets.to_numpy(zero_copy_only=False)) if not column.null_count else pc.list_value_length(column).drop_null().to_numpy()
    width = int(widths[0])
    if (widths != width).any():
        raise ValueError("rows of one block have arrays of different widths")
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, width)
    if not column.null_count:
        return flat
    out = np.full((n, width), np.nan)
    out[column.is_valid().to_numpy(zero_copy_only=False)] = flat
    return out


class Rows:
    """Rows of a list column of any widths as views of its values, one at a time; a NULL value is NaN."""

    def __init__(self, column: pa.ListArray):
        self.values = column.flatten().to_numpy(zero_copy_only=False)
        self.cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy())])

    def __getitem__(self, n: int) -> np.ndarray:
        return self.values[self.cuts[n]:self.cuts[n + 1]]


def key_slices(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Row positions of every distinct key in a batch."""
    if not keys:
        yield (), np.arange(batch.num_rows)
        return
    codes = np.zeros(batch.num_rows, dtype=np.int64)
    for k in keys:
        enc = batch.column(k).dictionary_encode()
        codes = codes * (len(enc.dictionary) + 1) + enc.indices.fill_null(len(enc.dictionary)).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    cuts = np.flatnonzero(np.diff(codes[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield tuple(batch.column(k)[int(rows[0])].as_py() for k in keys), rows


def partial_sums(df: DataFrame, keys: Sequence[str], arrays: Sequence[str],
                 kernel: Callable[..., np.ndarray]) -> DataFrame:
    """Sum ``kernel(*row_matrices)`` over all rows of each key.

    The kernel returns a matrix for a block of rows and must be additive over
    rows; it may return ``(row ids, matrix)`` to number the rows itself. Rows
    with a NULL array are left out. Output: ``keys, i, j, v``.
    """
    return partial_rows(df, keys, arrays, kernel).select(*keys, "i", F.posexplode("row").alias("j", "v"))


def partial_rows(df: DataFrame, keys: Sequence[str], arrays: Sequence[str], kernel: Callable[..., np.ndarray]) -> DataFrame:
    """``partial_sums`` with the rows of the matrix as arrays: ``keys, i, row``."""
    def part(*blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = kernel(*blocks)
        return m if isinstance(m, tuple) else (np.arange(len(m)), m)

    rows = _partial(df, list(keys), list(arrays), part, lambda a, b: (a[0], a[1] + b[1]))
    return _merged(rows, list(keys), lambda a, b: a + b).select(*keys, "i", "row")


def _partial(df: DataFrame, keys: list[str], arrays: list[str], kernel: Callable, merge: Callable) -> DataFrame:
    """One matrix per task and key, as array rows: ``keys, i, row``."""
    fields = [df.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        types: list[pa.DataType] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for key, (ids, whole) in sums.items():
                for lo in range(0, len(whole), ROWS_OUT):
                    i, m = ids[lo:lo + ROWS_OUT], whole[lo:lo + ROWS_OUT]
                    cols = [pa.array([v] * len(m), type=t) for v, t in zip(key, types)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(i.astype(np.int32)), _lists(m)], names=[*keys, "i", "row"])
            sums.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(k).type for k in keys]
            for key, rows in key_slices(batch, keys):
                part = batch if len(rows) == batch.num_rows else batch.take(pa.array(rows))
                new = kernel(*[matrix_of(part.column(a)) for a in arrays])
                sums[key] = merge(sums[key], new) if key in sums else new
            if len(sums) > KEYS_PER_TASK:
                yield from flush()
        yield from flush()

    whole = df.select(*keys, *arrays).where(" AND ".join(f"`{a}` IS NOT NULL" for a in arrays))
    return whole.mapInArrow(run, ", ".join([*_ddl(fields), "i int", "row array<double>"]))


def _merged(rows: DataFrame, keys: list[str], merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of all tasks merged per ``keys, i``: arrays are shuffled, and one at a time is added to the open group."""
    by = [*keys, "i"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: tuple | None = None
        total: np.ndarray | None = None
        types: list[pa.DataType] = []

        def batch_of(done: list[tuple[tuple, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for width in {len(m) for _, m in done}:
                same = [(k, m) for k, m in done if len(m) == width]
                cols = [pa.array(list(v), type=t) for v, t in zip(zip(*[k for k, _ in same]), types)]
                yield pa.RecordBatch.from_arrays([*cols, _lists(np.stack([m for _, m in same]))], names=[*by, "row"])

        for batch in batches:
            types = [batch.schema.field(k).type for k in by]
            done = []
            row = batch.column(len(by))
            flat, cuts = row.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(row).to_numpy())])
            for n, key in enumerate(zip(*[batch.column(k).to_pylist() for k in range(len(by))])):
                m = flat[cuts[n]:cuts[n + 1]]
                if total is not None and key == open_key:
                    total = merge(total, m)
                    continue
                if total is not None:
                    done.append((open_key, total))
                open_key, total = key, m
            yield from batch_of(done)
        if total is not None:
            yield from batch_of([(open_key, total)])

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, rows.schema)


def _ddl(fields: Sequence) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]


def _lists(m: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m, dtype=float).ravel()))


def gram(frames: DataFrame, keys: Sequence[str] = ("recording",), x: str = "x") -> DataFrame:
    """Centred and raw second moments: ``keys, i, j, n, mean_i, mean_j, s2, cov``.

    Blocks are centred on their own means, after a shift by their first row,
    and merged pairwise, within a task and between tasks, so an offset of the
    data costs no digits. NULL frames do not count. ``s2`` is the mean raw
    product, ``cov`` the population covariance.
    """
    keys = list(keys)

    # row i of a task: n, mean of i, all means, centred products of i with every column
    def rows_of(n: float, mean: np.ndarray, m2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = len(mean)
        return np.arange(c), np.column_stack([np.full(c, n), mean, np.broadcast_to(mean, (c, c)), m2])

    def kernel(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = m - m[0]
        shift = d.mean(axis=0)
        d = d - shift
        return rows_of(len(m), m[0] + shift, d.T @ d)

    def both(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return a[0], merge_rows(a[1], b[1])

    rows = _merged(_partial(frames, keys, [x], kernel, both), keys, lambda a, b: merge_rows(a[None], b[None])[0])
    width = ((F.size("row") - 2) / 2).cast("int")
    n = F.col("row")[0]
    cells = rows.select(*keys, "i", n.cast("bigint").alias("n"), F.col("row")[1].alias("mean_i"), F.posexplode(
        F.arrays_zip(F.slice("row", 3, width).alias("m"), F.slice("row", 3 + width, width).alias("v"))).alias("j", "_c"))
    cov = F.col("_c.v") / F.col("n")
    return cells.select(*keys, "i", "j", "n", "mean_i", F.col("_c.m").alias("mean_j"),
                        (cov + F.col("mean_i") * F.col("_c.m")).alias("s2"), cov.alias("cov"))


def merge_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows (n, mean of i, all means, centred products of i) of two sets of frames as those of their union."""
    c = (a.shape[1] - 2) // 2
    na, nb = a[:, :1], b[:, :1]
    n = na + nb
    di, d = b[:, 1:2] - a[:, 1:2], b[:, 2:2 + c] - a[:, 2:2 + c]
    m2 = a[:, 2 + c:] + b[:, 2 + c:] + di * d * (na * nb / n)
    return np.column_stack([n, a[:, 1:2] + di * nb / n, a[:, 2:2 + c] + d * nb / n, m2])


def collect_matrix(cells: DataFrame, value: str, rows: int | None = None, cols: int | None = None) -> np.ndarray:
    """A parameter-sized matrix table ``i, j, value`` on the driver."""
    got = cells.select("i", "j", value).toPandas()
    shape = (rows or int(got["i"].max()) + 1, cols or int(got["j"].max()) + 1)
    m = np.zeros(shape)
    m[got["i"].to_numpy(), got["j"].to_numpy()] = got[value].to_numpy()
    return m
