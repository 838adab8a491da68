"""Lines of a recurrence matrix from summaries of its blocks.

A block of the matrix is summarised where it is compared: lines that end within it go to a histogram, those that touch its border are kept
as pieces (line, start, length). Pieces of the same diagonal or column that follow each other across blocks are joined, so the
points of the matrix are neither shuffled nor written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ondula.functions.types import LONGS
from ondula.operators.tiles import Chunk, checked, compared, near, packed_bits, unpacked

DIAGONAL, VERTICAL = 0, 1
FIELDS = ("kind", "line", "start", "length", "n")


def runs(line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, first place, length) of the runs of places that follow each other, from cells in the order of line and place."""
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return line[first], at[first], np.diff(np.append(first, len(line)))


def column_runs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, first row, length) of the runs of true cells down the columns."""
    return runs(*np.nonzero(np.ascontiguousarray(m.T)))


def diagonal_runs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column - row, first row, length) of the runs of true cells down the diagonals."""
    i, j = np.nonzero(m)
    order = np.argsort((j - i) * len(m) + i, kind="stable")
    return runs((j - i)[order], i[order])


def skewed(m: np.ndarray) -> np.ndarray:
    """The diagonals of a square matrix as columns: cell (i, j) stands at (i, j - i + n - 1)."""
    n = len(m)
    flat = np.pad(m[::-1], ((0, 0), (0, n))).ravel()[: n * (2 * n - 1)]
    return flat.reshape(n, 2 * n - 1)[::-1]


def block_summary(m: np.ndarray, row0: int, col0: int, present: np.ndarray | None) -> list[np.ndarray]:
    """``FIELDS`` of a block of the upper triangle that starts at (``row0``, ``col0``); lines that end within it have line and start -1.

    ``present`` marks the points of a block on the diagonal; its cells count as recurrent, but only in columns.
    """
    size = len(m)
    parts = []

    def add(kind: int, line: np.ndarray, start: np.ndarray, length: np.ndarray, touches: np.ndarray) -> None:
        closed = np.bincount(length[~touches]) if len(length) else np.zeros(0, np.int64)
        some = np.flatnonzero(closed)
        lines, k = int(touches.sum()), len(some)
        parts.append(np.stack([np.full(lines + k, kind), np.append(line[touches], np.full(k, -1)), np.append(start[touches], np.full(k, -1)),
                               np.append(length[touches], some), np.append(np.ones(lines, np.int64), closed[some])]))

    upper = np.triu(m, 1) if present is not None else m
    offset, start, length = diagonal_runs(upper)
    end = start + length
    add(DIAGONAL, offset + col0 - row0, start + row0, length, (start == np.maximum(0, -offset)) | (end == np.minimum(size, size - offset)))
    sides = [(upper | upper.T | np.diag(present), row0, col0)] if present is not None else [(m, row0, col0), (m.T, col0, row0)]
    for cells, first_row, first_column in sides:
        column, start, length = column_runs(cells)
        add(VERTICAL, column + first_column, start + first_row, length, (start == 0) | (start + length == size))
    return list(np.concatenate(parts, 1).astype(np.int64))


_SUMMARY = T.StructType([T.StructField(f, LONGS) for f in FIELDS])


def _lines(rows: DataFrame, key: str) -> DataFrame:
    """``key, kind, length, n`` from rows ``key`` and ``FIELDS`` of the summaries of blocks."""
    # sums per task first: what is left is a histogram and two pieces per line and block; they stay together, as a filter would make the blocks twice
    rows = rows.groupBy(key, "kind", "line", "start", "length").agg(F.sum("n").alias("n"))
    along = W.partitionBy(key, "kind", "line").orderBy("start", "length")
    new = F.when((F.col("line") < 0) | (F.lag(F.col("start") + F.col("length")).over(along) != F.col("start")), 1).otherwise(0)
    pieces = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    runs = pieces.groupBy(key, "kind", "line", "_run").agg(F.sum("length").alias("length"), F.max(F.when(F.col("line") < 0, F.col("n")).otherwise(1)).alias("n"))
    return runs.groupBy(key, "kind", "length").agg(F.sum("n").alias("n"))


def _below(m: np.ndarray) -> np.ndarray:
    """Cell (i, j) is that of (i + 1, j)."""
    return np.concatenate([m[1:], np.zeros_like(m[:1])])


def _beside(m: np.ndarray) -> np.ndarray:
    """Cell (i, j) is that of (i, j + 1)."""
    out = m >> np.uint64(1)
    out[:, :-1] |= m[:, 1:] << np.uint64(63)
    return out


def _walked(bits: np.ndarray, shape: tuple[int, int], i: np.ndarray, j: np.ndarray, di: int, dj: int) -> np.ndarray:
    """How many cells in a row are set, from the set cells (i, j) in a direction."""
    n, live, step = np.ones(len(i), np.int64), np.arange(len(i)), 0
    while len(live):
        step += 1
        r, c = i[live] + step * di, j[live] + step * dj
        ok = (r >= 0) & (r < shape[0]) & (c >= 0) & (c < shape[1])
        live, r, c = live[ok], r[ok], c[ok]
        live = live[(bits[r, c >> 6] >> (c & 63).astype(np.uint64)) & np.uint64(1) == 1]
        n[live] += 1
    return n


def bit_runs(bits: np.ndarray, columns: int, di: int, dj: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(histogram by length of the runs in direction (di, dj) that touch no border, (row, column, length) of those that do).

    ANDs of a matrix with itself, moved by a step each time, count the places where so many cells in a row are set; second differences of these counts are the histogram.
    """
    shape, moved = (len(bits), columns), bits
    counts = [int(np.bitwise_count(bits).sum())]
    while counts[-1]:
        if di:
            moved = _below(moved)
        moved = bits & (_beside(moved) if dj else moved)  # cells from which as many as there were steps and one more are set
        counts.append(int(np.bitwise_count(moved).sum()))
    at_least = -np.diff([*counts, 0, 0])
    whole = np.append(0, -np.diff(at_least)) if len(at_least) > 1 else np.zeros(1, np.int64)

    row = lambda r: np.flatnonzero(unpacked(bits[r:r + 1], columns)[0])
    column = lambda c: np.flatnonzero((bits[:, c >> 6] >> np.uint64(c & 63)) & np.uint64(1))
    ends = lambda r, c: [(k, np.full(len(k), at), side) for at, side, k in ((r, 0, row(r) if di else None), (c, 1, column(c) if dj else None)) if k is not None]

    def cells(r: int, c: int) -> tuple[np.ndarray, np.ndarray]:
        found = [(at, k) if side == 0 else (k, at) for k, at, side in ends(r, c)]
        i, j = (np.concatenate(x) for x in zip(*found))
        twice = np.unique(i * columns + j)
        return np.divmod(twice, columns)

    i, j = cells(0, 0)
    length = _walked(bits, shape, i, j, di, dj)
    p, q = cells(shape[0] - 1, columns - 1)
    back = _walked(bits, shape, p, q, -di, -dj)
    p, q = p - di * (back - 1), q - dj * (back - 1)
    late = ~(((p == 0) & bool(di)) | ((q == 0) & bool(dj)))
    i, j, length = np.append(i, p[late]), np.append(j, q[late]), np.append(length, back[late])
    touching = np.bincount(length, minlength=len(whole))
    return whole - touching[:len(whole)], (i, j, length)


def _positions(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of each point, time of each position): equal times share one, and one stays free where times do not follow each other."""
    u, inverse = np.unique(t, return_inverse=True)
    at = np.arange(len(u)) + np.concatenate([[0], np.cumsum(np.diff(u) > 1)])
    time = np.zeros(at[-1] + 1, np.int64)
    time[at] = u
    return at[inverse], time


def chunk_summary(a: Chunk, b: Chunk, bits: np.ndarray) -> list[np.ndarray]:
    """``FIELDS`` of the runs of two chunks, the first the earlier one or both the same; those that end within them have line and start -1."""
    (i, row_time), (j, column_time) = _positions(a.t), _positions(b.t)
    same = a is b
    if same or len(row_time) != len(a.t) or len(column_time) != len(b.t) or (np.diff(i) != 1).any() or (np.diff(j) != 1).any():
        m = np.zeros((len(row_time), len(column_time)), bool)
        p, q = np.nonzero(unpacked(bits, len(b.t)))
        m[i[p], j[q]] = True
        upper = np.triu(m, 1) if same else m
        if same:
            m = upper | upper.T
            m[i, i] = True  # a point recurs to itself
        bits, full = packed_bits(upper), packed_bits(m)
    else:
        full = bits
    kinds = [(DIAGONAL, bits, 1, 1), (VERTICAL, full, 1, 0), *([] if same else [(VERTICAL, full, 0, 1)])]
    parts = []
    for kind, m, di, dj in kinds:
        closed, (r, c, length) = bit_runs(m, len(column_time), di, dj)
        some = np.flatnonzero(closed)
        row, column = row_time[r], column_time[c]
        line, start = (column - row, row) if kind == DIAGONAL else (column, row) if di else (row, column)
        k = len(some)
        parts.append(np.stack([np.full(len(r) + k, kind), np.append(line, np.full(k, -1)), np.append(start, np.full(k, -1)), np.append(length, some),
                               np.append(np.ones(len(r), np.int64), closed[some])]))
    return list(np.concatenate(parts, 1).astype(np.int64))


def recurrence_lines(frames: DataFrame, threshold: float, metric: str = "euclidean", key: str = "recording", block: int = 512) -> DataFrame:
    """Histogram of the lines of the recurrence matrix of points within ``threshold``: ``key, kind, length, n``.

    Kind 0 are the runs on the diagonals above the main one (those below are alike), kind 1 the runs in all columns, the main diagonal included.
    """
    checked([metric])
    limit = float(threshold)

    def work(held: list[Chunk], b: Chunk, own: bool) -> Iterator[list[np.ndarray]]:
        for a, bits in near(held, b, metric, limit):
            yield chunk_summary(a, b, bits)
        if own:  # the main diagonal is there whatever is near
            bits = next((bits for _, bits in near([b], b, metric, limit)), np.zeros((len(b.t), -(-len(b.t) // 64)), np.uint64))
            yield chunk_summary(b, b, bits)

    return _lines(compared(frames, key, block, work, ", ".join(f"{f} bigint" for f in FIELDS)), key)


def lines_of_pairs(pairs: DataFrame, frames: DataFrame, key: str = "recording", block: int = 512) -> DataFrame:
    """The same histogram from recurrent pairs i < j that are at hand, and the points ``t`` of ``frames``: pairs are gathered by block."""
    at = lambda c: F.floor(F.col(c) / block).alias(f"_{c}")
    diagonal = frames.select(key, F.col("t").alias("i"), F.col("t").alias("j"))
    cells = pairs.select(key, "i", "j").unionByName(diagonal).groupBy(key, at("i"), at("j")).agg(
        F.collect_list("i").alias("is"), F.collect_list("j").alias("js"))  # block x block cells at most

    @F.pandas_udf(_SUMMARY)
    def summary(ba: pd.Series, i: pd.Series, bb: pd.Series, j: pd.Series) -> pd.DataFrame:
        out = []
        for a, r, b, c in zip(ba, i, bb, j):
            m = np.zeros((block, block), bool)
            m[np.asarray(r) - a * block, np.asarray(c) - b * block] = True
            out.append(block_summary(m, a * block, b * block, np.diag(m).copy() if a == b else None))
        return pd.DataFrame({f: [o[k] for o in out] for k, f in enumerate(FIELDS)})

    rows = cells.select(key, summary("_i", "is", "_j", "js").alias("_s"))
    return _lines(rows.select(key, F.explode(F.arrays_zip(*[f"_s.{f}" for f in FIELDS])).alias("_r")).select(key, "_r.*"), key)

