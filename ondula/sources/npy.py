"""A data source for ``.npy`` files that splits them by rows.

``partitions`` reads only the header of each file and plans ranges of rows of about ``SPLIT_BYTES``, or less where that would leave tasks idle; ranges of
small files share a partition. A task then reads just its bytes, so neither a file nor a recording has to fit in a task.
"""

from __future__ import annotations

import fnmatch
import io
import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SPLIT_BYTES = 32 << 20
#: Splits that are smaller so that every task has some have so many bytes at least.
LEAST_BYTES = 1 << 20
#: Values of a batch of rows, and headers that the driver reads at a time.
BATCH_VALUES, OPEN = 1 << 20, 32
SCHEMA = "recording string, t bigint, x array<double>"


def open_store(root: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what stands before paths) of a folder or file given as a path or URI."""
    store, path = fs.FileSystem.from_uri(root) if ":" in root.split("/", 1)[0] else (fs.LocalFileSystem(), root)
    end = root.rstrip("/")
    return store, path, end[: len(end) - len(path.rstrip("/"))] if end.endswith(path.rstrip("/")) else ""


def listed(root: str, glob: str) -> tuple[fs.FileSystem, str, list[str]]:
    """(file system, what stands before paths, sorted paths of the files below ``root`` whose names match; names that begin with _ or . are hidden)."""
    store, path, before = open_store(root)
    info = store.get_file_info(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else []
    return store, before, sorted(f.path for f in found if f.is_file and f.base_name[0] not in "_." and fnmatch.fnmatch(f.base_name, glob))


@dataclass(frozen=True)
class Header:
    rows: int
    columns: int
    by_column: bool
    dtype: str
    offset: int


def header(store: fs.FileSystem, path: str) -> Header:
    """Layout of an array file of real numbers with one axis (one channel) or two (time, channel)."""
    with store.open_input_file(path) as f:
        version = np.lib.format.read_magic(head := io.BytesIO(f.read_at(12, 0)))
        size = int.from_bytes(head.getbuffer()[8:10 if version == (1, 0) else 12], "little")
        start = 10 if version == (1, 0) else 12
        text = io.BytesIO(f.read_at(start + size, 0))
    text.seek(8)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = read(text)
    if dtype.kind not in "biuf" or not 1 <= len(shape) <= 2:
        raise ValueError(f"{path}: one or two axes of real numbers expected, found {dtype} of shape {shape}")
    return Header(shape[0], shape[1] if len(shape) == 2 else 1, by_column and len(shape) == 2, dtype.str, start + size)


@dataclass
class Ranges(InputPartition):
    """Rows ``lo`` to ``hi`` of files: (path, header, lo, hi)."""

    parts: list[tuple[str, Header, int, int]]

    def __init__(self, parts: list[tuple[str, Header, int, int]]):
        super().__init__(None)
        self.parts = parts


def planned(headers: list[tuple[str, Header]], split_bytes: int, tasks: int = 1) -> list[Ranges]:
    whole = sum(h.rows * h.columns * np.dtype(h.dtype).itemsize for _, h in headers)
    split_bytes = min(split_bytes, max(LEAST_BYTES, math.ceil(whole / tasks)))
    out: list[Ranges] = []
    held: list[tuple[str, Header, int, int]] = []
    size = 0
    for path, h in headers:
        width = max(1, h.columns * np.dtype(h.dtype).itemsize)
        step = max(1, split_bytes // width)
        pieces = max(1, math.ceil(h.rows / step))
        for k in range(pieces if h.rows else 0):
            lo, hi = h.rows * k // pieces, h.rows * (k + 1) // pieces
            if held and size + (hi - lo) * width > split_bytes:
                out.append(Ranges(held))
                held, size = [], 0
            held.append((path, h, lo, hi))
            size += (hi - lo) * width
    return [*out, Ranges(held)] if held else out


class ArrayReader(DataSourceReader):
    def __init__(self, root: str, glob: str, split_bytes: int, tasks: int):
        self.root, self.glob, self.split_bytes, self.tasks = root, glob, split_bytes, tasks

    def partitions(self) -> list[Ranges]:
        store, _, paths = listed(self.root, self.glob)
        with ThreadPoolExecutor(OPEN) as pool:
            return planned(list(zip(paths, pool.map(lambda p: header(store, p), paths))), self.split_bytes, self.tasks) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _, before = open_store(self.root)
        for path, h, lo, hi in partition.parts:
            dtype, c = np.dtype(h.dtype), h.columns
            step = max(1, BATCH_VALUES // max(1, c))
            with store.open_input_file(path) as f:
                for a in range(lo, hi, step):
                    b = min(a + step, hi)
                    if h.by_column:
                        columns = [f.read_at((b - a) * dtype.itemsize, h.offset + (k * h.rows + a) * dtype.itemsize) for k in range(c)]
                        x = np.stack([np.frombuffer(k, dtype) for k in columns], 1) if c else np.empty((b - a, 0))
                    else:
                        x = np.frombuffer(f.read_at((b - a) * c * dtype.itemsize, h.offset + a * c * dtype.itemsize), dtype).reshape(b - a, c)
                    values = pa.array(np.ascontiguousarray(x, dtype=np.float64).reshape(-1))
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * c), values)
                    yield pa.RecordBatch.from_arrays([pa.array([before + path] * (b - a), pa.string()), pa.array(np.arange(a, b, dtype=np.int64)), rows],
                                                     names=["recording", "t", "x"])


class ArrayFiles(DataSource):
    """``spark.read.format("npy").load(folder)``; options ``glob``, ``splitBytes`` and ``tasks`` (how many should have rows)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArrayReader:
        o: Any = self.options
        return ArrayReader(o["path"], o.get("glob", "*.npy"), int(o.get("splitBytes", SPLIT_BYTES)), int(o.get("tasks", 1)))


def file_bytes(rows: int, columns: int, one_axis: bool = False) -> bytes:
    """The header of a file of doubles in row order."""
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": "<f8", "fortran_order": False, "shape": (rows,) if one_axis else (rows, columns)})
    return out.getvalue()
