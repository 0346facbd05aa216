"""Numeric .npy files as a Spark data source: the header is read while planning, tasks read ranges of rows.

    spark.dataSource.register(NpyValues)
    spark.read.format("brimwell_npy").load("file:///shared/suite/*.npy")

Rows are (session, path, row, col, value double); the session is the folder that a file lies in.  Arrays have one or two axes, in either
order of memory; a range takes `rangebytes` (8 MB), so a file of any size is many tasks' work.  Arrays of objects are refused, never
unpickled; empty arrays give no rows.
"""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .raw_frames import RANGE, opened

HEAD = 1 << 16
CELLS = 1 << 16  # values of a batch


@dataclass
class Rows(InputPartition):
    path: str
    at: int  # of the first byte of the array
    kind: str
    length: int  # values of a line: of a row, or of a column where columns are contiguous
    columns_first: bool
    low: int
    high: int


def _files(uri: str) -> list[str]:
    from pyarrow import fs

    system, path = opened(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [path]
    folder, _, pattern = (path, "", "*.npy") if info.type == fs.FileType.Directory else path.rpartition("/")
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.uri, self.range = options["path"], int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[InputPartition]:
        system, _ = opened(self.uri)
        out: list[InputPartition] = []
        for path in _files(self.uri):
            with system.open_input_file(path) as f:
                head = io.BytesIO(f.read(HEAD))
            version = np.lib.format.read_magic(head)
            shape, columns_first, kind = (np.lib.format.read_array_header_1_0 if version[0] == 1 else np.lib.format.read_array_header_2_0)(head)
            if kind.hasobject or len(shape) > 2 or kind.kind not in "biuf":
                raise ValueError(f"{path}: numbers of one or two axes are read, not {kind} of shape {shape}")
            rows, columns = (*shape, *[1] * (2 - len(shape)))[:2] if shape else (1, 1)
            lines, length = (columns, rows) if columns_first else (rows, columns)
            step = max(1, self.range // max(1, length * kind.itemsize))
            out += [Rows(path, head.tell(), kind.str, length, columns_first, a, min(a + step, lines)) for a in range(0, lines if length else 0, step)]
        return out or [Rows("", 0, "<f8", 0, False, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.high <= p.low:
            return
        system, _ = opened(self.uri)
        kind, session = np.dtype(p.kind), p.path.rsplit("/", 2)[-2] if "/" in p.path else ""
        with system.open_input_file(p.path) as f:
            for a in range(p.low * p.length, p.high * p.length, CELLS):
                n = min(CELLS, p.high * p.length - a)
                x = np.frombuffer(f.read_at(n * kind.itemsize, p.at + a * kind.itemsize), kind).astype(float)
                line, place = np.divmod(np.arange(a, a + n), p.length)
                row, col = (place, line) if p.columns_first else (line, place)
                yield pa.RecordBatch.from_arrays([pa.array([session] * n), pa.array([p.path] * n), pa.array(row), pa.array(col), pa.array(x)], names=["session", "path", "row", "col", "value"])


class NpyValues(DataSource):
    @classmethod
    def name(cls) -> str:
        return "brimwell_npy"

    def schema(self) -> str:
        return "session string, path string, row long, col long, value double"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
