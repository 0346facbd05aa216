"""Raw video as a Spark data source: frames of fixed size, one behind the other.

    spark.dataSource.register(RawFrames)
    spark.read.format("brimwell_raw").option("meta", "file:///shared/video.txt").load("file:///shared/video.raw")
    write_raw(frames, "file:///shared/out", 256, 256, "uint16", by=("channel", "plane"))
    spark.read.format("brimwell_raw").load("file:///shared/out")

A single file has a line of text `frames,height,width,dtype` beside it (option `meta`, or the line itself as `line`).  A folder that was
written here has a manifest: for each file the stack it belongs to, its frames and its path.  Files are stacks of `size` frames, named
`k_of_N` in a folder for each value of `by`.  Tasks write under names of their own; at commit files are renamed into place and
the manifest is put down last, so readers see all of a write or nothing, and what a lost attempt wrote is not in it.

Reading plans ranges of whole frames over all files.  Comparisons of `frame` and equalities of the `by` columns leave out ranges while
planning (with option `prune`, which needs spark.sql.python.filterPushdown.enabled); with a schema without `pixels` no bytes are read.  Files are reached through
pyarrow's file systems, by URI or by a path that all executors share.

Defined results: an empty file or table gives no rows; bytes beyond the frames that the line names are not read; null pixels are
written as 0, null frames and null pixel arrays not at all; pixels that the type cannot hold and arrays of another size are errors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators import packed

KINDS = {"uint8": "u1", "uint16": "<u2", "int16": "<i2", "int32": "<i4", "float32": "<f4", "float64": "<f8"}
RANGE = 8 << 20  # bytes of a range
MANIFEST = "manifest.json"


def opened(uri: str):
    from pyarrow import fs

    part = urlparse(uri)
    return (fs.LocalFileSystem(), part.path) if part.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


@dataclass
class Frames(InputPartition):
    path: str
    place: int  # of the first frame in the file
    first: int  # its number
    count: int
    keys: tuple = ()


def _manifest(path: str) -> dict | None:
    system, folder = opened(path)
    try:
        with system.open_input_stream(f"{folder}/{MANIFEST}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def _described(options) -> dict:
    """What a folder's manifest says, or the same for a single file."""
    text = options.get("line")
    if text is None and "meta" in options:
        system, path = opened(options["meta"])
        with system.open_input_stream(path) as f:
            text = f.read().decode()
    if text is None:
        found = _manifest(options["path"])
        if found is None:
            raise FileNotFoundError(f"{options['path']} has no manifest; a single file needs the option `meta` or `line`")
        return found
    frames, height, width, kind = text.strip().split(",")
    return {"height": int(height), "width": int(width), "dtype": kind.strip(), "by": [], "types": [], "files": [{"path": None, "keys": [], "runs": [[0, int(frames)]]}]}


class _Reader(DataSourceReader):
    def __init__(self, options, schema: StructType) -> None:
        self.root, self.range, self.told = options["path"], int(options.get("rangebytes", RANGE)), _described(options)
        self.names = schema.fieldNames()
        self.kind = np.dtype(KINDS[self.told["dtype"]])
        self.size = self.told["height"] * self.told["width"] * self.kind.itemsize
        self.low, self.high, self.equal = -(2**63), 2**63, {}

    def partitions(self) -> list[Frames]:
        step, out = max(1, self.range // max(1, self.size)), []
        for file in self.told["files"]:
            if any(file["keys"][self.told["by"].index(k)] != v for k, v in self.equal.items()):
                continue
            place = 0
            for first, count in file["runs"]:
                low, high = max(first, self.low), min(first + count, self.high)
                path = f"{self.root.rstrip('/')}/{file['path']}" if file["path"] else self.root
                out += [Frames(path, place + a - first, a, min(step, high - a), tuple(file["keys"])) for a in range(low, high, step)]
                place += count
        return out or [Frames("", 0, 0, 0)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        height, width = self.told["height"], self.told["width"]
        want = "pixels" in self.names
        float_ = self.kind.kind == "f"
        system, path = opened(partition.path)
        file = system.open_input_file(path) if want else None
        for a in range(0, partition.count, 64):
            n = min(64, partition.count - a)
            columns = {"frame": pa.array(np.arange(partition.first + a, partition.first + a + n), pa.int64()), "height": pa.array([height] * n, pa.int32()), "width": pa.array([width] * n, pa.int32())}
            columns |= {k: pa.array([v] * n, pa.int64() if t == "long" else pa.string()) for k, v, t in zip(self.told["by"], partition.keys, self.told["types"])}
            if want:
                x = np.frombuffer(file.read_at(n * self.size, (partition.place + a) * self.size), self.kind)
                columns["pixels"] = packed.lists(x.astype(np.float64 if float_ else np.int32).reshape(n, -1))
            yield pa.RecordBatch.from_arrays([columns[c] for c in self.names], names=self.names)


class _PruningReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Every filter is still applied by Spark; those of frame and `by` also leave out ranges."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if name == "frame" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if name == "frame" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.high = min(self.high, f.value + (not isinstance(f, LessThan)))
            if name in self.told["by"] and isinstance(f, EqualTo):
                self.equal[name] = f.value
            yield f


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict] = field(default_factory=list)  # path, keys, runs, stack


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType, overwrite: bool) -> None:
        self.path, self.named, self.overwrite = options["path"], options.get("dtype", "int16"), overwrite
        self.kind, self.shape = np.dtype(KINDS[self.named]), (int(options["height"]), int(options["width"]))
        self.by = [c for c in options.get("by", "").split(",") if c]
        self.types = ["string" if schema[c].dataType.typeName() == "string" else "long" for c in self.by]
        self.stack = int(options.get("size", 7000))
        if not overwrite and _manifest(self.path) is not None:
            raise FileExistsError(f"{self.path} has frames; write in mode overwrite")

    def _bytes(self, batch: pa.RecordBatch) -> np.ndarray:
        values, at = packed.flat(batch.column("pixels"))
        if (np.diff(at) != self.shape[0] * self.shape[1]).any():
            raise ValueError(f"images must have {self.shape[0]} x {self.shape[1]} pixels")
        values = np.nan_to_num(values) if self.kind.kind != "f" else np.where(np.isnan(values), 0.0, values)
        if self.kind.kind != "f" and len(values) and (values.min() < np.iinfo(self.kind).min or values.max() > np.iinfo(self.kind).max):
            raise ValueError(f"a pixel does not fit {self.named}")
        return values.astype(self.kind).reshape(batch.num_rows, -1)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        done, out, now = _Written(), None, None
        for batch in iterator:
            batch = batch.filter(pc.and_(batch.column("frame").is_valid(), batch.column("pixels").is_valid()))
            rows, frames = self._bytes(batch), batch.column("frame").to_pylist()
            keys = list(zip(*[batch.column(c).to_pylist() for c in self.by])) if self.by else [()] * len(frames)
            for k, f, row in zip(keys, frames, rows):
                if (k, f // self.stack) != now:
                    out.close() if out else None
                    now, name = (k, f // self.stack), f".{uuid.uuid4().hex}"
                    out = system.open_output_stream(f"{folder}/{name}")
                    done.files.append({"path": name, "keys": list(k), "runs": [], "stack": f // self.stack})
                runs = done.files[-1]["runs"]
                if runs and f == runs[-1][0] + runs[-1][1]:
                    runs[-1][1] += 1
                else:
                    runs.append([f, 1])
                out.write(row.tobytes())
        out.close() if out else None
        return done

    def commit(self, messages: list[_Written | None]) -> None:
        system, folder = opened(self.path)
        before = _manifest(self.path) if self.overwrite else None
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: ([(k is not None, k) for k in f["keys"]], f["stack"]))
        many: dict[tuple, int] = {}
        for f in files:
            many[tuple(f["keys"])] = many.get(tuple(f["keys"]), 0) + 1
        seen: dict[tuple, int] = {}
        for f in files:
            key = tuple(f["keys"])
            seen[key] = seen.get(key, 0) + 1
            place = "/".join(f"{c}={'__null__' if v is None else quote(str(v), safe='')}" for c, v in zip(self.by, key))
            name = f"{place}/{seen[key]:02d}_of_{many[key]}.raw".lstrip("/")
            if self.overwrite:
                name = name.removesuffix(".raw") + f"-{f['path'][1:9]}.raw"  # beside what is still being read
            system.create_dir(f"{folder}/{place}", recursive=True)
            system.move(f"{folder}/{f['path']}", f"{folder}/{name}")
            f["path"] = name
            del f["stack"]
        told = {"height": self.shape[0], "width": self.shape[1], "dtype": self.named, "by": self.by, "types": self.types, "files": files}
        with system.open_output_stream(f"{folder}/.{MANIFEST}") as out:
            out.write(json.dumps(told).encode())
        system.move(f"{folder}/.{MANIFEST}", f"{folder}/{MANIFEST}")
        for f in before["files"] if before else []:
            system.delete_file(f"{folder}/{f['path']}")

    def abort(self, messages: list[_Written | None]) -> None:
        system, folder = opened(self.path)
        for f in (f for m in messages if m for f in m.files):
            system.delete_file(f"{folder}/{f['path']}")


class RawFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "brimwell_raw"

    def schema(self) -> str:
        told = _described(self.options)
        pixel = self.options.get("pixel", "double" if told["dtype"].startswith("float") else "int")
        return ", ".join([*[f"`{c}` {t}" for c, t in zip(told["by"], told["types"])], "frame long", "height int", "width int", f"pixels array<{pixel}>"])

    def reader(self, schema) -> _Reader:
        return (_PruningReader if self.options.get("prune") == "true" else _Reader)(self.options, schema)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, schema, overwrite)


def write_raw(frames: DataFrame, path: str, height: int, width: int, dtype: str = "int16", parts: int | None = None, *, by: tuple[str, ...] = (), size: int = 7000, mode: str = "append") -> None:
    """Writes frames (by, frame, pixels) below a folder: a file for each stack of `size` frames, in order, and a manifest.

    by columns are whole numbers or strings.  mode: `append` into a folder without frames, or `overwrite`.
    """
    spark = frames.sparkSession
    spark.dataSource.register(RawFrames)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stack = F.floor(F.col("frame") / size)
    own = frames.where("frame is not null").select(*by, F.col("frame").cast("long").alias("frame"), "pixels")
    ordered = own.repartitionByRange(parts, *by, stack).sortWithinPartitions(*by, "frame")
    out = ordered.write.format("brimwell_raw").option("height", height).option("width", width).option("dtype", dtype).option("by", ",".join(by)).option("size", size)
    out.mode(mode).save(path)
