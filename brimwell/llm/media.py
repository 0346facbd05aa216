"""Media columns: archives of media members behind a Spark data source.

`store` writes texts as 8-bit mono PCM members (WAV) in archives, one archive for each task attempt, and
gives a committed catalogue of them.  The source `brimwell_media` plans byte ranges over the archives;
a member belongs to the range that its offset lies in.  A range reads its archive's directory and the index pages that reach into
it, streams members in Arrow batches of bounded bytes, and retries a member alone, by its offset, when it can't be read or
its checksum is wrong.  Archives that a lost attempt left are not in the catalogue and are never read.

Archive: members (zstd of the WAV bytes); behind each `page` of them an index page (Arrow table of key, offset, size, crc), which is all
that the writer holds; then a directory (of each page its place, size, and first and last member's offset), and the
directory's place as 8 bytes.  Files are reached through pyarrow's file systems, by URI.

Defined results: a null text is empty; an empty payload is 576 bytes 255; equal texts give equal values; keys may
repeat and are of any type (archives hold them as text); null keys stay null; an empty table gives archives without members and no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .text import scratch, text_bytes, written

FRAME, FILL, RATE = 576, b"\xff", 8000
RANGE, BATCH, TRIES = 8 << 20, 4 << 20, 3
PAGE = 4096
INDEX, PAGES = ["key", "n_bytes", "offset", "size", "whole", "crc"], ["at", "size", "first", "last"]
SCHEMA = "key string, n_bytes long, media binary"


def pad(payload: bytes) -> bytes:
    return payload + FILL * (-len(payload) % FRAME if payload else FRAME)


def to_wav(samples: bytes) -> bytes:
    head = b"RIFF" + struct.pack("<I", 36 + len(samples) + len(samples) % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)


def from_wav(wav: bytes) -> bytes:
    """The samples, found by walking the chunks."""
    at = 12
    while at + 8 <= len(wav):
        name, size = wav[at : at + 4], struct.unpack_from("<I", wav, at + 4)[0]
        if name == b"data":
            return wav[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples in this member")


def _open(uri: str):
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def store(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folder: str | None = None, page: int = PAGE) -> DataFrame:
    """Writes archives below `folder` (a new one in the shared folder by default); returns the catalogue (path, bytes, members)."""
    folder = folder or scratch(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/{uuid.uuid4().hex}.media"
        system, path = _open(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        codec = pa.Codec("zstd", compression_level=1)
        index: list[tuple] = []
        pages: list[tuple[int, int, int, int]] = []
        at = n = 0
        with system.open_output_stream(path) as out:

            def turned() -> int:
                body = _packed(index, INDEX)
                pages.append((at, len(body), index[0][2], index[-1][2]))
                index.clear()
                out.write(body)
                return at + len(body)

            for batch in batches:
                for k, t in zip(batch.column("key").to_pylist(), batch.column("text")):
                    raw = t.as_py()
                    wav = to_wav(pad(raw))
                    body = codec.compress(wav, asbytes=True)
                    out.write(body)
                    index.append((k, len(raw), at, len(body), len(wav), zlib.crc32(wav)))
                    at, n = at + len(body), n + 1
                    at = turned() if len(index) == page else at
            at = turned() if index else at
            out.write(_packed(pages, PAGES))
            out.write(struct.pack("<q", at))
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([at], pa.int64()), pa.array([n], pa.int64())], names=["path", "bytes", "members"])

    return written(docs.select(F.col(key).cast("string").alias("key"), text_bytes(text).alias("text")).mapInArrow(run, "path string, bytes long, members long"))


def _packed(rows: list[tuple], names: list[str]) -> bytes:
    table = pa.table([pa.array([r[i] for r in rows], pa.string() if name == "key" else pa.int64()) for i, name in enumerate(names)], names=names)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int) -> None:
        self.path, self.low, self.high = path, low, high


class MediaReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.archives = json.loads(options["archives"])
        self.range = int(options.get("rangebytes", options.get("rangeBytes", RANGE)))

    def partitions(self) -> list[_Range]:
        return [_Range(p, a, min(a + self.range, n)) for p, n in self.archives for a in range(0, n, self.range)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, path = _open(partition.path)
        codec = pa.Codec("zstd")
        with system.open_input_file(path) as f:
            end = f.size()
            at = struct.unpack("<q", f.read_at(8, end - 8))[0]
            load = lambda n, at: pa.ipc.open_file(pa.BufferReader(f.read_at(n, at))).read_all()
            near = [p for p in load(end - 8 - at, at).to_pylist() if p["first"] < partition.high and p["last"] >= partition.low]
            index = [load(p["size"], p["at"]) for p in near]
        if not index:
            return
        index = pa.concat_tables(index)
        offsets = index.column("offset").to_numpy()
        index = index.filter(pa.array((offsets >= partition.low) & (offsets < partition.high)))
        held, size = [], 0
        f = system.open_input_file(path)
        try:
            for row in index.to_batches(4096):
                for r in row.to_pylist():
                    for left in range(TRIES - 1, -1, -1):
                        try:
                            media = codec.decompress(f.read_at(r["size"], r["offset"]), r["whole"], asbytes=True)
                            if zlib.crc32(media) != r["crc"]:
                                raise OSError(f"wrong checksum at {r['offset']} of {partition.path}")
                            break
                        except OSError:
                            if not left:
                                raise
                            f.close()
                            f = system.open_input_file(path)
                    held.append((r["key"], r["n_bytes"], media))
                    size += len(media)
                    if size >= BATCH:
                        yield self._batch(held)
                        held, size = [], 0
        finally:
            f.close()
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["key", "n_bytes", "media"])


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "brimwell_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


def read_media(spark: SparkSession, catalogue: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Rows (key, n_bytes, media) of all archives of a catalogue; the driver holds a path and a size for each archive."""
    spark.dataSource.register(MediaSource)
    archives = [(r.path, r.bytes) for r in catalogue.where("members > 0").select("path", "bytes").toLocalIterator()]
    return spark.read.format("brimwell_media").option("archives", json.dumps(archives)).option("rangeBytes", range_bytes).load()


def feature(samples: bytes) -> str:
    """Sum, power, crossings of the middle, and peak of the samples, in whole numbers."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    s = x >= 0
    return f"sum={int(x.sum())};power={int((x * x).sum())};cross={int((s[1:] != s[:-1]).sum())};peak={int(np.abs(x).max())}"


def features(media: DataFrame) -> DataFrame:
    """The digest columns of each member, from the bytes read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m in batch.column("media"):
                wav = m.as_py()
                x = from_wav(wav)
                rows.append((len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]), len(wav), hashlib.sha256(wav).hexdigest(), feature(x)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            new = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), *new], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_digest(docs: DataFrame) -> DataFrame:
    out = features(read_media(docs.sparkSession, store(docs)))
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
