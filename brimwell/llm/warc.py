"""WARC archives: written in tasks, indexed by walking their records, read by ranges, and replicas audited by the bytes they hold.

A file is walked record by record: in a plain file the walk reads a header and skips its block by the stated length, in a compressed
one (`.gz`, a member for each record) it inflates member by member.  Where a record is broken (a bad version line or length, bytes
that should be line ends and are not, a member that does not inflate) a row tells its place with `error`, and the walk goes on at the next
place that looks like a record.  One file is one task's walk; what it yields is one row for each record, without the blocks.

`audit_archives` compares two replicas of a set of files by a Merkle tree (llm/fixity) over (file, record ID): records are found in both by
their IDs, so damage of a length moves others without calling them changed, and each difference comes with its file and byte range in both.

Defined results: empty files have no records; a record ID that stands in several records of a file is told apart by their order; files are
reached through pyarrow's file systems, by URI or by a path that all executors share.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixity import audit
from .media import _open
from .text import written

HEAD, CHUNK = 1 << 13, 1 << 20
INDEX = "path string, place long, offset long, bytes long, type string, record_id string, uri string, date string, content_type string, sha256 string, error string"
RANGE = 32 << 20


def write_warc(records: DataFrame, folder: str, *, record: str = "record", order: list[str], compressed: bool = False, parts: int | None = None) -> DataFrame:
    """Writes records in `order`, a file for each task; returns the catalogue (path, bytes, records)."""
    parts = parts or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = ".warc.gz" if compressed else ".warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, size, n = f"{folder}/{uuid.uuid4().hex}{end}", 0, 0
        system, path = _open(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path, compression=None) as out:
            for batch in batches:
                for r in batch.column(0):
                    body = r.as_py()
                    if compressed:
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        body = z.compress(body) + z.flush()
                    out.write(body)
                    size, n = size + len(body), n + 1
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "bytes", "records"])

    dealt = records.where(F.col(record).isNotNull()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(dealt.select(F.col(record).cast("binary")).mapInArrow(run, "path string, bytes long, records long"))


def parsed(head: bytes) -> dict[str, str] | None:
    """The fields of a header, in lower case, or None if it is none; `head` ends with the blank line."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        return None
    fields = dict(x for x in ((k.strip().lower(), v.strip()) for k, c, v in (line.partition(":") for line in lines[1:]) if c))
    return fields if re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")) else None


def _told(fields: dict | None) -> tuple:
    return tuple((fields or {}).get(name) for name in ("warc-type", "warc-record-id", "warc-target-uri", "warc-date", "content-type"))


def walk(f, size: int) -> Iterator[tuple[int, int, tuple, str | None, str | None]]:
    """(offset, bytes, fields, SHA-256 of the record, error) of a plain file; a block is read in chunks."""
    at = 0
    while at < size:
        head = f.read_at(min(HEAD, size - at), at)
        while b"\r\n\r\n" not in head and len(head) < min(16 * HEAD, size - at):
            head += f.read_at(min(HEAD, size - at - len(head)), at + len(head))
        top = head.find(b"\r\n\r\n") + 4
        fields = parsed(head[: top - 4]) if top > 3 else None
        length = top + int(fields["content-length"]) + 4 if fields else 0
        sound = fields is not None and at + length <= size and f.read_at(4, at + length - 4) == b"\r\n\r\n"
        if not sound:
            length = _next(f, at + 1, size) - at
        error = None if sound else "a header that is none" if fields is None else "a block that does not end where its header says"
        yield at, length, _told(fields), _hashed(f, at, at + length), error
        at += length


def _next(f, at: int, size: int) -> int:
    """The next place behind a blank line that looks like a record, or the end."""
    while at < size:
        part = f.read_at(min(CHUNK + 14, size - at), at)
        found = re.search(rb"\r\n\r\n(?=WARC/1\.[01]\r\n)", part)
        if found:
            return at + found.end()
        at += CHUNK
    return size


def _hashed(f, at: int, end: int) -> str:
    h = hashlib.sha256()
    for a in range(at, end, CHUNK):
        h.update(f.read_at(min(CHUNK, end - a), a))
    return h.hexdigest()


def walk_members(f, size: int) -> Iterator[tuple[int, int, tuple, str | None, str | None]]:
    """As walk, of a compressed file; offsets and bytes are those of members, hashes those of what they hold."""
    at = 0
    while at < size:
        z, h, head, place, error = zlib.decompressobj(31), hashlib.sha256(), b"", at, None
        try:
            while not z.eof and place < size:
                part = f.read_at(min(CHUNK, size - place), place)
                place += len(part)
                while part and not z.eof:
                    body = z.decompress(part, CHUNK)
                    h.update(body)
                    head += body[: max(0, 16 * HEAD - len(head))]
                    part = z.unconsumed_tail
            place -= len(z.unused_data)
            error = None if z.eof else "a member that is cut off"
        except zlib.error:
            error, place = "a member that does not inflate", _next_member(f, at + 1, size)
        fields = parsed(head.split(b"\r\n\r\n")[0]) if error is None else None
        yield at, place - at, _told(fields), h.hexdigest() if error is None else _hashed(f, at, place), error or (None if fields else "a header that is none")
        at = place


def _next_member(f, at: int, size: int) -> int:
    """The next place at which a member begins that inflates, or the end."""
    while at < size:
        part = f.read_at(min(CHUNK + 3, size - at), at)
        for m in re.finditer(rb"\x1f\x8b\x08", part):
            try:
                if zlib.decompressobj(31).decompress(f.read_at(min(HEAD, size - at - m.start()), at + m.start()), 10).startswith(b"WARC/"):
                    return at + m.start()
            except zlib.error:
                continue
        at += CHUNK
    return size


def index(paths: DataFrame, path: str = "path") -> DataFrame:
    """INDEX: a row for each record of the files, in the order of `place`, and for each broken stretch with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        kinds = [pa.int64() if " long" in c else pa.string() for c in INDEX.split(", ")]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, own = _open(uri)
                held: list[tuple] = []
                with system.open_input_file(own) as f:
                    for k, (at, n, told, digest, error) in enumerate((walk_members if uri.endswith(".gz") else walk)(f, f.size())):
                        held.append((uri, k, at, n, *told, digest, error))
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

    many = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.select(F.col(path).cast("string")).where(F.col(path).isNotNull()).repartition(many, F.col(path)).mapInArrow(run, INDEX)


def read_warc(spark: SparkSession, paths: DataFrame, *, path: str = "path", range_bytes: int = RANGE) -> DataFrame:
    """(path, offset, type, record_id, uri, date, content_type, block binary) of all sound records; large files are read by ranges of their index."""
    known = written(index(paths, path)).where("error is null")
    ranged = known.withColumn("_range", F.floor(F.col("offset") / range_bytes))

    def read(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        uri = table.column("path")[0].as_py()
        system, own = _open(uri)
        blocks = []
        with system.open_input_file(own) as f:
            for at, n in zip(table.column("offset").to_pylist(), table.column("bytes").to_pylist()):
                body = f.read_at(n, at)
                body = zlib.decompress(body, 31) if uri.endswith(".gz") else body
                top = body.find(b"\r\n\r\n") + 4
                blocks.append(body[top : top + int(parsed(body[: top - 4])["content-length"])])
        keep = ["path", "offset", "type", "record_id", "uri", "date", "content_type"]
        return table.select(keep).append_column("block", pa.array(blocks, pa.binary()))

    return ranged.groupBy("path", "_range").applyInArrow(read, "path string, offset long, type string, record_id string, uri string, date string, content_type string, block binary")


def audit_archives(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, record, status, and for both replicas path, offset, bytes, hash, error): what differs between two catalogues (path), files being told by their names.

    A broken stretch has no ID that could be trusted: it stands as a record of its own, beside the one that is lost.
    """
    name = F.regexp_extract("path", "([^/]+)$", 1)
    own = F.when(F.col("error").isNull(), F.coalesce("record_id", F.lit(""))).otherwise("")
    sides = {}
    for side, paths in (("left", left), ("right", right)):
        rows = written(index(paths)).withColumns({"file": name, "record": own})
        again = F.row_number().over(_same()) - 1
        sides[side] = written(rows.withColumn("again", again).withColumn("key", F.concat_ws("\n", "file", "record", F.when(F.col("record") == "", F.concat(F.lit("at "), F.col("offset").cast("string"))).otherwise(F.col("again").cast("string")))))
    found = audit(*[s.select("key", F.col("sha256").alias("record")) for s in sides.values()], key="key", record="record").select("key", "status")
    out = found
    for side, rows in sides.items():
        out = out.join(rows.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("path", "offset", "bytes", "sha256", "error")]), "key", "left")
    parts = F.split("key", "\n")
    return out.select(parts[0].alias("file"), F.when(parts[1] != "", parts[1]).alias("record"), "status", *[f"{side}_{c}" for side in sides for c in ("path", "offset", "bytes", "sha256", "error")])


def _same():
    from pyspark.sql import Window

    return Window.partitionBy("file", "record").orderBy("place")
