"""Helpers that the text operators share: word splitting, hashing, Arrow blocks, scratch tables.

Everything here works on a block of texts at once (one byte buffer with offsets), so the cost of a
text is a few numpy passes over its bytes.  Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after
lower-casing A-Z; as bytes above 127 are all word bytes, the rule needs no decoding of UTF-8.
"""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

BLOCK_BYTES = 1 << 20  # texts are taken in blocks of about this many bytes; a longer text is a block of its own

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 1 << 12, dtype=np.uint64) | np.uint64(1)
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def hash_runs(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of bytes data[at[i]:at[i] + size[i]], which follow one another without a gap.

    Every byte is weighted by its place: from a table up to 4,095, beyond that by a mix of the place.
    """
    place = np.arange(len(data)) - np.repeat(at, size)
    weight = _PLACE[place & (len(_PLACE) - 1)]
    if size.max(initial=0) > len(_PLACE):
        far = place >= len(_PLACE)
        weight[far] = mix(mix(place[far].astype(np.uint64) + _PLACE[0])) | np.uint64(1)
    return mix(np.add.reduceat(_BYTE[data] * weight, at) + size.astype(np.uint64))


@dataclass
class Words:
    """The words of a block: byte ranges, 64-bit hashes, and where each text's words begin."""

    low: np.ndarray  # lower-cased bytes of the block
    first: np.ndarray  # len(texts) + 1 indices into the words
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words, and a mask of the places whose k words are of one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h += self.hash[j : n - k + 1 + j] * _GRAM[j]
        t = self.text_of()
        return mix(h), t[: n - k + 1] == t[k - 1 :]


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]."""
    low = LOWER[data]
    n = len(low)
    if n == 0:
        e = np.zeros(0, np.int64)
        return Words(low, np.zeros(len(offsets), np.int64), e, e, np.zeros(0, np.uint64))
    mask = IS_WORD[low]
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    edge = offsets[:-1]
    before[edge[edge < n]] = False
    start = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    edge = offsets[1:] - 1
    after[edge[edge >= 0]] = False
    end = np.flatnonzero(mask & ~after) + 1
    if len(start) == 0:
        h = np.zeros(0, np.uint64)
    else:
        size = end - start
        at = np.cumsum(size) - size
        own = low[mask]
        h = hash_runs(own, at, size)
    return Words(low, np.searchsorted(start, offsets), start, end, h)


def words_of(text: bytes) -> list[bytes]:
    """The words of one text as bytes: the plain form of split_words."""
    return text.translate(_TO_WORDS).split()


_TO_WORDS = bytes(int(LOWER[b]) if IS_WORD[LOWER[b]] else 32 for b in range(256))


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that split_words gives these words."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    return split_words(data, np.array([0, len(data)])).hash


def hash_gram(hashes: np.ndarray) -> int:
    """The hash that Words.grams gives these consecutive words."""
    h = np.zeros(1, np.uint64)
    for j, x in enumerate(hashes):
        h += x * _GRAM[j]
    return int(mix(h)[0])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string column; offsets start at 0, nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"", pa.binary()).cast(column.type))
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def give_back() -> None:
    """Freed memory goes back to the system; workers live on from stage to stage, and their allocators would hold it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch whose texts have about `size` bytes, each with its bytes and offsets."""
    if batch.num_rows == 0:
        return
    data, at = buffers(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    give_back()


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 15) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches that are sorted by keys: what a group has is never torn apart."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = starts(table, keys)[-1]
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        held, count = rest.combine_chunks().to_batches(), rest.num_rows
        rows = max(rows, 2 * count)
    if count:
        yield pa.Table.from_batches(held).combine_chunks()
    held = []
    give_back()


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows of a sorted table at which a group begins."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        c = table.column(k).combine_chunks() if isinstance(table.column(k), pa.ChunkedArray) else table.column(k)
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(new)


def text_bytes(column: str = "text") -> Column:
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def readable(docs: DataFrame, column: str = "text") -> tuple[DataFrame, str]:
    """docs and the column whose buffers hold the texts: strings and bytes go to the workers as they are, once."""
    if isinstance(docs.schema[column].dataType, (StringType, BinaryType)):
        return docs, column
    (own,) = unused(["text bytes"], docs.columns)
    return docs.withColumn(own, text_bytes(column)), own


def unused(names: list[str], columns: list[str]) -> list[str]:
    """The names that a result gets beside columns it may not overwrite: `_` is put behind those that are taken, letter case aside."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def most_frequent(table: DataFrame, column: str, room: int) -> Column:
    """A filter that keeps the rows of the greatest `column`, at most `room` of them; found from a histogram of 32 classes a factor of e."""
    level = lambda: F.floor(F.log(F.col(column).cast("double")) * 32)
    least = None
    for r in sorted(table.groupBy(level().alias("level")).agg(F.count("*").alias("m")).collect(), key=lambda r: -r.level):
        room -= r.m
        if room < 0:
            break
        least = r.level
    return level() >= least if least is not None else F.lit(False)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder that spark.checkpoint.dir names; without that, only a session on one machine gets one of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("brimwell.scratch.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file:///tmp/spark-brimwell-{uuid.uuid4().hex[:12]}"
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("brimwell.scratch.dir", base)
    return f"{base.rstrip('/')}/t-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder: cuts the lineage, outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._brimwell_path = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing that is still to be computed reads them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._brimwell_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
