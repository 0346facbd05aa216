"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi pass.

The automaton reports, at each place, all pieces that end there (its output links, longest first); each
relaxes the best score of its end from that of its begin, so one pass finds the segmentation with the
greatest sum of scores.  A character that no piece covers is spelled by byte pieces.  A space is written as
U+2581 and one is put before the text.  Where no piece has that mark behind another character, or a line
break beside one, words and breaks are segmented apart, and a task keeps those it has seen lately (a bounded
memory, not a cap).  Texts are taken in blocks: their words become numbers, and numbers become pieces, and
pieces bytes, by gathers from flat tables.

Defined results: a null text gives null pieces, an empty one none; equal texts give equal pieces; decoding
gives the text back exactly, U+2581 itself included (it is spelled by bytes); null pieces decode to null; a null
among pieces is skipped.  All columns of the input stay as they are: a result column whose name is taken, in any
letter case, gets `_` put behind its name.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .text import blocks, readable, text_bytes, unused

MARK = "▁"
KEEP = 100_000  # words a task remembers, and pieces of them in tens
_BYTE_COST = 1e12  # a byte piece is the last resort


@cache
def load_pieces(model: str) -> tuple[list[str], list[float], dict[int, int]]:
    """Pieces that are text (else ""), scores, and the ids of the byte pieces of a public model file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    n = p.get_piece_size()
    special = [p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i) for i in range(n)]
    return [("" if special[i] else p.id_to_piece(i)) for i in range(n)], [p.get_score(i) for i in range(n)], {int(p.id_to_piece(i)[1:-1], 16): i for i in range(n) if p.is_byte(i)}


def gathered(table: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs table[start[i]:start[i] + size[i]], one behind the other."""
    end = np.cumsum(size)
    return table[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - end + size, size)]


class Runs:
    """Byte strings that are gathered by number."""

    def __init__(self, strings: list[bytes]) -> None:
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return gathered(self.data, self.start[ids], self.size[ids])

    def offsets(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where in of(ids) the bytes of each text begin; text i has ids[first[i]:first[i + 1]]."""
        return np.append(0, np.cumsum(self.size[ids]))[first]


class _Numbers(dict):
    """Numbers of parts; one that is new gets its number as it is looked up."""

    def __init__(self, new) -> None:
        self.new = new

    def __missing__(self, part: str) -> int:
        return self.new(part)


class Encoder:
    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int]) -> None:
        self.pieces, self.byte_ids = pieces, byte_ids
        spelled = {i: bytes([b]) for b, i in byte_ids.items()}
        self.text = Runs([spelled.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)])
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(pieces):
            if p:
                self.automaton.add_word(p, (len(p), scores[i], i))
        self.automaton.make_automaton()
        # parts that no piece crosses: each from its run of spaces to the next, breaks by themselves
        if any(MARK in p.lstrip(MARK) for p in pieces):
            pattern = f"{MARK}|[^{MARK}]+"
        elif any("\n" in p and len(p) > 1 for p in pieces):
            pattern = f"{MARK}| *[^ {MARK}]+| +"
        else:
            pattern = f"{MARK}|\n| *[^ \n{MARK}]+| +"
        self.parts = re.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        """A mark in the text is no space: it is spelled."""
        self.seen = _Numbers(self.number)
        self.seen[MARK] = 0
        self.ids = array("i", [self.byte_ids[b] for b in MARK.encode()])
        self.begins = array("q", [0, len(self.ids)])

    def number(self, part: str) -> int:
        """The number of a part that was not seen before."""
        n = self.seen[part] = len(self.begins) - 1
        self.ids.fromlist(self.word(part.replace(" ", MARK)))
        self.begins.append(len(self.ids))
        return n

    def word(self, word: str) -> list[int]:
        """Best segmentation; ties go to the longer last piece.  Bytes are tried only where pieces alone do not reach the end."""
        n = len(word)
        best, use = [0.0] + [-1e300] * n, [(0, 0.0, -1)] * (n + 1)
        for end, piece in self.automaton.iter(word):
            s = best[end + 1 - piece[0]] + piece[1]
            if s > best[end + 1]:
                best[end + 1], use[end + 1] = s, piece
        if best[n] == -1e300:
            return self.spelled(word)
        out: list[int] = []
        while n:
            size, _, i = use[n]
            out.append(i)
            n -= size
        return out[::-1]

    def spelled(self, word: str) -> list[int]:
        """As word, with any character also to be had as its bytes, at a cost above all pieces'."""
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(len(word) + 1)]
        for end, piece in self.automaton.iter(word):
            ends[end + 1].append(piece)
        best, use = [0.0], [(0, 0.0, -1)]
        for e in range(1, len(word) + 1):
            top, own = best[e - 1] - _BYTE_COST, (1, 0.0, -1)
            for piece in ends[e]:
                if (s := best[e - piece[0]] + piece[1]) > top:
                    top, own = s, piece
            best.append(top)
            use.append(own)
        out: list[int] = []
        e = len(word)
        while e:
            size, _, i = use[e]
            out += [i] if i >= 0 else [self.byte_ids[b] for b in reversed(word[e - 1].encode())]
            e -= size
        return out[::-1]

    def encode_block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one behind the other, and where each text's begin."""
        if len(self.seen) > KEEP or len(self.ids) > 10 * KEEP:
            self._forget()
        number, parts = self.seen.__getitem__, self.parts
        codes, first = array("q"), [0]
        for t in texts:
            if t:
                codes.extend(map(number, parts(" " + t)))
            first.append(len(codes))
        codes, begins = np.frombuffer(codes, np.int64) if codes else np.zeros(0, np.int64), np.array(self.begins)
        size = (begins[1:] - begins[:-1])[codes]
        return gathered(np.array(self.ids), begins[:-1][codes], size), np.append(0, np.cumsum(size))[first]

    def decode_block(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts, without the space put before each, and where each text's begin."""
        data, at = self.text.of(ids), self.text.offsets(ids, first)
        lead = at[:-1][np.diff(at) > 0]
        drop = np.zeros(len(data), bool)
        drop[lead] = data[lead] == 32
        return data[~drop], at - np.append(0, np.cumsum(drop))[at]

    def encode(self, text: str) -> list[int]:
        return self.encode_block([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_block(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace")


def _lists(ids: np.ndarray, first: np.ndarray, missing: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32(), mask=np.append(missing, False)), pa.array(ids, pa.int32()))


def _texts(data: np.ndarray, at: np.ndarray) -> list[str | None]:
    """The texts of a block; bytes that are no UTF-8 are replaced."""
    whole = data.tobytes()
    return [whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _nulls(column: pa.Array) -> np.ndarray:
    return column.is_null().to_numpy(zero_copy_only=False)


def _encoder(shared) -> Encoder:
    """Built for each task from a broadcast vocabulary (tens of thousands of pieces, whatever the data), so that no worker keeps its words."""
    return Encoder(*shared.value)


def _shared(docs: DataFrame, model: str):
    return docs.sparkSession.sparkContext.broadcast(load_pieces(model))


def encode_pieces(docs: DataFrame, model: str, *, text: str = "text", out: str = "pieces") -> DataFrame:
    """The rows and columns of docs and the array<int> column `out`."""
    shared = _shared(docs, model)
    (out,) = unused([out], docs.columns)
    frame, own = readable(docs, text)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for part, data, at in blocks(batch, own):
                ids = _lists(*encoder.encode_block(_texts(data, at)), _nulls(part.column(names.index(text))))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(names))] + [ids], names=[*names, out])

    return frame.mapInArrow(run, StructType(list(docs.schema)).add(out, ArrayType(IntegerType())))


def decode_pieces(docs: DataFrame, model: str, *, pieces: str = "pieces", out: str = "decoded") -> DataFrame:
    """The rows and columns of docs and the string column `out`."""
    shared = _shared(docs, model)
    (out,) = unused([out], docs.columns)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                column = part.column(names.index(pieces))
                flat = column.flatten()
                first = np.append(0, np.cumsum([n or 0 for n in pa.compute.list_value_length(column).to_pylist()]))
                if flat.null_count:
                    kept = ~_nulls(flat)
                    first, flat = np.append(0, np.cumsum(kept))[first], flat.drop_null()
                data, at = encoder.decode_block(flat.to_numpy(zero_copy_only=False), first)
                missing = _nulls(column)
                texts = pa.array([None if m else t for t, m in zip(_texts(data, at), missing.tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(names))] + [texts], names=[*names, out])

    return docs.mapInArrow(run, StructType(list(docs.schema)).add(out, StringType()))


def piece_digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, n_spelled (pieces of one byte), pieces_sha256 (ids, comma-joined), exact (decoding gives the text back); one pass."""
    shared = _shared(docs, model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        digits = Runs([b"%d," % i for i in range(len(encoder.pieces))])
        spelled = np.zeros(len(encoder.pieces), np.int64)
        spelled[list(encoder.byte_ids.values())] = 1
        for batch in batches:
            for part, data, at in blocks(batch, "text"):
                ids, first = encoder.encode_block(_texts(data, at))
                back, ends = encoder.decode_block(ids, first)
                a, b, c = memoryview(np.ascontiguousarray(data)), memoryview(back), memoryview(digits.of(ids))
                exact = [a[i:j] == b[k:m] for i, j, k, m in zip(at[:-1].tolist(), at[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist())]
                cut = digits.offsets(ids, first).tolist()
                sha = [hashlib.sha256(c[i : max(i, j - 1)]).hexdigest() for i, j in zip(cut, cut[1:])]
                sha = pa.array(sha, pa.string(), mask=_nulls(part.column("present")))
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(np.diff(np.append(0, np.cumsum(spelled[ids]))[first])), sha, pa.array(exact, pa.bool_())], names=["doc_id", "n_pieces", "n_spelled", "pieces_sha256", "exact"])

    own = docs.select("doc_id", text_bytes("text").alias("text"), F.when(F.col("text").isNotNull(), 1).alias("present"))
    return own.mapInArrow(run, f"doc_id {kind}, n_pieces long, n_spelled long, pieces_sha256 string, exact boolean")
