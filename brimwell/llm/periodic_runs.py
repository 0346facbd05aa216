"""Periodic runs of words, found by block convolution.

A run is a stretch of words with least period q and at least max(LEAST, 4 * q) words that no neighbour extends.  Of
scale B = 1, 2, 4, ... are the periods B <= q < 2 * B.  Such a run holds a block of B words that begins at a multiple of B together with the
block's copy q words on.  For each block the sums of squared differences to all places of the window behind it come from one
convolution, a number theoretic transform in whole numbers modulo as many primes as the largest possible sum needs; a sum of nought is an
occurrence.  The distances of occurrences are seeds: from each the equality of words q apart is followed to both ends.
A stretch found with several periods has the least of them.  At scales under DIRECT, where a transform costs more than
the sum itself, the differences are taken place by place over the whole block of texts.

Two exact filters spare transforms: a block is passed over if one of its words does not come again within 2 * B words, or if
the block with its window lies in a run of a period of B at most, whose multiples are all that it could find.

Texts are taken in blocks (text.BLOCK_BYTES; a longer text is a block of its own), words of a block are numbered without
collisions, and a mark that equals nothing stands behind each text, so one transform serves many texts.  Work is at most in
proportion to n log^2 n words, memory to a block.

Defined results: null and empty texts have no words and no runs; an empty table gives an empty one; repeated
rows give repeated results.  All columns of the input stay; a result column whose name is taken gets `_` behind its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .text import blocks, readable, unused

LEAST, TIMES = 6, 4
DIRECT = 8
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))  # fixed values: primes of the form k * 2^m + 1, m of 25 at least, and a generator of each
CELLS = 1 << 18  # numbers that one batch of transforms holds
NEVER = np.int64(2**62)
_RUNS = ArrayType(StructType().add("start", "long").add("length", "long").add("period", "long"))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def numbered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of texts data[offsets[i]:offsets[i + 1]]: their numbers, each text's first word, begins and ends."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(word & (edge[:-1] | np.append(True, ~word[:-1])))
    end = np.flatnonzero(word & (edge[1:] | np.append(~word[1:], True))) + 1
    own = data[word]
    at = np.append(0, np.cumsum(end - start)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(own))])
    ids = column.dictionary_encode().indices.to_numpy().astype(np.int64) if len(start) else np.zeros(0, np.int64)
    return ids, np.searchsorted(start, offsets), start, end


def _powers(root: int, n: int, p: int) -> np.ndarray:
    """1, root, root^2, ... modulo p; n is a power of two."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), p)) % np.uint64(p)])
    return out


def transformed(rows: np.ndarray, p: int, g: int, back: bool = False) -> np.ndarray:
    """The transform of each row modulo p; the length is a power of two.  Places come in natural order."""
    m, n = rows.shape
    q = np.uint64(p)
    root = pow(g, (p - 1) // n, p)
    root = pow(root, p - 2, p) if back else root
    x = rows.reshape(m, 1, n)
    size = n
    while size > 1:  # self-sorting: halves of the input pair up, results interleave
        half = size // 2
        w = _powers(pow(root, n // size, p), half, p)
        a, b = x[:, :, :half], x[:, :, half:]
        low = a + b
        low = np.where(low >= q, low - q, low)
        high = (a + (q - b)) % q * w % q
        x = np.stack([low, high], axis=1).reshape(m, -1, half)
        size = half
    out = x.reshape(m, n)
    return out * np.uint64(pow(n, p - 2, p)) % q if back else out


def occurrences(ids: np.ndarray, starts: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of all d in [b, 2 * b) at which the b numbers from a start stand again; what lies behind the end equals nothing."""
    top = int(ids.max(initial=0)) + 1
    wide = np.append(np.where(ids < 0, top, ids), np.full(3 * b, top)).astype(np.uint64)  # marks: no block holds one
    primes, bound = [], 1
    for p in PRIMES:
        primes.append(p)
        bound *= p[0]
        if bound > b * top * top:
            break
    squares = {p: np.append(np.uint64(0), np.cumsum(wide * wide % np.uint64(p), dtype=np.uint64)) for p, _ in primes}
    found = []
    rows = max(1, CELLS // (2 * b))
    for k in range(0, len(starts), rows):
        s = starts[k : k + rows]
        block = np.zeros((len(s), 2 * b), np.uint64)
        block[:, :b] = wide[s[:, None] + np.arange(b - 1, -1, -1)]  # reversed, so that the product is a correlation
        window = np.zeros((len(s), 2 * b), np.uint64)
        window[:, : 2 * b - 1] = wide[s[:, None] + np.arange(b, 3 * b - 1)]
        nought = np.ones((len(s), b), bool)
        at = s[:, None] + np.arange(b, 2 * b)
        for p, g in primes:
            q = np.uint64(p)
            cross = transformed(transformed(block % q, p, g) * transformed(window % q, p, g) % q, p, g, back=True)[:, b - 1 : 2 * b - 1]
            own = (squares[p][s + b] - squares[p][s]) % q
            other = (squares[p][at + b] - squares[p][at]) % q
            nought &= (own[:, None] + other) % q == (2 * cross) % q
        r, d = np.nonzero(nought)
        found.append(np.stack([s[r], d + b]))
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def _same(ids: np.ndarray, i: int, d: int, step: int) -> int:
    """The first place from i on, in steps of 1 or -1, whose number is not that of the place d further."""
    chunk = 64
    while True:
        if step > 0:
            end = min(i + chunk, len(ids) - d)
            differ = ids[i:end] != ids[i + d : end + d]
            if differ.any():
                return i + int(differ.argmax())
            if end == len(ids) - d:
                return end
            i = end
        else:
            low = max(0, i - chunk + 1)
            differ = (ids[low : i + 1] != ids[low + d : i + 1 + d])[::-1]
            if differ.any():
                return i - int(differ.argmax())
            if low == 0:
                return -1
            i = low - 1
        chunk = min(2 * chunk, 1 << 16)


def _direct(ids: np.ndarray, d: int) -> np.ndarray:
    """(start, length, d) of the stretches of period d that are long enough."""
    differ = np.append(np.append(True, ids[:-d] != ids[d:]), True) if len(ids) > d else np.ones(2, bool)
    at = np.flatnonzero(differ)
    n = np.diff(at) - 1
    good = np.flatnonzero(n + d >= max(LEAST, TIMES * d))
    return np.stack([at[good], n[good] + d, np.full(len(good), d)])


def runs_of(ids: np.ndarray, longest: int) -> np.ndarray:
    """(start, length, period) columns of all runs of a row of numbers, by start, then period; negative numbers, all different, end a text.

    longest: no text has more words.
    """
    found = [_direct(ids, d) for d in range(1, min(DIRECT, longest // TIMES + 1))]
    b = DIRECT
    if b * TIMES <= longest:
        by = np.argsort(ids, kind="stable")
        again = np.full(len(ids), NEVER)
        same = ids[by[1:]] == ids[by[:-1]]
        again[by[:-1][same]] = np.diff(by)[same]
        far = again[: len(ids) // b * b].reshape(-1, b).max(axis=1)  # of each block the farthest next place of a word
    while b * TIMES <= longest:
        starts = np.flatnonzero(far < 2 * b) * b
        if len(starts):
            known = np.concatenate(found, axis=1)  # periods under b
            reach = np.zeros(len(ids) + 1, np.int64)  # how far the runs of small periods go that began at or before a place
            np.maximum.at(reach, known[0], known[0] + known[1])
            starts = starts[np.maximum.accumulate(reach)[starts] < starts + 3 * b - 1]
            found.append(_extended(ids, *occurrences(ids, starts, b), b))
        far = np.maximum(far[: len(far) // 2 * 2 : 2], far[1 : len(far) // 2 * 2 : 2])
        b *= 2
    both = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    both = both[:, np.lexsort((both[2], both[1], both[0]))]
    first = np.append(True, (np.diff(both[0]) != 0) | (np.diff(both[1]) != 0))[: both.shape[1]]
    both = both[:, first]  # one stretch, several periods: the least
    return both[:, np.lexsort((both[2], both[0]))]


def _extended(ids: np.ndarray, start: np.ndarray, distance: np.ndarray, b: int) -> np.ndarray:
    """The stretches around seeds; seeds inside a stretch that was followed are passed over."""
    by = np.lexsort((start, distance))
    out, last, until = [], -1, -1
    for s, d in zip(start[by].tolist(), distance[by].tolist()):
        if d == last and s < until:
            continue
        low, high = _same(ids, s, d, -1) + 1, _same(ids, s, d, 1)
        last, until = d, high
        if high - low + d >= max(LEAST, TIMES * d):
            out.append((low, high - low + d, d))
    return np.array(out, np.int64).reshape(-1, 3).T


def _collapsed(runs: np.ndarray, n: int) -> np.ndarray:
    """Which words of a block stay: all but those in a run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[0] + runs[2], 1)
    np.subtract.at(change, runs[0] + runs[1], 1)
    return np.cumsum(change[:n]) == 0


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, keep: np.ndarray, first: np.ndarray) -> pa.Array:
    """The kept words of each text with a space between, as large_string."""
    texts = len(first) - 1
    text_of = np.repeat(np.arange(texts), np.diff(first))
    start, end, text_of = start[keep], end[keep], text_of[keep]
    size = end - start
    leads = np.append(True, text_of[1:] != text_of[:-1])[: len(start)]
    begin = np.cumsum(size + ~leads) - size  # a space stands before each word but a text's first
    total = int(size.sum() + (~leads).sum())
    out = np.full(total, 32, np.uint8)
    shift = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin, size) + shift] = data[np.repeat(start, size) + shift]
    ends = np.zeros(texts + 1, np.int64)
    np.maximum.at(ends, text_of + 1, begin + size)
    return pa.LargeStringArray.from_buffers(texts, pa.py_buffer(np.maximum.accumulate(ends)), pa.py_buffer(out))


def periodic_runs(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with `runs`, array<struct<start, length, period>> by start, then period, in words, and `collapsed_text`: the words that no run repeats, joined by one space."""
    frame, own = readable(docs, text)
    kept = docs.columns
    new = unused(["runs", "collapsed_text"], docs.columns)
    schema = StructType([*docs.schema.fields]).add(new[0], _RUNS).add(new[1], StringType())
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, own):
                ids, first, start, end = numbered(data, offsets)
                n = np.diff(first)
                texts = len(n)
                marked = np.full(len(ids) + texts, -1, np.int64)
                mark = first[1:] + np.arange(texts)
                marked[mark] = -1 - np.arange(texts)
                text_of = np.repeat(np.arange(texts), n)
                marked[np.arange(len(ids)) + text_of] = ids
                runs = runs_of(marked, int(n.max(initial=0)))
                owner = np.searchsorted(mark, runs[0], "right")
                runs[0] -= owner  # now in words of the block
                keep = _collapsed(runs, len(ids))
                local = runs[0] - first[owner]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(texts + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(local), pa.array(runs[1]), pa.array(runs[2])], fields=list(kind)))
                columns = [part.column(part.schema.names.index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, lists, _joined(data, start, end, keep, first).cast(pa.string())], names=schema.names)

    return frame.mapInArrow(scan, schema)


def planted(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs whose texts of every tenth crc32 of the id repeat from a word on: word i >= a becomes word a + (i - a) % p. Null ids are left alone."""
    h = F.crc32(F.col(f"`{id}`").cast("string").cast("binary"))
    g = F.floor(h / 10)
    bare = F.btrim(F.col(f"`{text}`").cast("string"), F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(bare, "[\\x20\\x09-\\x0D]+")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        boxed = F.array(F.struct(w.alias("w"), (g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p")))
        place = lambda s, i: F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"])
        return F.transform(boxed, lambda s: F.array_join(F.transform(s["w"], lambda _, i: F.get(s["w"], place(s, i).cast("int"))), " "))[0]

    return docs.withColumn(text, F.when((h % 10 == 0) & (F.length(bare) > 0), repeated(words)).otherwise(F.col(f"`{text}`").cast("string")))


def run_digest(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_runs, the longest run, runs_sha256, collapsed_sha256."""
    found = periodic_runs(planted(docs.select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    top = lambda c, sign: (F.col(f"top.{c}") * sign).cast("long")
    return rows.select("doc_id", "n_runs", top("back", -1).alias("start"), top("length", 1).alias("length"), top("short", -1).alias("period"), F.expr("(1000 * top.length) div (-top.short)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


ORACLE = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
 list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))) AS raw FROM documents),
h AS (SELECT doc_id, r, w, len(w) AS n, xor(coalesce(raw, 0), 4294967295) AS h, raw IS NOT NULL AS named FROM t),
p AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
q AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM p),
d AS MATERIALIZED (SELECT doc_id, r, CASE WHEN named AND h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM q),
e AS MATERIALIZED (SELECT r, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
m AS (SELECT a.r, a.i, b.i - a.i AS d FROM e a JOIN e b ON a.r = b.r AND a.x = b.x AND a.i < b.i AND 4 * (b.i - a.i) <= a.n),
g AS (SELECT r, d, i, i - row_number() OVER (PARTITION BY r, d ORDER BY i) AS k FROM m),
s AS (SELECT r, d, min(i) AS start, count(*) + d AS length FROM g GROUP BY r, d, k HAVING count(*) + d >= greatest(6, 4 * d)),
u AS MATERIALIZED (SELECT r, start, length, min(d) AS period FROM s GROUP BY r, start, length),
v AS (SELECT r, count(*) AS n_runs, max({'l': length, 's': -start, 'p': -period}) AS top, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM u GROUP BY r),
y AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u),
z AS (SELECT e.r, string_agg(x, ' ' ORDER BY e.i) AS kept FROM e ANTI JOIN y ON e.r = y.r AND e.i = y.i GROUP BY e.r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(-top.s AS DOUBLE) AS start, CAST(top.l AS DOUBLE) AS length, CAST(-top.p AS DOUBLE) AS period,
 CAST(1000 * top.l // -top.p AS DOUBLE) AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN v USING (r) LEFT JOIN z USING (r)
"""
