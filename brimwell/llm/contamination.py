"""Benchmark decontamination by winnowing.

Texts are split into words; of the k-gram hashes in each window of w places the least one (the last of
equals) is a fingerprint.  With k + w - 1 <= span, two texts that share `span` words in a row share a
fingerprint there.  The documents' fingerprints are looked up among the benchmark's; each hit is then extended:
all spans of `span` words around it are looked up, first by hash, then word by word.  Items of fewer
words than `span` are looked up whole, as spans of their own length.

A benchmark of up to BLOCK_CHARS bytes is broadcast: one pass over the documents, without a shuffle.  A larger one becomes
tables, made in tasks: its spans by the MD5 of their words, and two bit tables of bounded size, one of its fingerprints and one of
its spans, which alone go to the workers.  One pass over the documents then gives the spans around fingerprints that both
bit tables know, each text once (told by its MD5); joins by shuffle of these candidates with the benchmark's spans
decide.  What a bit table lets through in error costs a row in that join and nothing else; memory does not grow with the benchmark.

Defined results: null and empty texts have no words and no hits; an item without words is none; equal
rows give equal rows; tables without rows give none; an item_id that stands in several rows counts once;
items of null id hit words as any other and count as one unnamed item, which is not among the names that are
hashed.  All columns of the input stay as they are: a result column whose name is taken, in any letter case, gets `_`
put behind its name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .text import Words, blocks, discarded, readable, split_words, text_bytes, unused, written

SPAN, K = 13, 5
BLOCK_CHARS = 2 << 20  # bytes of a benchmark that is broadcast: about 60 MB in a worker
MOST_BITS = 28  # 32 MB in a worker for each of the two bit tables
_HITS = ArrayType(StructType().add("a", "long").add("b", "long"))


def winnow(h: np.ndarray, ok: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash of every window of w places, the last of equals. Windows that cross texts only add places."""
    if len(h) == 0:
        return np.zeros(0, np.int64)
    h = np.where(ok, h, np.uint64(2**64 - 1))
    if len(h) <= w:
        least = np.full(1, len(h) - 1 - int(np.argmin(h[::-1])))
        return np.unique(np.append(least, np.flatnonzero(ok)))  # short: all of them
    view = np.lib.stride_tricks.sliding_window_view(h[::-1], w)
    out = []
    for a in range(0, len(view), 1 << 18):
        out.append(np.unique(np.argmin(view[a : a + (1 << 18)], axis=1) + np.arange(a, min(a + (1 << 18), len(view)))))
    return np.unique(len(h) - 1 - np.concatenate(out))


def joined_words(words: Words) -> tuple[bytes, np.ndarray]:
    """The words with a space behind each, and where each begins."""
    size = words.end - words.start
    begin = np.append(0, np.cumsum(size + 1))
    out = np.full(int(begin[-1]), 32, np.uint8)
    to = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    out[to] = words.low[to + np.repeat(words.start - begin[:-1], size)]
    return out.tobytes(), begin


class Table:
    """Spans of one length: by hash, the words of one of them and the items of all."""

    def __init__(self, size: int, hashes: np.ndarray, places: np.ndarray, items: np.ndarray, text: bytes, begin: np.ndarray) -> None:
        by = np.lexsort((places, hashes))
        hashes, places, items = hashes[by], places[by], items[by]
        self.keys, first = np.unique(hashes, return_index=True)
        self.first, self.items = np.append(first, len(hashes)), items
        self.low, self.high = begin[places[first]], begin[places[first] + size]
        self.other: dict[int, dict[bytes, list[int]]] = {}  # spans that share a hash and not the words
        for n in np.flatnonzero(np.diff(self.first) > 1).tolist():
            own: dict[bytes, list[int]] = {}
            for p, item in zip(places[self.first[n] : self.first[n + 1]].tolist(), items[self.first[n] : self.first[n + 1]].tolist()):
                own.setdefault(text[begin[p] : begin[p + size]], []).append(item)
            if len(own) > 1:
                self.other[n] = own

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are here, and their numbers."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.keys[at] == hashes, at


class Spans:
    """Fingerprints and spans of one block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, bytes]], span: int = SPAN, k: int = K) -> None:
        self.span, self.k, self.w = span, k, span - k + 1
        self.names = [name for name, _ in items]
        data = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        words = split_words(data, np.append(0, np.cumsum([len(t) for _, t in items])).astype(np.int64))
        self.text, begin = joined_words(words)
        n, item = np.diff(words.first), words.text_of()
        small, fine = words.grams(k)
        at = winnow(small, fine, self.w)
        self.prints = np.unique(small[at[fine[at]]])
        self.tables: dict[int, Table] = {}
        for size in sorted({min(int(x), span) for x in n if x}):
            g, ok = words.grams(size)
            places = np.flatnonzero(ok) if size == span else words.first[:-1][n == size]
            self.tables[size] = Table(size, g[places], places, item[places], self.text, begin)

    def block(self, words: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words are hit, and each text's items by number."""
        n = len(words.hash)
        cover = np.zeros(n + 1, np.int64)
        found: dict[int, set[int]] = {}
        text_of = words.text_of()
        own = None
        for size, table in self.tables.items():
            g, ok = words.grams(size)
            if size == self.span:
                small, fine = words.grams(self.k)
                at = winnow(small, fine, self.w)
                at = at[_in(self.prints, small[at]) & fine[at]]
                near = (at[:, None] - np.arange(self.w)[None, :]).ravel()
                near = np.unique(near[(near >= 0) & (near < len(g))])
            else:
                near = np.arange(len(g))
            near = near[ok[near]]
            hit, at = table.places(g[near])
            near, at = near[hit], at[hit]
            if not len(near):
                continue
            if own is None:
                own = joined_words(words)
            a, b = own[1][near], own[1][near + size]
            real = np.ones(len(near), bool)
            pairs = set()
            for i, (p, x, lo, hi) in enumerate(zip(near.tolist(), at.tolist(), a.tolist(), b.tolist())):
                if x in table.other:
                    items = table.other[x].get(own[0][lo:hi])
                    real[i] = items is not None
                    found.setdefault(int(text_of[p]), set()).update(items or ())
                elif own[0][lo:hi] == self.text[table.low[x] : table.high[x]]:
                    pairs.add((int(text_of[p]), x))
                else:
                    real[i] = False
            for t, x in pairs:
                found.setdefault(t, set()).update(table.items[table.first[x] : table.first[x + 1]].tolist())
            cover[near[real]] += 1
            np.subtract.at(cover, near[real] + size, 1)
        return np.cumsum(cover)[:n] > 0, {t: x for t, x in found.items() if x}


def _in(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    if len(table) == 0:
        return np.zeros(len(x), bool)
    at = np.searchsorted(table, x)
    return table[np.minimum(at, len(table) - 1)] == x


class Bits:
    """A bit for each of the uppermost bits of a hash: what is not in it was never put in."""

    def __init__(self, rows: pa.Table, bits: int) -> None:
        self.shift = np.uint64(64 - bits)
        self.words = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
        self.words[rows.column("slot").to_numpy()] = rows.column("mask").to_numpy().astype(np.uint64)

    def known(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _bits(hashes: DataFrame, count: int) -> Bits:
    """The bit table of a column `h`: 16 bits for each value, within bounds; merged by an aggregation of its 64-bit words."""
    bits = min(MOST_BITS, max(16, int(count * 16).bit_length()))
    slot = F.shiftrightunsigned("h", 64 - bits + 6)
    mask = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")
    return Bits(hashes.groupBy(slot.alias("slot")).agg(F.bit_or(mask).alias("mask")).toArrow(), bits)


def _digests(text: bytes, begin: np.ndarray, places: np.ndarray, size: int) -> list[bytes]:
    return [hashlib.md5(text[a : b - 1]).digest() for a, b in zip(begin[places].tolist(), begin[places + size].tolist())]


def _benchmark_table(benchmark: DataFrame, id: str, text: str, span: int, k: int) -> DataFrame:
    """(item, size, digest, h, prints): a row for each span of each item; prints, on an item's first span, are all its fingerprints."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "t"):
                words = split_words(data, offsets)
                joined, begin = joined_words(words)
                n, item = np.diff(words.first), words.text_of()
                small, fine = words.grams(k)
                at = winnow(small, fine, span - k + 1)
                at = at[fine[at]]
                for size in sorted({min(int(x), span) for x in n if x}):
                    g, ok = words.grams(size)
                    places = np.flatnonzero(ok) if size == span else words.first[:-1][n == size]
                    lists: list = [[] for _ in places]
                    if size == span and len(places):
                        lists[0] = small[at].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([part.column("i").take(pa.array(item[places])), pa.array(np.full(len(places), size, np.int32)), pa.array(_digests(joined, begin, places, size), pa.binary()), pa.array(g[places].astype(np.int64)), pa.array(lists, pa.list_(pa.int64()))], names=["item", "size", "digest", "h", "prints"])

    items = benchmark.select(F.col(id).cast("string").alias("i"), text_bytes(text).alias("t"))
    return items.mapInArrow(cut, "item string, size int, digest binary, h long, prints array<long>")


def _candidates(texts: DataFrame, own: str, key: str, spans: Bits, prints: Bits, sizes: list[int], span: int, k: int) -> DataFrame:
    """(key, n_words, spans) of each text; spans (place, size, digest) are those that both bit tables know."""
    shared = texts.sparkSession.sparkContext.broadcast((spans, prints))
    kind = pa.list_(pa.struct([("place", pa.int64()), ("size", pa.int32()), ("digest", pa.binary())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, prints = shared.value
        for batch in batches:
            for part, data, offsets in blocks(batch, own):
                words = split_words(data, offsets)
                found: list[list] = [[] for _ in range(part.num_rows)]
                text_of, joined = words.text_of(), None
                for size in sizes:
                    g, ok = words.grams(size)
                    if size == span:
                        small, fine = words.grams(k)
                        at = winnow(small, fine, span - k + 1)
                        at = at[fine[at] & prints.known(small[at])]
                        near = (at[:, None] - np.arange(span - k + 1)[None, :]).ravel()
                        near = np.unique(near[(near >= 0) & (near < len(g))])
                    else:
                        near = np.arange(len(g))
                    near = near[ok[near]]
                    near = near[spans.known(g[near])]
                    if len(near):
                        joined = joined or joined_words(words)
                        for t, p, d in zip(text_of[near].tolist(), (near - words.first[text_of[near]]).tolist(), _digests(*joined, near, size)):
                            found[t].append({"place": p, "size": size, "digest": d})
                yield pa.RecordBatch.from_arrays([part.column(part.schema.names.index(key)), pa.array(np.diff(words.first), pa.int64()), pa.array(found, kind)], names=["key", "n_words", "spans"])

    return texts.select(key, own).mapInArrow(scan, "key binary, n_words long, spans array<struct<place: long, size: int, digest: binary>>")


def _joined_spans(frame: DataFrame, kept: list[str], benchmark: DataFrame, own: str, md5: Column, new: list[str], id: str, item_text: str, span: int, k: int) -> DataFrame:
    """As _pass, for a benchmark of any size."""
    table = written(_benchmark_table(benchmark, id, item_text, span, k))
    prints = table.where(F.size("prints") > 0).select(F.explode("prints").alias("h"))
    sizes = sorted(r.size for r in table.select("size").distinct().collect())
    spans = _bits(table.select("h"), table.count())
    (key,) = unused(["text md5"], frame.columns)
    texts = _candidates(frame.withColumn(key, md5), own, key, spans, _bits(prints, prints.count()), sizes, span, k)
    texts = written(texts.dropDuplicates(["key"]))
    likely = texts.where(F.size("spans") > 0).select("key", F.inline("spans"))
    real = written(table.select("digest").distinct())
    hit = written(likely.join(real, "digest"))  # hot spans: AQE splits the candidates of a span that many texts share
    hits = hit.groupBy("key").agg(F.collect_set(F.struct(F.col("place").alias("a"), (F.col("place") + F.col("size")).alias("b"))).alias("hits"))
    items = hit.select("key", "digest").distinct().join(table.select("digest", "item").distinct(), "digest").select("key", "item").distinct()
    named = items.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("item"))).alias("items")).select("key", F.transform("items", lambda i: i["item"]).alias("items"))
    found = texts.select("key", "n_words").join(hits, "key", "left").join(named, "key", "left")
    out = written(found.select(F.col("key").alias(key), F.col("n_words").alias(new[0]), F.coalesce("hits", F.array().cast(_HITS)).alias(new[1]), F.coalesce("items", F.array().cast("array<string>")).alias(new[2])))
    discarded(table, texts, real, hit)
    keyed = frame.select(*[F.col(f"`{c}`") for c in kept], md5.alias(key))
    return keyed.join(out, key).drop(key).select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`") for c in new])


_spans: dict[tuple, Spans] = {}


def _spans_of(items, span: int, k: int) -> Spans:
    """Built once for each worker process, which holds one block."""
    name = (items.value[0], span, k)
    if name not in _spans:
        _spans.clear()
        _spans[name] = Spans(items.value[1], span, k)
    return _spans[name]


def _pass(frame: DataFrame, kept: list[str], items, own: str, new: list[str], span: int, k: int) -> DataFrame:
    """The columns `kept` of frame and, from the texts `own`, `new`: the number of words, the hits and the items of a block."""
    schema = StructType([frame.schema[c] for c in kept])
    for c, kind in zip(new, (LongType(), _HITS, ArrayType(StringType()))):
        schema = schema.add(c, kind)
    hits_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = _spans_of(items, span, k)
        for batch in batches:
            for part, data, offsets in blocks(batch, own):
                words = split_words(data, offsets)
                hit, found = spans.block(words)
                hits, names = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
                for t, items_ in found.items():
                    a, b = int(words.first[t]), int(words.first[t + 1])
                    edge = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
                    hits[t] = [{"a": int(x), "b": int(y)} for x, y in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0))]
                    names[t] = list({spans.names[x] for x in items_})
                columns = [part.column(part.schema.names.index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(words.first), pa.int64()), pa.array(hits, hits_type), pa.array(names, pa.list_(pa.string()))], names=[*kept, *new])

    return frame.mapInArrow(scan, schema)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, block_chars: int = BLOCK_CHARS, keep: list[str] | None = None) -> DataFrame:
    """The rows and columns of docs (or those of `keep`) with `n_words`, `hits` (array of [a, b) in words, which may overlap) and `items` (names)."""
    kept = docs.columns if keep is None else keep
    new = unused(["n_words", "hits", "items"], docs.columns)
    frame, own = readable(docs, text)
    items = benchmark.select(F.col(item).cast("string").alias("i"), text_bytes(item_text).alias("t"))
    if (items.agg(F.sum(F.length("t"))).first()[0] or 0) <= block_chars:
        block = [(r.i, bytes(r.t)) for r in items.collect()]
        return _pass(frame, kept, docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block)), own, new, span, k)
    return _joined_spans(frame, kept, benchmark, own, F.unhex(F.md5(text_bytes(text))), new, item, item_text, span, k)


def _verdict(hits: Column, n_words: Column) -> Column:
    n_hit = covered(hits)
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """A row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    s = contaminated_spans(docs.select(F.col(id).alias("brimwell id"), F.col(text).alias("text")), benchmark, text="text", keep=["brimwell id"], **kw)
    names = F.array_sort(F.array_distinct("items"))
    return s.select(
        F.col("brimwell id").alias(id), "n_words", covered(F.col("hits")).alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        _verdict(F.col("hits"), F.col("n_words")).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **kw) -> DataFrame:
    """The rows and columns of docs that are not contaminated."""
    n_words, hits = unused(["n_words", "hits"], docs.columns)
    found = contaminated_spans(docs, benchmark, text=text, **kw)
    return found.where(~_verdict(F.col(hits), F.col(n_words))).select(*[F.col(f"`{c}`") for c in docs.columns])


def covered(hits: Column) -> Column:
    """Length of the union of intervals: sorted by begin, folded."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("until"))
    step = lambda s, h: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), h["b"] - F.greatest(h["a"], s["until"]))).alias("n"), F.greatest(s["until"], h["b"]).alias("until"))
    return F.when(F.size(hits) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.array_sort(hits), zero, step, lambda s: s["n"]))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w),13) AS k, unnest(list_transform(range(1, len(w)-least(len(w),13)+2), lambda i: array_to_string(w[i:i+least(len(w),13)-1],' '))) AS g FROM b WHERE len(w)>0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, unnest(range(1, len(w)-k+2)) AS i, unnest(list_transform(range(1, len(w)-k+2), lambda i: array_to_string(w[i:i+k-1],' '))) AS g FROM d, ks WHERE len(w)>=k),
h AS (SELECT r, i, dw.k, item_id FROM dw JOIN bw ON dw.k=bw.k AND dw.g=bw.g),
p AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(i, i+k)) AS q FROM (SELECT DISTINCT r, i, k FROM h)) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit,0) AS BIGINT) AS n_hit, CAST(coalesce(n_items,0) AS BIGINT) AS n_items, sha256(coalesce(names,'')) AS items_sha256,
 coalesce(n_hit,0)>0 AND 20*coalesce(n_hit,0)>=len(w) AS contaminated FROM d LEFT JOIN p USING (r) LEFT JOIN n USING (r)
"""
