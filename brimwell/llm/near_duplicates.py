"""N-gram Jaccard join with Bayesian candidate pruning.

A document is its set of five-word shingles (a text of one to four words is one shingle of all its words).
Equal sets are one representative.  Representatives meet in the buckets of BANDS bands of ROWS MinHash
values (a pair of similarity 0.8 is missed with probability 3e-7).  In a bucket, pairs are compared step by
step: after each step of MinHash values the posterior probability, under a uniform prior, that the
similarity reaches the threshold is looked up by the matches so far, and a pair below `tolerance` is
dropped.  Pairs that remain join their rows to loose classes; no row is exempt from comparison but by being
in the loose class already, so a bucket gives fewer pairs than it has rows and loses none that would join two.

A bucket of more than HOT rows is dealt into blocks of half as many, and each pair of blocks is one part, so that
every pair of the bucket meets; a row is sent to as many parts as its bucket has blocks.

Everything goes by a 128-bit key of a text's set of shingles; ids, which may be null or repeated, come in again at the end.

Links are then found loose class by loose class, exactly: it is dealt into blocks, and each pair of blocks is one
group in which all its sets are held against each other by matrix products that give counts, not pairs, and
for each set the least id that the group's links lead to.  Those join to the classes.  A loose class of up to
BLOCK sets is one group; beyond that a set is sent to as many groups as the loose class has blocks.

Defined results: null and empty texts, and those without words, are classes of their own without links;
equal rows fall in one class; the class id is its least doc_id that is not null, and null where all are; rows of one
doc_id are told apart by their texts; an empty table gives no rows; further
columns don't matter.  n_links counts the other rows of a row's class that reach the threshold with it, copies
included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import _GRAM, blocks, discarded, mix, runs, split_words, starts, text_bytes, unused, written

BANDS, ROWS = 21, 3
SHINGLE, THRESHOLD, TOLERANCE, STEP = 5, 0.8, 1e-4, 9
HOT, SMALL = 2048, 12
HELD = 1_000_000  # hashes that are broadcast at most
BLOCK, BLOCK_SHINGLES, COLUMNS = 2048, 2_000_000, 2048
_rng = np.random.default_rng(5150)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    k = min(k, len(h))
    if not k:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out += h[j : len(h) - k + 1 + j] * _GRAM[j]
    return np.unique(mix(out))


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a set; long sets are taken in pieces."""
    out = np.full(len(_A), 2**64 - 1, np.uint64)
    for a in range(0, len(s), 2048):
        x = (s[a : a + 2048, None] ^ _B) * _A
        x ^= x >> np.uint64(29)
        np.minimum(out, (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=0), out=out)
    return out


@cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each step, the matches below which the posterior that the similarity reaches the threshold is under the tolerance."""
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256  # MinHash values are compared by one byte
    out = []
    for n in range(STEP, len(_A) + 1, STEP):
        m = 0
        while m <= n:
            like = np.exp(m * np.log(p) + (n - m) * np.log1p(-p * (1 - 1e-12)))
            if like[s >= threshold].sum() / like.sum() >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survivors(sig: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which of the pairs (a, b) remain after the length filter and all steps."""
    left = np.flatnonzero(np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]))
    have = np.zeros(len(left), np.int64)
    for k, least in enumerate(least_matches(threshold, tolerance)):
        if not len(left):
            break
        own = slice(k * STEP, (k + 1) * STEP)
        have += (sig[a[left], own] == sig[b[left], own]).sum(axis=1)
        stay = have >= least
        left, have = left[stay], have[stay]
    return left


def forest(sig: np.ndarray, size: np.ndarray, rows: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Remaining pairs that join all rows which any remaining pairs join: each row meets every row that is not yet joined to it."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(rows) > 1:
        todo, rows = [int(rows[0])], rows[1:]
        while todo and len(rows):
            i = todo.pop()
            keep = survivors(sig, size, np.full(len(rows), i), rows, threshold, tolerance)
            left.append(np.full(len(keep), i))
            right.append(rows[keep])
            todo += rows[keep].tolist()
            rows = np.delete(rows, keep)
    return np.concatenate(left), np.concatenate(right)


def key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def signed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, h, key of the set, its size, sig, bands); h is a hash of the text, and a text without words has no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                w = split_words(data, offsets)
                keys, size, sigs, bands = [], [], [], []
                for t in range(part.num_rows):
                    s = shingles(w.hash[w.first[t] : w.first[t + 1]])
                    m = signature(s)
                    b = np.arange(BANDS, dtype=np.uint64)
                    for j in range(ROWS):
                        b = mix(b ^ m[j::ROWS])
                    keys.append(key(s))
                    size.append(len(s))
                    sigs.append((m >> np.uint64(40)).astype(np.uint8).tobytes())
                    bands.append(b.view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array(keys, pa.binary()), pa.array(size, pa.int32()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "h", "key", "n", "sig", "bands"])

    kind = docs.schema[id].dataType.simpleString()
    own = docs.select(F.col(id).alias("id"), text_bytes(text).alias("text")).withColumn("h", F.xxhash64("text"))
    return own.mapInArrow(run, f"id {kind}, h long, key binary, n int, sig binary, bands array<long>")


def shingled(docs: DataFrame, text: str, members: DataFrame) -> DataFrame:
    """(key, shingles) of members (h, key): their texts are read again, so that no other text's shingles are kept.

    Up to HELD members their hashes are broadcast and no text moves; beyond that the texts, equal ones as one, are
    joined with them by shuffle.
    """
    shared = None
    if members.count() <= HELD:
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(members.select("h").distinct().toArrow().column("h").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # of members only
        for batch in batches:
            if shared is not None and batch.num_rows:
                known, h = shared.value, batch.column("h").to_numpy()
                batch = batch.filter(pa.array(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)))
            for _, data, offsets in blocks(batch, "text"):
                w = split_words(data, offsets)
                sets = [shingles(w.hash[w.first[t] : w.first[t + 1]]) for t in range(len(offsets) - 1)]
                new = [(k, s) for k, s in ((key(s), s) for s in sets) if k is not None and not (k in seen or seen.add(k))]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in new], pa.binary()), pa.array([s.view(np.int64) for _, s in new], pa.list_(pa.int64()))], names=["key", "shingles"])

    texts = docs.select(text_bytes(text).alias("text")).withColumn("h", F.xxhash64("text"))
    if shared is None:
        texts = texts.dropDuplicates(["h", "text"]).join(members.select("h").distinct(), "h", "left_semi")
    return texts.mapInArrow(run, "key binary, shingles array<long>")


def candidates(reps: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Distinct pairs (a < b) of keys that join all which remain after pruning."""
    placed = reps.select("key", F.explode("bands").alias("band"))
    many = written(placed.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"))  # most buckets hold one row
    cut = F.when(F.col("m") > HOT, F.ceil(F.col("m") / (HOT // 2)).cast("int"))
    dealt = placed.join(many.select("band", cut.alias("blocks")), "band")
    own = F.pmod(F.xxhash64("key", "band"), F.col("blocks")).cast("int")
    dealt = dealt.groupBy("key").agg(F.collect_list(F.struct("band", "blocks")).alias("b")).join(reps.select("key", "n", "sig"), "key")  # BANDS at most
    dealt = dealt.select("key", "n", "sig", F.inline("b")).withColumn("own", own).withColumn("other", F.explode(F.expr("if(blocks is null, array(cast(null as int)), sequence(0, blocks - 1))")))
    part = F.when(F.col("blocks").isNull(), F.col("band")).otherwise(F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["part"]):
            keys, size = table.column("key").combine_chunks(), table.column("n").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, len(_A))
            first = starts(table, ["part"])
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in zip(first.tolist(), np.append(first[1:], table.num_rows).tolist()):
                m = hi - lo
                if m <= SMALL:
                    a, b = np.triu_indices(m, 1)
                    a, b = a + lo, b + lo
                    keep = survivors(sig, size, a, b, threshold, tolerance)
                    a, b = a[keep], b[keep]
                else:
                    a, b = forest(sig, size, np.arange(lo, hi), threshold, tolerance)
                left.append(a)
                right.append(b)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(x))) for x in (left, right)], names=["a", "b"])

    met = dealt.select("key", "n", "sig", part.alias("part")).repartition("part").sortWithinPartitions("part", "key").mapInArrow(meet, "a binary, b binary")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(key, c): the least key that links lead to, by label spreading with pointer jumps."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = written(both.groupBy("a").agg(F.min("b").alias("c")).select(F.col("a").alias("key"), F.least("a", "c").alias("c")))
    while True:
        near = both.join(labels, both.b == labels.key).groupBy("a").agg(F.min("c").alias("m"))
        step = labels.join(near, labels.key == near.a).select("key", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        to = labels.select(F.col("key").alias("c"), F.col("c").alias("far"))
        new = written(step.join(to, "c", "left").select("key", "old", F.least("c", F.coalesce("far", "c")).alias("c")))
        discarded(labels)
        labels = new
        if new.where("old <> c").isEmpty():
            discarded(both)
            return labels


def shared_counts(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Shared values of all pairs of sets as a matrix; values[k] is in the set row[k]."""
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    new = np.cumsum(times > 1) - 1
    often = times[column] > 1
    column, row = new[column[often]], row[often]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((rows, rows), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        held = np.zeros((rows, min(COLUMNS, int(column[-1]) + 1 - lo)), np.float32)
        held[row[a:b], column[a:b] - lo] = 1
        out += held @ held.T
    return out


def joined(linked: np.ndarray) -> np.ndarray:
    """For each row the first row that links lead to; linked is symmetric."""
    least, rest = np.zeros(len(linked), np.int64), np.ones(len(linked), bool)
    while rest.any():
        own = np.zeros(len(linked), bool)
        edge = np.flatnonzero(rest)[:1]
        while len(edge):
            own[edge], rest[edge] = True, False
            edge = np.flatnonzero(linked[edge].any(axis=0) & rest)
        least[own] = np.flatnonzero(own)[0]
    return least


def links_within(sets: DataFrame, threshold: float) -> DataFrame:
    """(key, p, least) in parts: the rows of other sets of the loose class that reach the threshold with this set, and a key that links lead to."""
    blocks_of = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    large = written(sets.groupBy("c").agg(blocks_of.alias("blocks")).where("blocks > 1"))
    members = sets.join(F.broadcast(large) if large.count() <= 100_000 else large, "c", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select(F.xxhash64("c", F.least("own", "other"), F.greatest("own", "other")).alias("part"), "c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", F.col("n").cast("long").alias("n"), "copies", "shingles")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["c", "i", "j"], BLOCK):
            first = starts(table, ["c", "i", "j"])
            own, n, copies, at = (table.column(k).to_numpy() for k in ("own", "n", "copies", "i"))
            keys = table.column("key").combine_chunks()
            p, least = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, np.int64)
            across = table.column("j").to_numpy() != at
            for lo, hi in zip(first.tolist(), np.append(first[1:], table.num_rows).tolist()):
                lists = table.column("shingles").slice(lo, hi - lo).combine_chunks()
                size = n[lo:hi]
                both = shared_counts(lists.flatten().to_numpy(), np.repeat(np.arange(hi - lo), size), hi - lo)
                linked = both >= threshold * (size[:, None] + size - both) - 1e-9
                linked &= own[lo:hi, None] != own[lo:hi] if across[lo] else ~np.eye(hi - lo, dtype=bool)
                p[lo:hi] = linked @ copies[lo:hi]
                least[lo:hi] = lo + joined(linked)
            yield pa.RecordBatch.from_arrays([keys, pa.array(p), keys.take(pa.array(least))], names=["key", "p", "least"])

    return dealt.repartition("part").drop("part").sortWithinPartitions("c", "i", "j", "key").mapInArrow(count, "key binary, p long, least binary")


def classified(docs: DataFrame, id: str, text: str, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(id, h, key, n) of each document, and (key, id, h, c, n_links) of each key: its row of least id, its class and its links."""
    table = written(signed(docs, id, text))
    first = F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("first")  # null ids come last
    reps = written(table.where("key is not null").groupBy("key").agg(first, F.count("*").alias("copies"), F.first(F.struct("n", "sig", "bands")).alias("r")).select("key", "first.id", "first.h", "copies", "r.*"))
    pairs = written(candidates(reps, threshold, tolerance))
    loose = written(reps.select("key", "h", "copies", "n").join(components(pairs), "key"))
    sets = written(shingled(docs, text, loose).join(loose.drop("h"), "key").dropDuplicates(["key"]))
    found = written(links_within(sets, threshold))
    discarded(pairs, loose, sets)
    classes = components(found.where("least <> key").select(F.col("least").alias("a"), F.col("key").alias("b")))
    partners = found.groupBy("key").agg(F.sum("p").alias("p"))
    known = reps.select("key", "id", "h", "copies").join(classes, "key", "left").join(partners, "key", "left")
    known = written(known.select("key", "id", "h", F.coalesce("c", "key").alias("c"), (F.col("copies") - 1 + F.coalesce("p", F.lit(0))).alias("n_links")))
    discarded(reps, found)
    return table.select("id", "h", "key", "n"), known


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """A row for each document: id, class_id, n_links, n_shingles (size of its set)."""
    table, known = classified(docs, id, text, threshold, tolerance)
    whole = known.join(known.groupBy("c").agg(F.min("id").alias("class_id")), "c").select("key", "class_id", "n_links")
    out = table.where("key is not null").join(whole, "key").select("id", "class_id", "n_links", "n")
    plain = table.where("key is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n")
    return out.unionByName(plain).select(F.col("id").alias(id), "class_id", "n_links", F.col("n").cast("long").alias("n_shingles"))


def one_of_each(docs: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of docs that are the first of their class: the least doc_id (null last), then the least hash of the text; of equal ones any.

    Texts do not move: the rows that go are told by id and a hash of the text, broadcast where they are few.
    """
    table, known = classified(docs, id, text, threshold, tolerance)
    row, hash, text_hash = unused(["row", "hash", "text hash"], docs.columns)
    first = known.groupBy("c").agg(F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("first")).select("first.id", "first.h")
    rows = table.where("key is not null").groupBy("id", "h").agg(F.count("*").alias("m"))
    stay = written(rows.alias("r").join(first.alias("f"), F.expr("r.id <=> f.id and r.h = f.h")).select("r.*"))
    go = written(rows.alias("r").join(stay.alias("s"), F.expr("r.id <=> s.id and r.h = s.h"), "left_anti").select(F.col("id").alias(row), F.col("h").alias(hash)))
    again = written(stay.where("m > 1").select(F.col("id").alias(row), F.col("h").alias(hash)))
    few = lambda t: F.broadcast(t) if t.count() <= HELD else t
    hashed = docs.withColumn(text_hash, F.xxhash64(text_bytes(text)))
    own = lambda t: F.col(f"`{id}`").eqNullSafe(t[row]) & (F.col(f"`{text_hash}`") == t[hash])
    kept = hashed.join(few(go), own(go), "left_anti")
    if again.isEmpty():
        return kept.drop(text_hash)
    again = few(again)
    once = kept.join(again, own(again), "left_semi").dropDuplicates([id, text_hash])
    return kept.join(again, own(again), "left_anti").unionByName(once).drop(text_hash)
