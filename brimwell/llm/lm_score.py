"""LM scoring: code length of each text under a pretrained byte context tree, beside add-one unigram scores.

Token counts are an aggregation over all training texts.  The `head` most frequent tokens are broadcast (a
fixed number); what a text has beyond them, rare tokens by definition, is joined with the counts by shuffle.

Defined results: a null or empty text has one token, the end; equal rows give equal rows; with no training
text, N is 0 and every byte has 1/256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import held_out
from .ppm import finished, lengths_array, train
from .text import LOWER, blocks, hash_runs, most_frequent, text_bytes, written

ORDER = 4
HEAD = 400_000
END = 0  # the hash that stands for the end token
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens and the text of each; every text's end token comes too."""
    n = len(offsets) - 1
    row = np.full(len(data) + n, 32, np.uint8)
    row[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = LOWER[data]
    inside = ~_SPACE[row]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    text = np.searchsorted(offsets + np.arange(n + 1), start, "right") - 1
    if len(start):
        size = end - start
        at = np.cumsum(size) - size
        h = hash_runs(row[inside], at, size)
    else:
        h = np.zeros(0, np.uint64)
    return np.append(h, np.zeros(n, np.uint64)), np.append(text, np.arange(n))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, n) over all texts of a binary column `text`; token is its hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in blocks(batch, "text", 8 << 20):
                t, n = np.unique(token_hashes(data, offsets)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    return texts.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def score_texts(docs: DataFrame, *, id: str = "doc_id", text: str = "text", order: int = ORDER, head: int = HEAD) -> DataFrame:
    """A row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    own = docs.select(F.col(id).alias("id"), text_bytes(text).alias("text"), held_out(id, 7).alias("held_out"))
    training = own.where(~F.col("held_out"))
    counts = written(count_tokens(training.select("text")))
    v, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = counts.where(most_frequent(counts, "n", head)).toArrow()
    tokens, n = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    by = np.argsort(tokens)
    lookup = spark.sparkContext.broadcast((tokens[by], n[by]))
    tables, grams = train(training.select(F.lit("").alias("name"), "text"), order)
    model = spark.sparkContext.broadcast(tables)
    whole = float(np.log10(total + v + 1))
    kind = own.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, c), m = lookup.value, model.value
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                h, t = token_hashes(data, offsets)
                k = part.num_rows
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = known[at] == h
                    value = np.where(hit, np.log10(c[at] + 1.0), 0)
                else:
                    hit, value = np.zeros(len(h), bool), np.zeros(len(h))
                rest = ~hit if v > len(known) else np.zeros(len(h), bool)
                by = np.argsort(t[rest], kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(t[rest], minlength=k))), pa.int32()), pa.array(h[rest][by].view(np.int64)))
                s, others = m.parts(data, offsets)
                s = s if m.names else -np.log10(256) * (np.diff(offsets)[None, :] + 1.0)
                columns = [part.column("id"), part.column("held_out"), pa.array(np.bincount(t, minlength=k)), pa.array(np.bincount(t, hit, k).astype(np.int64)), pa.array(np.bincount(t, value, k)), lengths_array(s), others, lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "value", "lengths", "grams", "rest"])

    out = own.mapInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, value double, lengths array<double>, grams array<long>, rest array<long>")
    out = finished(out, tables, grams).withColumn("score", F.col("lengths")[0]).drop("lengths")
    if v > len(n):
        out = written(out.withColumn("row", F.monotonically_increasing_id()))
        rare = out.select("row", F.explode("rest").alias("token")).join(counts.withColumnRenamed("n", "c"), "token").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("add"))
        out = out.join(rare, "row", "left").withColumn("n_known", F.col("n_known") + F.coalesce("more", F.lit(0))).withColumn("value", F.col("value") + F.coalesce("add", F.lit(0.0)))
    return out.select(F.col("id").alias(id), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("value") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), "score")
