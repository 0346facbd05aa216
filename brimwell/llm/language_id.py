"""Language identification: a byte context tree for each language, the shortest code wins.

Defined results: a text that is null or has no letter is `und` with score 0; ties go to the first language
by name; rows without a language teach nothing; with nothing learned all are `und`.  Equal rows give equal
rows; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from .ppm import finished, lengths_array, train
from .text import blocks, text_bytes, unused

ORDER = 3
SHARPNESS = 10  # bytes whose mean code length weighs the languages in the score: long texts don't all get 1


def held_out(id: str, modulus: int, rest: int = 2):
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % modulus == rest


def identify_languages(docs: DataFrame, training: DataFrame, *, keep: list[str], text: str = "text", lang: str = "lang", order: int = ORDER) -> DataFrame:
    """Columns `keep` of docs with lang_pred and score, the winner's share of the posterior of SHARPNESS bytes of the text's mean code length."""
    tables, grams = train(training.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("name"), text_bytes(text).alias("text")), order)
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    body, letters_, size = unused(["text bytes", "letters", "text size"], [*keep, "lengths", "grams"])
    own = docs.select(*keep, text_bytes(text).alias(body), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(letters_))
    kept = own.select(*keep, letters_).schema
    known = tables.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, body):
                s, others = shared.value.parts(data, offsets)
                s = s.reshape(len(known), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept.names] + [pa.array(np.diff(offsets)), lengths_array(s), others], names=[*kept.names, size, "lengths", "grams"])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            letters = part.column(letters_).to_numpy(zero_copy_only=False)
            if known and part.num_rows:
                s = part.column("lengths").flatten().to_numpy().reshape(part.num_rows, len(known)).T
                best = np.argmax(s, axis=0)
                rate = s / (part.column(size).to_numpy() + 1) * SHARPNESS
                share = 1 / (10 ** (rate - rate.max(axis=0))).sum(axis=0)
                names = np.where(letters, np.array(known, object)[best], "und")
            else:
                share, names = np.zeros(part.num_rows), np.full(part.num_rows, "und", object)
            yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [pa.array(names, pa.string()), pa.array(np.where(letters & bool(known), share, 0.0))], names=[*keep, "lang_pred", "score"])

    scored = own.mapInArrow(score, StructType(list(kept)).add(size, "long").add("lengths", ArrayType(DoubleType())).add("grams", ArrayType(LongType())))
    schema = own.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return finished(scored, tables, grams).mapInArrow(predict, schema)


def language_digest(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4))
    return identify_languages(docs, docs.where(~F.col("held_out")), keep=["doc_id", "held_out"])
