"""Lines that stand in many documents, dropped everywhere but in one; built-in functions only.

A text is split at line feeds.  A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z
lower-cased.  Lines whose key is long enough are exploded as (row, place, MD5 of the key); a key's documents are counted in two
aggregations, by key and document, then by key, so that a frequent line shrinks to one row in each task before it moves.
Keys of enough documents are joined back to the places, frequent ones by salted keys; the dropped places
of a row, which are at most its lines, are joined to its text, and what is left is put together by place.  Texts move once.

Defined results: null and empty texts have one empty line; an empty table gives an empty one.  A document is a doc_id: rows
that share one count once and keep or lose a line together, rows of null doc_id are one document, the
smallest.  Keys are told apart by 128 bits of MD5.  All columns of the input stay; a result column whose name is taken, in
any letter case, gets `_` put behind its name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import discarded, unused, written

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHARS, DOCUMENTS = 40, 5
HOT_KEYS, HOT_ROWS = 10_000, 5_000  # a key is salted from HOT_ROWS lines on that are more than a HOT_KEYS-th of all: so at most HOT_KEYS keys are


def lowered(text: Column) -> Column:
    """A-Z in lower case; ASCII texts take the shorter way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def _lines(docs: DataFrame, id: str, text: str, least_chars: int) -> DataFrame:
    """(id, row, place, key): every line of a long enough key; `row` is the MD5 of the text."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.unhex(F.md5(_text(text))).alias("row"), F.posexplode(F.split(lowered(_text(text)), "\n")).alias("place", "line"))
    bare = rows.withColumn("line", F.btrim("line", F.lit(BLANK))).where(F.length("line") >= least_chars)
    return bare.select("id", "row", "place", F.unhex(F.md5("line")).alias("key"))


def _frequent(lines: DataFrame, least_docs: int) -> DataFrame:
    """(key, rows, keep): keys of enough documents, how many lines they have, and the document that keeps them."""
    by_document = lines.groupBy("key", "id").agg(F.count("*").alias("rows"))
    return by_document.groupBy("key").agg(F.count("*").alias("documents"), F.sum("rows").alias("rows"), F.max("id").alias("keep")).where(F.col("documents") >= least_docs).drop("documents")


def _dropped(lines: DataFrame, frequent: DataFrame, total: int) -> DataFrame:
    """(id, row, places): the places of each row that go; lines of hot keys are dealt by key and salt."""
    share = max(HOT_ROWS, math.ceil(total / HOT_KEYS))
    salts = F.ceil(F.col("rows") / share).cast("int")
    hot = frequent.where(F.col("rows") > share).select("key", salts.alias("salts"))  # at most HOT_KEYS rows
    salted = lines.join(F.broadcast(hot), "key", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "row", "place"), F.col("salts"))).cast("int")).drop("salts")
    dealt = frequent.select("key", "keep", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)).alias("salt"))
    gone = salted.join(dealt, ["key", "salt"]).where(~F.col("id").eqNullSafe(F.col("keep")))
    return gone.groupBy("id", "row").agg(F.collect_set("place").alias("places"))


def _without(lines: Column, places: Column) -> Column:
    """The lines but those at places, joined; the one-element array makes the split lines a value that is computed once."""
    left = lambda s: F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["places"])
    boxed = F.array(F.struct(lines.alias("lines"), places.alias("places")))
    picked = F.transform(boxed, lambda s: F.struct(s["lines"].alias("lines"), left(s).alias("left")))
    return F.transform(picked, lambda s: F.array_join(F.transform(s["left"], lambda i: F.get(s["lines"], i)), "\n"))[0]


def dedup_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least_chars: int = CHARS, least_docs: int = DOCUMENTS) -> DataFrame:
    """docs with `n_lines`, `n_dropped` and `kept_text`: keys of least_chars code points in least_docs documents stay in the largest id alone."""
    if least_chars < 1 or least_docs < 2:
        raise ValueError("keys have a character at least, and lines of one document stay")
    lines = written(_lines(docs, id, text, least_chars))
    frequent = written(_frequent(lines, least_docs))
    gone = written(_dropped(lines, frequent, lines.count()))
    discarded(lines, frequent)
    n_lines, n_dropped, kept, own, places, key, row = unused(["n_lines", "n_dropped", "kept_text", "text md5", "places", "id of places", "row of places"], docs.columns)
    gone = gone.select(F.col("id").alias(key), F.col("row").alias(row), F.col("places").alias(places))
    both = docs.withColumn(own, F.unhex(F.md5(_text(text)))).join(gone, F.col(f"`{id}`").eqNullSafe(F.col(f"`{key}`")) & (F.col(f"`{own}`") == F.col(f"`{row}`")), "left")
    split = F.split(_text(text), "\n")
    return both.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.size(split).cast("long").alias(n_lines), F.coalesce(F.size(f"`{places}`"), F.lit(0)).cast("long").alias(n_dropped),
        F.when(F.col(f"`{places}`").isNull(), _text(text)).otherwise(_without(split, F.col(f"`{places}`"))).alias(kept),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text,''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, r, unnest(a) AS line, unnest(range(len(a))) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, keep IS NOT NULL AND keep <> doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r
"""
