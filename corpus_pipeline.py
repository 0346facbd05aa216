"""Cleaning of a corpus in stages; each works on all that the one before kept.

Toxic documents go, one document of each class of near duplicates stays, contaminated documents go, secrets
are replaced by marks, and the texts are encoded as pieces.  Rows of null or repeated doc_id are treated as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brimwell.llm import contamination, near_duplicates, pieces, registry, secret_scan, toxicity
from brimwell.llm.text import discarded, unused, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train_chain(registry.table(spark, sf_dir, "documents"), registry.table(spark, sf_dir, "labels"))
    (flag,) = unused(["is_toxic"], docs.columns)
    return toxicity.toxicity(docs, model).where(~F.col(flag)).select(*docs.columns)


def keep_one_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.decontaminated(docs, registry.table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secret_scan.redact_secrets(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(docs.select("doc_id", "text"), registry.PIECES).select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces")


STAGES = [("toxicity", drop_toxic), ("near duplicates", keep_one_of_class), ("decontamination", drop_contaminated), ("secrets", redact), ("pieces", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = registry.table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
            discarded(*[before] if before is not None else [])  # nothing reads a stage's table once the next one is written
            before = docs
    return docs
