"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import contamination, fixity, language_id, license_scan, line_dedup, lm_score, media, near_duplicates, periodic_runs, pieces, secret_scan, toxicity, whitening

TOKENIZERS = os.environ.get("BRIMWELL_TOKENIZERS", "/opt/tokenizers")
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark, sf_dir):
    return license_scan.license_digest(license_scan.scan_licenses(table(spark, sf_dir, "documents")))


def op2_secret_scan(spark, sf_dir):
    return secret_scan.secret_digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op3_decontamination(spark, sf_dir):
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lm_score(spark, sf_dir):
    return lm_score.score_texts(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_chain(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).drop("text")


def op6_jaccard_join(spark, sf_dir):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op7_merkle_fixity(spark, sf_dir):
    return fixity.merkle_digest(table(spark, sf_dir, "pages"))


def op8_language_id(spark, sf_dir):
    return language_id.language_digest(table(spark, sf_dir, "documents"))


def op9_media_columns(spark, sf_dir):
    return media.media_digest(table(spark, sf_dir, "documents"))


def op10_pieces(spark, sf_dir):
    return pieces.piece_digest(table(spark, sf_dir, "documents"), PIECES)


def op11_line_dedup(spark, sf_dir):
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.run_digest(table(spark, sf_dir, "documents"))


def op13_whitening(spark, sf_dir):
    return whitening.whitening_digest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_secret_scan, op3_decontamination, op4_lm_score, op5_toxicity, op6_jaccard_join, op7_merkle_fixity, op8_language_id, op9_media_columns, op10_pieces, op11_line_dedup, op12_periodic_runs, op13_whitening)}
ORACLE_SQL = {"op1_license_scan": license_scan.ORACLE, "op2_secret_scan": secret_scan.ORACLE, "op3_decontamination": contamination.ORACLE, "op7_merkle_fixity": fixity.ORACLE, "op11_line_dedup": line_dedup.ORACLE, "op12_periodic_runs": periodic_runs.ORACLE}
