"""Corpus pipeline: quality rules, language identification, near-duplicates, secrets, packing.

Each stage takes what its predecessor kept, whole, and all but the last return the columns of documents. Null and empty
texts are rejected by the quality rules (no words); a stage that gets none returns an empty table of its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import language, neardup, packing, quality, secrets
from plumbline.llm.common import read_table, written

#: No SQL: the n-gram model, the network, the sketches and the packing are beyond it; tests hold the rows against
#: brute-force versions.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or the n-gram verdict go."""
    found, s = quality.quality_rules(docs, quality.trusted_ids(spark, sf_dir))
    return found.where(f"{s}.kept").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language, or of none that stands out, go."""
    found, s = language.language_id(docs, ~language.held_out())
    return found.where((F.col(f"{s}.lang_pred") != language.UNDETERMINED) & (F.col(f"{s}.score") >= language.MIN_SCORE)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest id stays."""
    return neardup.keep_one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into training sequences."""
    return packing.best_fit_packing(docs, packing.vocabulary())


STAGES = [
    ("quality rules", quality_stage),
    ("language id", language_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
