"""From documents to a training corpus: score, deduplicate, decontaminate, redact, mix.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps; all but
the last give the columns of ``documents``. ``run`` writes what a stage gives as
Parquet to the shared folder and hands it, read again, to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from capital_access.llm.common import table
from capital_access.llm.decontaminate import drop_contaminated
from capital_access.llm.quality_ranker import keep_preferred
from capital_access.llm.secret_scan import redact_secrets
from capital_access.llm.simhash_dedup import drop_near_copies
from capital_access.llm.source_mixing import mix_sources
from capital_access.session import settle


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents below the score quantile; learns from the labels of the documents it is given."""
    return keep_preferred(docs, table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near copies."""
    return drop_near_copies(docs, shingle=3, max_bits=2)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a twentieth or more of their words in benchmark passages."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; puts a mark in the place of each secret and sets ``n_chars`` anew."""
    return redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by the weights of their sources, in random order; adds ``copy`` and ``shuffle_key``."""
    return mix_sources(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_copies_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("secret_scans", secrets_stage),
    ("source_mixing", mixing_stage),
]

#: SQL cannot learn scores, hash with XXH64 or slide windows of entropy; the tests hold a brute-force version against ``run``.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
