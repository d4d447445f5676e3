"""From raw documents to a weighted training mix: five stages, each over all rows that the one
before kept. run() writes every stage as Parquet in the shared folder and reads it again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphereweave.llm.common import cut, held_out, table
from sphereweave.llm.decontaminate import decontaminate
from sphereweave.llm.langid import fit, identify
from sphereweave.llm.minhash import dedup
from sphereweave.llm.mixing import mix
from sphereweave.llm.pii import sanitise

#: A document whose language is `und` or less likely than this goes.
LEAST_LANGUAGE_SCORE = 0.5
#: Texts that a Python worker is handed at once: a stage's memory beside the heap grows with them.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = identify(docs, fit(docs.where(~held_out(F.col("doc_id"), 5))))
    return found.where((F.col("__l_pred") != "und") & (F.col("__l_score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), action="documents")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sanitise(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mix(docs)
    return out.withColumnsRenamed({"__m_domain": "mix_domain", "__m_epoch": "mix_epoch", "__m_tokens": "mix_tokens"})


STAGES = [("language_id", language_id), ("minhash_dedup", minhash_dedup), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]

#: Language models and locality-sensitive hashing have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
