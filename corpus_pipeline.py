"""A corpus of training text from raw documents: STAGES in order, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame. All but the last return the columns of documents; the
last returns the mix. Between stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seshat.llm._io import settle, spare, table
from seshat.llm.decontaminate import without_contaminated
from seshat.llm.minhash_dedup import deduplicated
from seshat.llm.mixing import mixture, sizes
from seshat.llm.secret_forest import redacted
from seshat.llm.toxicity import fit, scored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. Every row is kept or dropped by its own text; null and empty ones are scored too."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    key = spare("seshat_key", docs.columns)
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    bad = settle(scored(texts, model).where("score >= 0.5").select(F.col("id").alias(key)).distinct())
    return docs.withColumn(key, F.xxhash64("text")).join(bad, key, "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id (see deduplicated)."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, by their own text; null and empty texts hold none and stay."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay; secrets in their texts are masked and n_chars follows the text (null for a null one)."""
    clean = redacted(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document and its draws.

    Null sources come last; null and empty texts have size 0 and are not drawn; repeated ids are rows of their own.
    """
    return mixture(sizes(docs.select("doc_id", "source", "text"))).select("doc_id", "size", "source_size", "target", "taken", "draws")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]
#: A forest, boosted trees and hash draws have no SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
