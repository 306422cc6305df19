"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns of its input. Rows with nulls, repeated rows and empty tables pass through
as each operator defines it; extra columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriloom.functions.storage import fresh_path
from seriloom.llm import bpe, catalog, minhash, mixing, quality, secrets

#: Mixing repeats small sources up to this number of times, and serves every document.
REPETITION = 1.25


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (5): documents that the base rules or the perplexity band reject go."""
    return quality.accepted(spark, docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (3): one document of each group stays. Of rows with equal doc_id and text, or with equal text
    and no doc_id, one stays; a doc_id with several texts keeps each of them."""
    kept = minhash.near_duplicates(spark, docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).union(docs.filter("doc_id IS NULL").dropDuplicates(["text"]))


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans (7): every secret is replaced by a mark; n_chars follows the text."""
    clean = secrets.redact(docs)
    changed = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), changed).otherwise(F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (10): small sources repeat towards flatter weights; every document is served at least once."""
    return mixing.mixed_rows(docs, entropy=None, repetition=REPETITION, budget="cover")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE (1): number and digests of the ids of every document that is left."""
    return bpe.digests(bpe.encode(docs, catalog.vocabulary(), catalog.pattern()), catalog.vocabulary())


STAGES = [("quality", rules), ("near_dedup", dedup), ("secrets", secret_free), ("mixing", mix), ("tokens", tokens)]

#: The language-model and similarity stages cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
