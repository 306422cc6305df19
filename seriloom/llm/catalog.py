"""The named queries of the subpackage over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriloom.functions.storage import fresh_path
from seriloom.llm import bpe, filter_audit, fingerprints, language, lexical, minhash, mixing, mtree, quality, secrets, token_counts, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query("op1_byte_bpe")
def op1(spark, sf_dir):
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), pattern())
    return bpe.digests(encoded, vocabulary())


@query("op2_token_counts")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, vocabulary(), pattern(), "start")
    whole = F.transform("section_tokens", lambda x: x.cast("long"))
    return counted.select(
        "doc_id",
        "n_tokens",
        F.size("section_tokens").cast("long").alias("n_sections"),
        "n_crossing",
        F.coalesce(F.array_max(whole), F.lit(0)).cast("long").alias("largest_section"),
        F.array_join(whole.cast("array<string>"), ",").alias("section_tokens"),
    )


@query("op3_minhash")
def op3(spark, sf_dir):
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4(spark, sf_dir):
    return toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_quality")
def op5(spark, sf_dir):
    return quality.judge(spark, table(spark, sf_dir, "documents"))


@query("op6_mtree_search")
def op6(spark, sf_dir):
    vectors = mtree.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = mtree.top_k(vectors, vectors.filter(F.col("id") % 20 == 0), 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op7_secrets")
def op7(spark, sf_dir):
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


@query("op8_language")
def op8(spark, sf_dir):
    return language.predict(spark, table(spark, sf_dir, "documents"))


@query("op9_warc", warc.SQL)
def op9(spark, sf_dir):
    path = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.pages_of(warc.captures(warc.read_archives(spark, path, with_payload=False)))


@query("op10_mixing", mixing.sql())
def op10(spark, sf_dir):
    return mixing.schedule(table(spark, sf_dir, "documents"))


@query("op11_fingerprints", fingerprints.sql())
def op11(spark, sf_dir):
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


@query("op12_lexical_search", lexical.SQL)
def op12(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_filter_audit", filter_audit.sql())
def op13(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
