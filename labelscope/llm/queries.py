"""The registered queries of this folder, and the SQL they must equal where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm import (
    byte_bpe, conversation_repair, embedding_dedup, fill_in_middle, licenses, line_quality, minhash, oracles, packing,
    pii, secret_scan, top_k, toxicity, weak_quality,
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {
    "op1_minhash_dedup": oracles.OP1,
    "op5_line_quality": oracles.OP5,
    "op6_embedding_dedup": oracles.OP6,
    "op11_conversation_repair": oracles.OP11,
    "op12_top_k": oracles.OP12,
    "op13_fill_in_middle": oracles.OP13,
}


def query(plan):
    QUERIES[plan.__name__] = plan
    return plan


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(_table(spark, sf_dir, "documents"), path).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")

    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex", "pair")]
    return found.select(
        "doc_id", *counts[:3], F.sha2(listed(of("assign", "access", "hex")), 256).alias("base_sha256"),
        listed("spans").alias("spans"), counts[3])


@query
def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_quality.line_quality(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_removed_lines", F.sha2("clean_text", 256).alias("clean_sha256"))


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), least=0.9)


@query
def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.weak_quality(_table(spark, sf_dir, "documents"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode_and_decode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


#: The query's key; users pass their own.
PSEUDONYM_KEY = b"registered query"


@query
def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonyms(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", F.size("spans").cast("bigint").alias("n_found"), *counts, "text")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(_table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(rows, texts=False).withColumnRenamed("key", "conv_id")


@query
def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors.filter("vec_id % 100 = 0"), vectors, k=10)


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(_table(spark, sf_dir, "documents"))
