"""The queries op1 to op10: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import byte_bpe, cube_mixing, embedding_dedup, histogram_shards, language_id, oracles, order_minhash, parity_join, pii, token_files, url_filter
from pixelmill.llm.common import read_table

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links_of_vectors(read_table(spark, sf_dir, "embeddings")).drop("class_size")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(read_table(spark, sf_dir, "documents"))


def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.links_of_documents(read_table(spark, sf_dir, "documents")).drop("class_id", "text_hash", "component_key")


def op6_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mixing.taken_words(read_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform("base_spans", lambda s: s["kind"])
    n = [F.size(F.filter(kinds, lambda s: s == F.lit(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]  # noqa: B023
    return found.select("doc_id", *n, F.sha2(line("base_spans").cast("binary"), 256).alias("base_sha256"), line("spans").alias("spans"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read_table(spark, sf_dir, "documents"), tokenizer=BPE_JSON)


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards.shard_by_bytes(read_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return byte_bpe.encode(docs, ranks=BPE_RANKS, pattern=public_tokenizers.PATTERN, keep=["doc_id"], with_ids=False).drop("ids")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_embedding_dedup, op2_url_filter, op3_language_id, op4_order_minhash, op5_parity_join, op6_cube_mixing, op7_pii, op8_token_files,
        op9_histogram_shards, op10_byte_bpe,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": oracles.VECTORS, "op5_parity_join": oracles.DOCUMENTS}
