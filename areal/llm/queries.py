"""Queries over whole tables, one for each operator, with the columns that their contracts fix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areal.llm import ann, mixing, ngram_join, quality, secrets, sentencepiece, sharding, token_counts, toxicity, url_filter
from areal.llm.common import read

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
TOXIC_FROM = 0.3
TOKEN_LIMIT = 2048
COPIES = ngram_join.Rule(words=3, percent=90)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(read(spark, sf_dir, "documents"), COPIES)


def op4_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = sharding.shard_keys(docs, shards=24)
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.model_for(spark, sf_dir))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "domain", "language", "source_name", "n_tokens", "copies")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_documents(read(spark, sf_dir, "documents"), vocabulary_path(PIECE_BPE))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count_tokens(read(spark, sf_dir, "documents"), vocabulary_path(WORD_BPE))
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_rules, op2_url_filters, op3_ngram_jaccard_join, op4_histogram_sharding, op5_toxicity, op6_mixing, op7_nearest_neighbours, op8_secret_scan, op9_sentencepiece, op10_token_counts]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the operator on the given tables (whose pages hold no redirects or canonical links)."""
    return {"op1_quality_rules": quality.SQL, "op2_url_filters": url_filter.SQL, "op3_ngram_jaccard_join": ngram_join.sql(COPIES), "op6_mixing": mixing.SQL}
