"""A training corpus from `documents`: toxic ones go, one of each group of near copies stays, secrets are masked, sources are mixed
to target weights, and what is left is encoded.

Every stage takes rows with nulls in any column, repeated rows, empty and very long texts, empty tables and further columns, which it
leaves out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areal.llm import mixing, ngram_join, queries, secrets, sentencepiece, toxicity
from areal.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its text scores as high.
REJECT_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below REJECT_FROM stay; the model is fitted on the folder's labels. A null text scores as an empty one, and
    repeated rows share their fate. Rows at the threshold go."""
    return toxicity.keep_ordinary(docs.select(*COLUMNS), toxicity.model_for(spark, sf_dir), REJECT_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share five-word shingles at a similarity of 0.8 or more; the smallest id of each group stays.

    Rows without words, or without an id, stay all; of rows with one id that stays, one of each text stays.
    """
    groups = ngram_join.link(docs, ngram_join.Rule(words=5, percent=80))
    stays = groups.where("n_shingles > 0 and doc_id is not null and doc_id = component_id").select("doc_id").distinct()
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = docs.where(words).join(stays, "doc_id", "left_semi").select(*COLUMNS)
    first = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source", "lang", "n_chars")
    once = kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*COLUMNS)
    return once.unionByName(docs.where(~words | F.col("doc_id").isNull()).select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; n_chars is that of the masked text. Null texts stay null and keep their n_chars."""
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy in the mix, by words. Null languages and sources are children of their own; texts without words come along with their
    neighbours in the seeded order; of rows equal in id and text, as many as fit are taken."""
    mixed = mixing.mix(docs, mixing.Plan(budget_permille=1000)).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces and round_trip of every row. Null and empty texts have no ids."""
    return sentencepiece.encode_documents(docs, queries.vocabulary_path(queries.PIECE_BPE))


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("sentencepiece", encode)]

#: No SQL expresses the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return reduce(lambda rows, stage: written(stage[1](spark, rows, sf_dir), "stage"), STAGES, docs)
