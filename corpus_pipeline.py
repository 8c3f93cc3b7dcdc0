"""The corpus pipeline: reject toxic documents, keep one of each near-duplicate group, mask secrets, pack into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes to the shared folder and reads again for the next.
All but the last keep the columns of `documents`. Documents without an id pass the first three stages as they are judged by their text;
as near duplicates they are never dropped. Rows that share an id but not the text are documents of their own to the near-duplicate stage;
only a repeated row (id and text) goes. An empty table runs through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import neardup, packing, secret_scan, toxicity
from tidemark.llm.common import written
from tidemark.llm.queries import TOXIC
from tidemark.shipping import ship

SIMILAR = 80  # per cent of shared word shingles from which documents are near duplicates


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under TOXIC, by a model fitted on the labelled ones among them. Null and empty texts are scored as empty."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit_sample(docs, labels)
    scored = toxicity.score_documents(docs, model, name="_toxicity")
    return scored.filter(F.col("_toxicity") < TOXIC).select(docs.columns)


def one_of_each_group_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group.

    Rows of one id with other texts are documents of their own (after all ids); of repeated rows one stays. Rows without an id all stay.
    """
    ship(spark)
    known = docs.filter(F.col("doc_id").isNotNull()).withColumn("_hash", F.xxhash64("text"))
    first = known.groupBy("doc_id").agg(F.min("_hash").alias("_first"), F.max("_hash").alias("_last")).filter("_first <> _last")
    first = written(first.select("doc_id", "_first"), "first")
    other = F.col("_first").isNotNull() & (F.col("_hash") != F.col("_first"))
    far = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).bitwiseOR(F.lit(1 << 62))  # over all common ids, so that these are the first
    keyed = known.join(first, "doc_id", "left").withColumn("_key", F.when(other, far).otherwise(F.col("doc_id")))
    gone = neardup.near_duplicates(keyed, "_key", percent=SIMILAR).filter(~F.col("kept"))
    stay = keyed.join(written(gone.select(F.col("id").alias("_key")).distinct(), "gone"), "_key", "left_anti")
    repeated = written(keyed.groupBy("_key").count().filter("count > 1").select("_key"), "repeated")  # rows with one id and one text
    once = stay.join(repeated, "_key", "left_anti").unionByName(stay.join(repeated, "_key", "left_semi").dropDuplicates(["_key"]))
    return once.select(docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def secrets_are_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the spans of their secrets masked, and n_chars, if it is a column, counted anew where a text has changed."""
    found = secret_scan.find_secrets(docs)
    masked = found.withColumn("text", F.when(F.size("secrets") > 0, secret_scan.redacted(F.col("text"), F.col("secrets"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and places in sequences. Null texts are empty documents."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic_documents_go), ("near_duplicates", one_of_each_group_stays), ("secrets", secrets_are_masked), ("packing", sequences)]
ORACLE_SQL = None  # a trained model, components and merges are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
