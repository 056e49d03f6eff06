"""Corpus pipeline: language ID, SimHash near-dedup, sanitisation, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridstats.llm import langid, mixing, packing, pii, simhash
from gridstats.llm.common import small_side
from gridstats.session import checkpoint_dir, cut_lineage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not established go."""
    found = langid.of_documents(docs)
    gone = found.where(~F.col("kept")).select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_key")) & F.xxhash64("text").cast("string").eqNullSafe(F.col("_hash"))
    return docs.join(small_side(gone), same, "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the text with the smallest id, then hash, stays, once; texts
    of one id are told apart. Rows without an id stay."""
    key, text_hash = F.col("doc_id"), F.xxhash64("text")
    kind = docs.schema["doc_id"].dataType
    # Components are those of texts: an id may stand for several.
    found = simhash.near_duplicates(docs.select(text_hash.alias("_hash"), "text", key.cast("string").alias("_key")), "_hash", "text", "_key")
    found = cut_lineage(found.where(F.col("_key").isNotNull()).select(F.col("_key").cast(kind).alias("_key"), F.col("key").alias("_hash"), "component"))
    who = F.struct("_key", "_hash")
    several = found.groupBy("component").agg(F.min(who).alias("least"), F.max(who).alias("most")).where("least < most").select(F.col("component").alias("of"), "least")
    gone = found.join(small_side(several), F.col("component") == F.col("of")).where(who != F.col("least")).select("_key", "_hash").distinct()
    same = (key == F.col("_key")) & (text_hash == F.col("_hash"))
    kept = docs.join(small_side(gone), same, "left_anti")
    # Repeated rows of a text that stands for its component.
    twice = small_side(found.groupBy("_key", "_hash").count().where("count > 1").select("_key", "_hash"))
    if not twice.take(1):
        return kept
    one = kept.join(twice, same, "left_semi").withColumn("_text_hash", text_hash).dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")
    return kept.join(twice, same, "left_anti").unionByName(one)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that give it away are replaced; all documents stay."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in token sequences."""
    return packing.packed_documents(docs)


STAGES = [("language_id", language), ("simhash_dedup", near_dedup), ("pii", sanitise), ("mixing", mix), ("packing", pack)]

#: Tokens, fingerprints and fitted models have no SQL; the tests check stages and whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each stage's result written to the shared folder first."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
