"""The corpus pipeline: five training-data operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns all that it keeps; all but the last return the columns of documents.
``run`` writes every stage as Parquet to the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terragrid.llm import kneser_ney, mixing, packing, simhash, substrings
from terragrid.llm.common import Scratch, documents, fresh, ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted text's model is within their language's threshold."""
    ship(spark)
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    judged = kneser_ney.judge(docs, trusted, keep_text=True)
    return judged.where("lm_kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id (of several texts with that id the one with
    the least hash; of equal rows one). Texts with one id in different groups all stay, as do rows without an id."""
    ship(spark)
    groups = simhash.near_groups(docs, shingle=5, similarity=0.8).where("root is not null and doc_id is not null")
    one = groups.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    id_, hash_, mine_ = fresh(docs, "one_id", "one_hash", "own_hash")
    one = one.select(F.col("one.doc_id").alias(id_), F.col("one.text_hash").alias(hash_))
    own = docs.withColumn(mine_, F.xxhash64(F.col("text").cast("string")))
    kept = own.join(one, (own.doc_id == one[id_]) & own[mine_].eqNullSafe(one[hash_]), "left_semi")
    return kept.dropDuplicates(["doc_id", mine_]).select(docs.columns).unionByName(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated 35-word windows; n_chars follows the text."""
    ship(spark)
    out = substrings.remove(docs, window=35, keep_text=True)
    chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents toward tempered source weights, in a global random order."""
    return mixing.replicate(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens that hold the sources in their proportions, with their ids."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=4096, with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix", mix), ("pack", pack)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
