"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, hamerly, html_text, kneser_ney, line_rules, mixing, packing, repair, sharding, simhash, substrings, toxicity, whitening
from .common import documents, ship

MIX_SEED, MIX_ALPHA, MIX_MOST = 20240, 0.5, 64.0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the lexicon is learned from labelled rows that aren't held out."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "density")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent weighted samples of every document and its edited text."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return fingerprints.compare(documents(spark, sf_dir), samples=32, buckets=4 * parts)


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of line-first cleaning for every document."""
    out = line_rules.clean_lines(documents(spark, sf_dir))
    return out.select("doc_id", *line_rules.COUNTS, "base_failed", "kept", "n_lines", "n_lines_removed", "kept_chars")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document by Poisson replication toward tempered source weights."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    mixed = mixing.replicate(docs, seed=MIX_SEED, alpha=MIX_ALPHA, most=MIX_MOST)
    return mixed.select("doc_id", "source", "copy", "mix_copies", F.round("mix_rate", 9).alias("mix_rate"), "mix_key", F.md5(F.col("text").cast("binary")).alias("text_md5"))


QUERIES = {"op1_toxicity": op1_toxicity, "op6_fingerprints": op6_fingerprints, "op8_line_rules": op8_line_rules, "op10_mixing": op10_mixing}

ORACLES = {
    "op10_mixing": mixing.sql("documents", MIX_SEED, MIX_ALPHA, MIX_MOST, "doc_id, source, copy, mix_copies, round(mix_rate, 9) mix_rate, mix_key, md5(text) text_md5"),
}


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles and the components of links at two bits or fewer."""
    return simhash.group(documents(spark, sf_dir), shingle=3, budget=2)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows that hold the sources in their corpus proportions."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=4096)


def op4_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back from Re-Pair shards of their ids."""
    return repair.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


QUERIES |= {"op2_simhash": op2_simhash, "op3_packing": op3_packing, "op4_repair": op4_repair}


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    ship(spark)
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of the documents labelled good, and whether it passes its language's threshold."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    judged = kneser_ney.judge(docs, trusted)
    return judged.select("doc_id", "lang", F.col("lm_chars").alias("n_chars"), "perplexity", F.col("lm_threshold").alias("threshold"), F.col("lm_kept").alias("kept"))


QUERIES |= {"op7_html_text": op7_html_text, "op9_kneser_ney": op9_kneser_ney}


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps once words in repeated windows of 35 are gone."""
    return substrings.remove(documents(spark, sf_dir).select("doc_id", "text"), window=35, keep_text=False)


QUERIES |= {"op5_substrings": op5_substrings}


def op11_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 clusters of the embeddings after five rounds under Hamerly's bounds."""
    ship(spark)
    return hamerly.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5, dims=64)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every embedding."""
    ship(spark)
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=8)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into 16 shards with counts at most one apart."""
    out = sharding.shard(documents(spark, sf_dir), shards=16)
    text = F.col("text").cast("binary")
    size, crc = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1, F.crc32(F.coalesce(text, F.lit(b"")))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES |= {"op11_hamerly": op11_hamerly, "op12_whitening": op12_whitening, "op13_sharding": op13_sharding}
ORACLES |= {"op11_hamerly": hamerly.sql("embeddings")}
