"""Documents to training tokens: toxicity, near copies, repeated passages, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; each result is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark import runtime
from loomspark.llm import bpe, mixing, ngram_join, substring_dedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can't express the toxicity model; the stages are tested against brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go; null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    weights = toxicity.train(docs, labels)
    return toxicity.score(docs, weights).where("score < 0.5").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard similarity of 0.8 on 5-word shingles stays: the smallest id.

    Documents without a word stay. A null id counts as larger than any other;
    rows that share an id stay or go together, null ids with one text too.
    """
    numbered = docs.withColumn("__id", F.coalesce(F.col("doc_id"), ngram_join.stand_in(F.xxhash64("text"))))
    groups = ngram_join.similar_documents(numbered, doc_id="__id", k=5, part=80, whole=100)
    keep = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    return numbered.join(keep, "__id", "left_semi").select(COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a 13-word window of a smaller document are removed; every document stays."""
    left = substring_dedup.remove_repeated_passages(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    return left.withColumn("text", text).withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are evened out by repeating small ones at most twice; every document stays."""
    return mixing.mix(docs, max_epochs=2.0, keep_all=True).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix."""
    return bpe.encode(docs.select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = runtime.stored(stage(spark, docs, sf_dir))
        if before is not None:
            runtime.discard(before)
        before = docs
    return docs
