"""A pipeline of five operators over ``documents``: each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, ngram_join, pii, sentencepiece_bpe, toxicity
from tidemark.llm.common import BATCH, BATCH_BYTES, settle
from tidemark.llm.registry import tokenizer_path
from tidemark.session import ship


def ready(spark: SparkSession) -> SparkSession:
    """The session with the package shipped and, unless it sets them itself, Arrow batches of BATCH_BYTES: rows are whole texts here, and
    what a stage's batches took outside the heap stays with the executor through the later ones."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    return ship(spark)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.keep_clean(docs, ready(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: Jaccard 0.8 of five-word shingles."""
    ready(spark)
    return ngram_join.keep_one(docs, words=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.keep_clean(docs, ready(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; n_chars follows the text."""
    ready(spark)
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the text decoded from them."""
    ready(spark)
    return sentencepiece_bpe.digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("toxicity", without_toxic), ("ngram_join", without_copies), ("decontamination", without_benchmark), ("pii", without_personal_data), ("sentencepiece", token_ids)]

#: No SQL expresses the network's scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
