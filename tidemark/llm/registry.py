"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_bpe import digests

    return digests(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import join

    return join(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import token_store

    return token_store(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(_table(spark, sf_dir, "documents"))


def op7_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .site_style import extract

    return extract(_table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_ngram_join, op3_decontaminate, op4_token_store, op5_licenses, op6_pii, op7_site_style, op8_toxicity, op9_embedding_dedup, op10_cross_entropy)}


def oracle_sql() -> dict[str, str]:
    from . import decontaminate

    return {"op3_decontaminate": decontaminate.SQL}
