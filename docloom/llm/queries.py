"""The registered queries of the training-data operators, and the SQL that tells the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ans, balltree, bpe, hnsw, licenses, merkle, mixing, ngrams, periods, quality, sharding, suffixes, warc
from .common import table

#: Where the vocabulary files of public tokenizers lie; None: where the installed package has them.
TOKENIZERS: str | None = None


def vocabulary_path(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.integer_top_k(table(spark, sf_dir, "embeddings"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ans.round_trip(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.classes(table(spark, sf_dir, "documents"), n=3, similarity=(90, 100))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_topk, op3_sharding, op4_licenses, op5_token_files, op6_bpe, op7_embedding_dedup, op8_mixing, op9_suffix_dedup, op10_ngram_join, op11_warc, op12_runs, op13_merkle)
}

ORACLE_SQL: dict[str, str] = {"op2_topk": balltree.ORACLE, "op8_mixing": mixing.ORACLE, "op11_warc": warc.ORACLE, "op13_merkle": merkle.ORACLE}
