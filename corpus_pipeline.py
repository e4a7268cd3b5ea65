"""Documents to token ids: quality, near copies, repeated passages, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result and reads it again
as the next stage's docs. All but the last return the columns of documents:

1. quality classifier: documents that it rejects go;
2. n-gram Jaccard join (five words, similarity 0.8): of each group of near copies the smallest doc_id stays;
3. suffix-array dedup: strings of 50 bytes that an earlier document holds are cut from the text;
4. mixing: sources come to their target weights, so a document may come up to three times or not at all;
5. BPE: token ids of what is left, checked by decoding.

A document whose text is cut away wholly stays, with an empty text. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, mixing, ngrams, quality, suffixes
from docloom.llm.common import table, written
from docloom.llm.queries import vocabulary_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_rows(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngrams.representatives(docs, 5, (8, 10))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.trimmed_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_distinct),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: A fitted classifier and merges by rank are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
