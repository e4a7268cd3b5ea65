"""Readers and writers: chunks as JSON, golden sets, raw files as text, idempotent upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "chunk_id string, document_id string, content string, token_count int, chunk_index int, metadata map<string,string>"


def tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The named Parquet tables of a folder, registered as views."""
    out = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    for n, df in out.items():
        df.createOrReplaceTempView(n)
    return out


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Any files as (path, text): bytes read as UTF-8, what is not valid replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "length", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_chunks(spark: SparkSession, path: str, kb_id: str | None = None, lines: bool = False) -> DataFrame:
    """Chunk files (one JSON array a file, or lines as write_chunks makes them) without blank chunks; kb_id is put back."""
    df = spark.read.schema(CHUNK).option("multiLine", str(not lines).lower()).json(path).filter(F.col("content").rlike(r"\S"))
    return df.withColumn("kb_id", F.lit(kb_id)) if kb_id else df


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def read_golden(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A golden set of JSON lines."""
    return spark.read.schema(schema).json(path)


def chunk_ids(chunks: DataFrame, strategy: str) -> DataFrame:
    """Ids from document, strategy and place: a replay writes the same ids."""
    return chunks.withColumn("chunk_id", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(strategy), F.col("chunk_index").cast("string"))))


def upserted(old: DataFrame, new: DataFrame, key: str, most_chars: int = 60_000, content: str = "content") -> DataFrame:
    """Old rows that are not written anew, and the new ones with their content cut to what the store holds."""
    cut = new.withColumn(content, F.substring(content, 1, most_chars)) if content in new.columns else new
    return old.join(new.select(key), key, "left_anti").unionByName(cut, allowMissingColumns=True)


def deleted(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")
