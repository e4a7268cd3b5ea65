"""Structured Streaming: windows with watermarks, deduplication, and ingestion states.

Files stand in for a broker; ``source`` takes any format, so the same operators run on one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", max_files: int = 8) -> DataFrame:
    """A stream of files; ts is read as a timestamp so that watermarks can use it."""
    df = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their sum of values by window and type."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("session_start"), "events")


def once(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Redelivered events dropped by id while the watermark holds their state."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", timeout: int | None = None) -> None:
    """Processes what is there and stops. Complete and update results replace the target, appended ones are added by batch. Waits for all of it; with a timeout in seconds, stops the query and raises when that is not enough."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(target if mode == "complete" else f"{target}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream did not end in {timeout} s; {target} is not complete")


def in_turns(parts: list[DataFrame], operator: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """The parts of a table delivered one after the other as files of a stream, which stops after each and goes on from its checkpoint with the next. What the operator appends."""
    spark = parts[0].sparkSession
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
        run_available(operator(stream), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")


# The states of a document in order.
STATES = ["PENDING", "PARSING", "PARSED", "CHUNKING", "CHUNKED", "INDEXING", "COMPLETED", "FAILED"]


def document_states(changes: DataFrame) -> DataFrame:
    """changes: (doc_id, seq, status[, chunks]). The last state of each document; completed without chunks is FAILED."""
    last = changes.groupBy("doc_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"), F.max("chunks").alias("chunks"))
    return last.withColumn("status", F.when((F.col("status") == "COMPLETED") & (F.coalesce("chunks", F.lit(0)) == 0), "FAILED").otherwise(F.col("status")))
