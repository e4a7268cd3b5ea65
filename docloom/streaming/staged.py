"""Stages that a batch of a stream passes one after the other, with a ledger: nothing is done twice, and a run that ends anywhere goes on where it ended.

Each stage writes a batch's rows to a folder of that batch, then the ledger tells that they are whole. A batch that
is delivered again, because the run was killed or the source repeats it, finds its ledger: stages told there are
read, what is not is written anew over whatever a killed attempt left. Readers see only batches of the ledger, and
of each document only those of its newest batch, so a document that is sent again replaces its rows at once.

Rows that a stage refuses are kept with the reason in its table and go no further; the others of the batch do.
A replay takes what a stage holds now and passes it through the later ones as a batch of its own.

Defined cases: a batch without rows is told in the ledger like others; rows without a key go by; a stage that raises
ends the run, and the batch is delivered again; two documents never meet, so one that fails holds up no other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.chunking import chunk
from ..sources.files import chunk_ids

#: Between the numbers of two batches of a stream, for replays after the first.
_STEP = 1 << 20


@dataclass(frozen=True)
class Stage:
    """run: rows of the stage before (first: of the batch) to this one's, with a column error, null where a row goes on."""

    name: str
    run: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Staged:
    spark: SparkSession
    folder: str
    stages: tuple[Stage, ...]
    key: str = "doc_id"

    def _place(self, stage: str, number: int) -> str:
        return f"{self.folder}/{stage}/batch={number}"

    def _told(self, stage: str, number: int) -> bool:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger/stage={stage}/batch={number}/_SUCCESS")
        return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)

    def deliver(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: passes a batch of the stream through all stages."""
        self._pass(batch, number * _STEP, self.stages)

    def _pass(self, rows: DataFrame, number: int, stages: tuple[Stage, ...]) -> None:
        for stage in stages:
            place = self._place(stage.name, number)
            if not self._told(stage.name, number):
                stage.run(rows).filter(F.col(self.key).isNotNull()).write.mode("overwrite").parquet(place)
                written = self.spark.read.parquet(place)
                counts = written.agg(F.count(F.lit(1)).alias("rows"), F.count("error").alias("failed"))
                counts.write.mode("overwrite").parquet(f"{self.folder}/ledger/stage={stage.name}/batch={number}")
            rows = self.spark.read.parquet(place).filter("error is null").drop("error")

    def replay(self, documents: DataFrame, number: int, after: str) -> None:
        """Passes what the stage holds now of the documents (a column of keys) through the later stages. number: from ``next_number``, the same one to go on with a replay that was killed."""
        names = [s.name for s in self.stages]
        later = self.stages[names.index(after) + 1 :]
        rows = self.current(after).filter("error is null").drop("error", "batch").join(documents.select(self.key).distinct(), self.key, "left_semi")
        self._pass(rows, number, later)

    def next_number(self) -> int:
        return self.ledger().agg(F.max("batch").alias("b")).first()["b"] + 1

    def ledger(self) -> DataFrame:
        """(stage, batch, rows, failed) of what is whole."""
        return self.spark.read.schema("rows long, failed long, stage string, batch long").parquet(f"{self.folder}/ledger")

    def table(self, stage: str) -> DataFrame:
        """All rows of a stage with their batch, those of batches that are whole."""
        whole = self.ledger().filter(F.col("stage") == stage).select("batch")
        return self.spark.read.parquet(f"{self.folder}/{stage}").withColumn("batch", F.col("batch").cast("long")).join(whole, "batch", "left_semi")

    def current(self, stage: str) -> DataFrame:
        """The rows of a stage from each document's newest batch there, or none where an earlier stage has refused it since."""
        at = [s.name for s in self.stages].index(stage)
        newest = None
        for s in self.stages[: at + 1]:
            seen = self.table(s.name).groupBy(self.key).agg(F.max("batch").alias("batch"))
            newest = seen if newest is None else newest.unionByName(seen)
        newest = newest.groupBy(self.key).agg(F.max("batch").alias("batch"))
        return self.table(stage).join(newest, [self.key, "batch"])

    def failed(self) -> DataFrame:
        """(key, batch, stage, error) of every refused row."""
        each = [self.table(s.name).filter("error is not null").select(self.key, "batch", F.lit(s.name).alias("stage"), "error") for s in self.stages]
        out = each[0]
        for e in each[1:]:
            out = out.unionByName(e)
        return out

    def status(self) -> DataFrame:
        """(key, batch, status, stage, rows): how far each document's newest batch has come, and the good rows of the last stage. One good row of the last stage makes it COMPLETED; a document that a stage refuses wholly FAILED there."""
        each = [self.table(s.name).groupBy(self.key, "batch").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("good")).withColumn("step", F.lit(i)) for i, s in enumerate(self.stages)]
        steps = each[0]
        for e in each[1:]:
            steps = steps.unionByName(e)
        newest = steps.withColumn("newest", F.max("batch").over(W.partitionBy(self.key))).filter("batch = newest")
        last = newest.groupBy(self.key, "batch").agg(F.max_by("good", "step").alias("good"), F.max("step").alias("step"))
        names = F.array(*[F.lit(s.name) for s in self.stages])
        end = len(self.stages) - 1
        state = F.when(F.col("good") == 0, "FAILED").when(F.col("step") == end, "COMPLETED").otherwise("RUNNING")
        done = F.when(F.col("step") == end, F.col("good")).otherwise(0)
        return last.select(self.key, "batch", state.alias("status"), names[F.col("step")].alias("stage"), done.cast("long").alias("rows"))


def run(stream: DataFrame, staged: Staged, checkpoint: str) -> None:
    """Passes what the stream holds, and stops; raises what a stage raised, to be called again."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(staged.deliver).start().awaitTermination()


def ingestion(docs: DataFrame, strategy: str = "fixed", refused: Column | None = None, most_chars: int = 60_000) -> tuple[Stage, ...]:
    """The stages of a batch of uploads (event_id, doc_id): parse, chunk and index. docs: (doc_id, text, deleted).

    An event counts once in a batch; events without a document, or of a deleted one, give no row. A blank text is
    refused at parsing, a text without chunks at chunking, a chunk that is blank, or that the store refuses (a
    column with the reason, over chunk_id and content), at indexing. The store holds ``most_chars`` of a content.
    """

    def parse(events: DataFrame) -> DataFrame:
        asked = events.dropDuplicates(["event_id"]).select("doc_id").distinct()
        found = docs.join(asked, "doc_id", "left_semi").filter(~F.coalesce("deleted", F.lit(False)))
        return found.select("doc_id", "text", F.when(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)), "blank").alias("error"))

    def cut(rows: DataFrame) -> DataFrame:
        made = chunk(rows.select("doc_id", "text"), strategy).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content", F.lit(None).cast("string").alias("error"))
        none = rows.select("doc_id").join(made.select("doc_id").distinct(), "doc_id", "left_anti")
        return made.unionByName(none.withColumn("error", F.lit("no chunks")), allowMissingColumns=True)

    def index(rows: DataFrame) -> DataFrame:
        held = chunk_ids(rows.select("doc_id", "chunk_index", F.substring("content", 1, most_chars).alias("content")), strategy)
        blank = F.when(~F.coalesce(F.col("content").rlike(r"\S"), F.lit(False)), "blank chunk")
        return held.select("chunk_id", "doc_id", "chunk_index", "content", (F.coalesce(blank, refused) if refused is not None else blank).alias("error"))

    return Stage("parse", parse), Stage("chunk", cut), Stage("index", index)
