"""Documents through the stages of an ingestion batch, and the cache of action results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..sources.files import chunk_ids
from .chunking import chunk


def staged(events: DataFrame, docs: DataFrame, chunks: DataFrame | None = None, strategy: str = "fixed") -> tuple[DataFrame, DataFrame]:
    """Uploads (event_id, doc_id) parsed, chunked and indexed: (documents with status, chunks with stable ids).

    docs: (doc_id, text, deleted). An event counts once; events without a document, or of a deleted one, are skipped
    and give no row. A blank text fails at parsing, a text without chunks at chunking; FAILED is terminal. chunks:
    (doc_id, chunk_index, content), where they are made elsewhere.
    """
    asked = events.dropDuplicates(["event_id"]).select("doc_id").distinct()
    found = docs.join(asked, "doc_id", "left_semi").filter(~F.coalesce("deleted", F.lit(False)))
    parsed = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    ready = found.filter(parsed).select("doc_id", "text")
    made = chunk(ready, strategy) if chunks is None else chunks.join(ready, "doc_id", "left_semi")
    indexed = chunk_ids(made.filter(F.col("content").rlike(r"\S")).select("doc_id", "chunk_index", "content"), strategy)
    counts = indexed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    n = F.coalesce("chunks", F.lit(0))
    status = F.when(~F.col("parsed"), "FAILED").when(n == 0, "FAILED").otherwise("COMPLETED")
    reached = F.when(~F.col("parsed"), "parse").when(n == 0, "chunk").otherwise("index")
    state = found.select("doc_id", parsed.alias("parsed")).join(counts, "doc_id", "left")
    return state.select("doc_id", status.alias("status"), reached.alias("stage"), n.cast("long").alias("chunks")), indexed


def cached(actions: DataFrame, entries: DataFrame, ttl_ms: int = 3_600_000, direct: float = 0.95, capacity: int = 500) -> DataFrame:
    """actions: (action_id, key, at_ms, vector); entries: (entry_id, key, made_ms, vector). (action_id, entry_id, kind): what the cache answers at the time of each action.

    An action sees the newest ``capacity`` entries made by then, less what is older than ttl_ms. One of the same key
    answers (exact), the newest first, else the most similar one over ``direct`` (similar); ties go to the smaller
    entry_id. Actions without an answer, and those and entries without a time, give no row.

    Entries are numbered in order of time; an action sees a stretch of numbers, at most ``capacity`` of them, which
    lies in two neighbouring blocks of that many. So actions and entries meet by block: an action is sent to two
    blocks with its vector, never to all entries, and a block holds ``capacity`` entries.
    """
    order = ("made_ms", F.desc("entry_id"))
    ends = entries.filter("made_ms is not null").groupBy("made_ms").agg(F.count(F.lit(1)).alias("n"))
    upto = _running(ends, "made_ms", "n")
    within = F.row_number().over(W.partitionBy("made_ms").orderBy(order[1]))
    numbered = entries.select("entry_id", F.col("key").alias("entry_key"), "made_ms", F.col("vector").alias("entry_vector")).withColumn("within", within)
    placed = numbered.join(upto, "made_ms").withColumn("place", F.col("upto") - F.col("n") + F.col("within") - 1).drop("upto", "n", "within")
    stored = placed.withColumn("block", F.floor(F.col("place") / capacity))
    asked = _as_of(actions.filter("at_ms is not null").select("action_id", "key", "at_ms", "vector"), upto)
    last = F.col("seen") - 1
    blocks = F.array_distinct(F.array(F.floor(last / capacity), F.greatest(F.floor(last / capacity) - 1, F.lit(0))))
    met = asked.filter("seen > 0").withColumn("block", F.explode(blocks)).join(stored, "block")
    fresh = (F.col("place") < F.col("seen")) & (F.col("place") >= F.col("seen") - capacity) & (F.col("at_ms") - F.col("made_ms") <= ttl_ms)
    exact = F.col("key") == F.col("entry_key")
    alike = F.round(cosine(F.col("vector"), F.col("entry_vector")), 9)
    scored = met.filter(fresh).select("action_id", "entry_id", "made_ms", F.coalesce(exact, F.lit(False)).alias("exact"), alike.alias("alike")).filter(F.col("exact") | (F.col("alike") > direct))
    first = F.struct(~F.col("exact"), F.when(F.col("exact"), -F.col("made_ms").cast("double")).otherwise(-F.col("alike")), F.col("entry_id"))
    best = scored.groupBy("action_id").agg(F.min_by(F.struct("entry_id", "exact"), first).alias("b"))
    return best.select("action_id", "b.entry_id", F.when(F.col("b.exact"), "exact").otherwise("similar").alias("kind"))


#: Times whose rows are counted together, in milliseconds, so that a running count goes over blocks of time.
_SPAN_MS = 3_600_000


def _running(counts: DataFrame, at: str, n: str) -> DataFrame:
    """Adds upto: the sum of n up to and with each time. Sums of spans first, so that the one ordered window is over spans alone."""
    span = F.floor(F.col(at) / _SPAN_MS)
    spans = counts.groupBy(span.alias("span")).agg(F.sum(n).alias("s"))
    before = spans.select("span", (F.sum("s").over(W.orderBy("span")) - F.col("s")).alias("before"))
    inside = F.sum(n).over(W.partitionBy("span").orderBy(at))
    return counts.withColumn("span", span).withColumn("inside", inside).join(before, "span").select(at, n, (F.col("before") + F.col("inside")).alias("upto"))


def _as_of(actions: DataFrame, upto: DataFrame) -> DataFrame:
    """Adds seen: the entries made by the time of each action. Times of both kinds are put in order within spans; what a span begins with comes from the spans before."""
    times = actions.select(F.col("at_ms").alias("t")).distinct().join(upto.select(F.col("made_ms").alias("t"), "upto"), "t", "full").withColumn("span", F.floor(F.col("t") / _SPAN_MS))
    carried = times.groupBy("span").agg(F.max("upto").alias("most"))
    begun = carried.select("span", F.coalesce(F.max("most").over(W.orderBy("span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begun"))
    inside = F.max("upto").over(W.partitionBy("span").orderBy("t"))
    seen = times.withColumn("inside", inside).join(begun, "span").select(F.col("t").alias("at_ms"), F.greatest(F.coalesce("inside", F.lit(0)), F.col("begun")).alias("seen"))
    return actions.join(seen, "at_ms")
