"""Registered queries of the operators with keyed state, over tables and as streams that are started again, and their SQL.

Streams get the rows of a table in three parts by time. Conversations have no time, so the turn makes one: each
pause is two hours longer than the one before, and long pauses let a window run out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import stateful, streams
from .queries import _MSG, _messages, _stream_dir, query, t

_LIMIT = {"limit": 3, "window_ms": 6 * 3_600_000}
_LIMIT_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS pos FROM events),
r AS (SELECT event_id, user_id, ms, pos, [ms] AS taken, true AS allowed FROM e WHERE pos = 1
  UNION ALL SELECT event_id, user_id, ms, pos, CASE WHEN len(live) < 3 THEN list_append(live, ms) ELSE live END, len(live) < 3
  FROM (SELECT e.*, list_filter(r.taken, lambda x: x > e.ms - 21600000) AS live FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.pos = r.pos + 1))
SELECT event_id, user_id, ms, allowed, CAST(3 - len(taken) AS INTEGER) AS remaining, CASE WHEN allowed THEN 0 ELSE 21600000 END::BIGINT AS retry_after_ms FROM r"""


def _requests(spark, d) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return t(spark, d, "events").select("event_id", "user_id", F.unix_millis(ts).alias("ms"), ts.alias("ts"))


def _thirds(rows: DataFrame, at: str) -> list[DataFrame]:
    """The rows up to a third of the time, up to two thirds, and the rest."""
    ends = rows.approxQuantile(at, [1 / 3, 2 / 3], 0.01) or [0, 0]
    return [rows.filter(F.col(at) <= ends[0]), rows.filter((F.col(at) > ends[0]) & (F.col(at) <= ends[1])), rows.filter(F.col(at) > ends[1])]


@query(_LIMIT_SQL)
def rate_limiter(spark, d):
    return stateful.limited(_requests(spark, d), **_LIMIT)


@query(_LIMIT_SQL)
def stream_rate_limiter(spark, d):
    return streams.in_turns(_thirds(_requests(spark, d), "ms"), lambda s: stateful.limited_stream(s, **_LIMIT), _stream_dir(spark))


_HOUR = 3_600_000


def _summary(old: str, messages: list[tuple[str, str]]) -> str | None:
    """Stands for a model: counts the messages, and fails now and then."""
    return None if sum(len(x) for _, x in messages) % 5 == 0 else f"{old}|{len(messages)}"


_RULES = stateful.Rules(_summary, most=3, tokens=400, ttl_ms=9 * _HOUR)
_MEMORY_SQL = rf"""WITH RECURSIVE {_MSG}, o AS (SELECT conv_id, id, tokens, n AS chars, (24 + conv_id % 10 + (id % 1000) * (id % 1000)) * {_HOUR} AS ms, row_number() OVER (PARTITION BY conv_id ORDER BY id) AS pos FROM mt),
f AS (SELECT conv_id, 0::BIGINT AS pos, -1::BIGINT AS id, 0::BIGINT AS touched, 0::BIGINT AS n, 0::BIGINT AS mark, 0::HUGEINT AS tok, 0::HUGEINT AS chr, '' AS summary, -1::BIGINT AS watermark,
    false AS gone, 0::BIGINT AS gone_n, -1::BIGINT AS gone_id, -1::BIGINT AS gone_mark, NULL::VARCHAR AS kind, 0::BIGINT AS said FROM (SELECT DISTINCT conv_id FROM o)
  UNION ALL SELECT conv_id, pos, id, ms, CASE WHEN ok THEN 0 ELSE n1 END, CASE WHEN ok THEN 1 ELSE mark1 END, CASE WHEN ok THEN 0 ELSE tok1 END, CASE WHEN ok THEN 0 ELSE chr1 END,
    CASE WHEN ok THEN summary || '|' || n1 ELSE summary END, CASE WHEN ok THEN id ELSE watermark END, lost, old_n, old_id, watermark, CASE WHEN ok THEN 'rolled' WHEN due THEN 'failed' END, n1
  FROM (SELECT *, due AND chr1 % 5 <> 0 AS ok FROM (SELECT *, n1 + mark1 >= 3 OR tok1 >= 400 AS due FROM (
    SELECT o.conv_id, o.pos, o.id, o.ms, f.summary, f.watermark, f.n AS old_n, f.id AS old_id, (o.ms - f.touched >= {9 * _HOUR} AND (f.n > 0 OR f.mark > 0)) AS lost,
      CASE WHEN lost THEN 0 ELSE f.n END + 1 AS n1, CASE WHEN lost THEN 0 ELSE f.mark END AS mark1, CASE WHEN lost THEN 0 ELSE f.tok END + o.tokens AS tok1, CASE WHEN lost THEN 0 ELSE f.chr END + o.chars AS chr1
    FROM f JOIN o ON o.conv_id = f.conv_id AND o.pos = f.pos + 1)))),
l AS (SELECT * FROM f WHERE (n > 0 OR mark > 0) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1 AND pos = (SELECT max(pos) FROM o WHERE o.conv_id = f.conv_id)),
u AS (SELECT conv_id, gone_id AS id, 'expired' AS kind, gone_mark AS watermark, gone_n AS messages, NULL AS summary FROM f WHERE gone
  UNION ALL SELECT conv_id, id, kind, watermark, said, CASE WHEN kind = 'rolled' THEN summary END FROM f WHERE kind IS NOT NULL
  UNION ALL SELECT conv_id, id, 'expired', watermark, n, NULL FROM l WHERE (SELECT max(ms) FROM o) - touched >= {9 * _HOUR})
SELECT conv_id, id, kind, watermark, messages, summary FROM u"""


def _timed(spark, d) -> DataFrame:
    turn = F.col("id") % 1000
    ms = ((24 + F.col("conv_id") % 10 + turn * turn) * _HOUR).alias("ms")
    return _messages(spark, d).select("conv_id", "id", "role", "text", ms).withColumn("ts", F.timestamp_millis("ms"))


@query(_MEMORY_SQL)
def memory_folded(spark, d):
    rows = _timed(spark, d)
    return stateful.remembered(rows, _RULES, rows.agg(F.max("ms").alias("m")).first()["m"])


@query(_MEMORY_SQL)
def stream_memory(spark, d):
    return streams.in_turns(_thirds(_timed(spark, d), "ms"), lambda s: stateful.remembered_stream(s, _RULES), _stream_dir(spark))


def _register_ingestion():
    from ..streaming import staged
    from .compositions import _STAGED, _staged_sql
    from .queries import _FIXED

    def ingested(spark, d) -> staged.Staged:
        """Uploads in three parts of a stream, one of them sent twice, and the last stage of some documents replayed."""
        folder = _stream_dir(spark)
        docs = t(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 7 == 0).alias("deleted"))
        events = t(spark, d, "documents").select(F.col("doc_id").alias("event_id"), (F.col("doc_id") * 2 % 1500).alias("doc_id"))
        pipeline = staged.Staged(spark, folder, staged.ingestion(docs))
        for part in [events.filter("event_id % 3 = 0"), events.filter("event_id % 3 = 1"), events.filter("event_id % 3 = 2").unionByName(events.filter("event_id % 3 = 0"))]:
            part.write.mode("append").parquet(f"{folder}/uploads")
            staged.run(spark.readStream.schema(part.schema).parquet(f"{folder}/uploads"), pipeline, f"{folder}/checkpoint")
        pipeline.replay(docs.filter("not deleted and doc_id % 4 = 0"), pipeline.next_number(), "chunk")
        return pipeline

    @query(_staged_sql(_FIXED))
    def stream_ingest(spark, d):
        # A document whose chunks are all blank is refused by the last stage, which the batch form calls chunk.
        stage = F.when((F.col("status") == "FAILED") & (F.col("stage") == "index"), "chunk").otherwise(F.col("stage"))
        return ingested(spark, d).status().select("doc_id", "status", stage.alias("stage"), F.col("rows").alias("chunks"))

    @query(rf"WITH {_STAGED}, {_FIXED} SELECT md5(doc_id || ':fixed:' || chunk_index) AS chunk_id, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index FROM chunks WHERE regexp_matches(content, '\S') AND doc_id IN (SELECT doc_id FROM fd WHERE parsed)")
    def stream_ingest_index(spark, d):
        return ingested(spark, d).current("index").filter("error is null").select("chunk_id", "doc_id", "chunk_index")


_register_ingestion()
