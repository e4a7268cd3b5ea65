"""Registered queries of pipeline graphs and mergeable sketches, and their SQL.

Pipelines are users, their nodes the events in order of id; every seventh user's last event leads back to an
earlier one, and every eleventh user's to one that is not there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import pipelines, sketches
from .queries import query, t

_NODES = """nd AS (SELECT user_id AS pipeline_id, event_id AS node_id, event_type, value, lead(event_id) OVER w AS nx, first_value(event_id) OVER w AS f, nth_value(event_id, 3) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
no AS (SELECT pipeline_id, node_id, event_type, value, CASE WHEN nx IS NOT NULL AND node_id % 50 = 0 THEN NULL WHEN nx IS NOT NULL THEN nx WHEN pipeline_id % 7 = 0 THEN coalesce(third, f) WHEN pipeline_id % 11 = 0 THEN -1 END AS next_node_id FROM nd),
sz AS (SELECT pipeline_id, count(*) AS n FROM no GROUP BY pipeline_id)"""
_RANKED = f"""{_NODES}, wk AS (SELECT pipeline_id, node_id, node_id AS cur, 0::BIGINT AS steps FROM no
  UNION ALL SELECT wk.pipeline_id, wk.node_id, b.node_id, steps + 1 FROM wk JOIN no a ON a.pipeline_id = wk.pipeline_id AND a.node_id = cur JOIN no b ON b.pipeline_id = a.pipeline_id AND b.node_id = a.next_node_id JOIN sz ON sz.pipeline_id = wk.pipeline_id WHERE steps < 2 * sz.n),
le AS (SELECT wk.pipeline_id, wk.node_id, max(steps) AS steps, arg_max(cur, steps) AS end_node, max(steps) >= 2 * any_value(sz.n) AS cyclic FROM wk JOIN sz USING (pipeline_id) GROUP BY ALL),
oc AS (SELECT DISTINCT wk.pipeline_id, cur AS node_id FROM wk JOIN le USING (pipeline_id, node_id) JOIN sz USING (pipeline_id) WHERE le.cyclic AND wk.steps >= sz.n),
rk AS (SELECT no.pipeline_id, no.node_id, CASE WHEN NOT cyclic THEN end_node END AS end_node, CASE WHEN NOT cyclic THEN steps END AS steps_left,
  CASE WHEN NOT cyclic THEN max(CASE WHEN NOT cyclic THEN steps END) OVER (PARTITION BY no.pipeline_id, CASE WHEN cyclic THEN NULL ELSE end_node END) - steps END AS place, cyclic, oc.node_id IS NOT NULL AS on_cycle,
  no.next_node_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM no x WHERE x.pipeline_id = no.pipeline_id AND x.node_id = no.next_node_id) AS dangling
  FROM no JOIN le USING (pipeline_id, node_id) LEFT JOIN oc USING (pipeline_id, node_id))"""


def _nodes(spark, d) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("event_id")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    back = F.coalesce(F.nth_value("event_id", 3).over(whole), F.first("event_id").over(whole))
    nx = F.lead("event_id").over(w)
    next_ = F.when(nx.isNotNull() & (F.col("event_id") % 50 == 0), None).when(nx.isNotNull(), nx).when(F.col("user_id") % 7 == 0, back).when(F.col("user_id") % 11 == 0, -1)
    return t(spark, d, "events").filter("user_id is not null").select(F.col("user_id").alias("pipeline_id"), F.col("event_id").alias("node_id"), next_.alias("next_node_id"), "event_type", "value")


@query(f"WITH RECURSIVE {_RANKED} SELECT * FROM rk")
def pipeline_graph(spark, d):
    return pipelines.ranked(_nodes(spark, d))


_DONE = "CASE WHEN node_id % 41 = 0 THEN 'FAILED' ELSE 'DONE' END"


@query(f"""WITH RECURSIVE {_RANKED}, pa AS (SELECT pipeline_id AS task_id, node_id, place, event_type <> 'click' OR pipeline_id % 3 = 0 AS runs, CASE WHEN node_id % 59 <> 0 THEN {_DONE} END AS status, node_id % 100 AS ms FROM rk JOIN no USING (pipeline_id, node_id) WHERE NOT cyclic),
fi AS (SELECT *, min(CASE WHEN runs AND status = 'FAILED' THEN (place, node_id) END) OVER (PARTITION BY task_id) AS first FROM pa),
ru AS (SELECT *, runs AND (first IS NULL OR (place, node_id) <= first) AND status IS NOT NULL AS ran FROM fi)
SELECT task_id, count(*) FILTER (runs) AS expected, count(*) FILTER (NOT runs) AS passed_over, count(*) FILTER (ran) AS ran, any_value(first)[2] AS failed_node, CAST(coalesce(sum(ms) FILTER (ran), 0) AS BIGINT) AS duration_ms,
  CASE WHEN any_value(first) IS NOT NULL THEN 'FAILED' WHEN count(*) FILTER (ran AND status = 'DONE') = count(*) FILTER (runs) THEN 'DONE' ELSE 'RUNNING' END AS status FROM ru GROUP BY task_id""")
def pipeline_tasks(spark, d):
    nodes = _nodes(spark, d)
    clicks = nodes.select("pipeline_id", "node_id", F.when(F.col("event_type") == "click", "third").alias("field"), F.lit("yes").alias("value"))
    tasks = nodes.select("pipeline_id").distinct().select(F.col("pipeline_id").alias("task_id"), "pipeline_id", F.create_map(F.lit("third"), F.when(F.col("pipeline_id") % 3 == 0, "yes").otherwise("no")).alias("attributes"))
    status = F.when(F.col("node_id") % 41 == 0, "FAILED").otherwise("DONE")
    done = nodes.filter("node_id % 59 <> 0").select(F.col("pipeline_id").alias("task_id"), "node_id", status.alias("status"), (F.col("node_id") % 100).alias("duration_ms"))
    return pipelines.task_report(pipelines.task_paths(tasks, clicks, pipelines.ranked(nodes)), done)


_DAYS = 7


@query(f"""WITH e AS (SELECT event_type, user_id, value, epoch_us(ts) // 86400000000 AS day FROM events),
w AS (SELECT DISTINCT day FROM e)
SELECT event_type, w.day, count(value) AS n, min(value) AS least, max(value) AS most, true AS p50_within, true AS p95_within, true AS p99_within, count(DISTINCT user_id) AS exact_keys, true AS keys_within
FROM w JOIN e ON e.day BETWEEN w.day - {_DAYS - 1} AND w.day GROUP BY event_type, w.day""")
def sketch_windows(spark, d):
    """Seven days up to each day, merged from sketches of minutes, and whether each figure keeps its stated error against all rows of its window."""
    events = t(spark, d, "events")
    table = sketches.levels(sketches.by_step(events, "event_type", "ts", "value", "user_id"))
    days = table.filter("level = 2").select(F.col("step").alias("window_id")).distinct()
    minutes = 24 * 60
    wanted = days.select("window_id", ((F.col("window_id") - _DAYS + 1) * minutes).alias("start"), ((F.col("window_id") + 1) * minutes).alias("end"))
    told = sketches.figures(sketches.over(table, wanted), "group", "window_id").select("*", F.col("window_id").alias("day"))
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    rows = events.select(F.col("event_type").alias("g"), "user_id", "value", F.explode(F.sequence(day, day + _DAYS - 1)).alias("window"))
    met = told.join(rows, told["group"].eqNullSafe(rows["g"]) & (told["window_id"] == rows["window"]))
    ranks = [F.struct(F.count_if(F.col("value") < F.col(p)).alias("below"), F.count_if(F.col("value") <= F.col(p)).alias("upto")).alias(f"r{p}") for p in ("p50", "p95", "p99")]
    kept = [F.first(c).alias(c) for c in ("n", "least", "most", "keys_low", "keys_high")]
    found = met.groupBy("group", "day").agg(*kept, *ranks, F.countDistinct("user_id").alias("exact_keys"))
    within = lambda p, q: ((F.col(f"r{p}.below") <= F.col("n") * (q + sketches.RANK_ERROR)) & (F.col(f"r{p}.upto") >= F.col("n") * (q - sketches.RANK_ERROR))).alias(f"{p}_within")
    return found.select(F.col("group").alias("event_type"), "day", "n", "least", "most", within("p50", 0.5), within("p95", 0.95), within("p99", 0.99), "exact_keys", F.col("exact_keys").between(F.col("keys_low"), F.col("keys_high")).alias("keys_within"))
