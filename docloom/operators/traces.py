"""Trace, metric and dashboard figures over events (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import percentiles, round_half_up


def _failed() -> Column:
    return F.col("event_type") == "error"


def _rate(part: Column, digits: int = 1) -> Column:
    return round_half_up(100.0 * part / F.count(F.lit(1)), digits)


def run_stats(events: DataFrame) -> DataFrame:
    """By day: runs, succeeded, failed, success_rate in percent (one digit), mean of positive durations, and their p95 (nearest rank)."""
    day = events.withColumn("day", F.to_date("ts"))
    base = day.groupBy("day").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~_failed()).alias("succeeded"),
        F.count_if(_failed()).alias("failed"),
        _rate(F.count_if(~_failed())).alias("success_rate"),
        F.round(F.avg(F.when(F.col("value") > 0, F.col("value"))), 9).alias("mean_value"),
    )
    p95 = percentiles(day.filter("value > 0"), "day", "value", (0.95,)).select("day", F.col("nearest_p95").alias("p95"))
    return base.join(p95, "day", "left")


def slowest(events: DataFrame) -> DataFrame:
    """Each user's slowest event, ties to the smaller id; one aggregation."""
    best = F.max_by("event_id", F.struct("value", -F.col("event_id")))
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), best.alias("event_id"), F.max("value").alias("value"))


def timeline(events: DataFrame) -> DataFrame:
    """Each event's place in its user's trace: offset in ms, and start and width in percent of the span, 0.5 at least."""
    whole = W.partitionBy("user_id")
    ms = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    at = events.select("event_id", "user_id", "value", ms.alias("ms")).withColumn("start", F.min("ms").over(whole)).withColumn("end", F.max(F.col("ms") + F.col("value")).over(whole))
    span = F.greatest(F.col("end") - F.col("start"), F.lit(1.0))
    offset = F.col("ms") - F.col("start")
    width = F.greatest(F.lit(0.5), F.least(F.lit(100.0), 100.0 * F.col("value") / span))
    return at.select("event_id", "user_id", F.round(offset, 3).alias("offset_ms"), F.round(100.0 * offset / span, 4).alias("left_pct"), F.round(width, 4).alias("width_pct"))


def kpi_delta(events: DataFrame) -> DataFrame:
    """By day: events and active users, and their change from the day before, absolute and in percent."""
    daily = events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("active_users"))
    before = F.lag("events").over(W.orderBy("day"))
    return daily.select("day", "events", "active_users", (F.col("events") - before).alias("delta"), F.round(100.0 * (F.col("events") - before) / before, 9).alias("delta_pct"))


def performance(events: DataFrame, slow: float = 20.0) -> DataFrame:
    """By mode: mean, empty and slow rates, and a health verdict by the slow rate."""
    rates = events.groupBy(F.col("event_type").alias("mode")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("value"), 9).alias("mean_value"),
        _rate(F.count_if(F.col("value") <= 0)).alias("empty_rate"),
        _rate(F.count_if(F.col("value") > slow)).alias("slow_rate"),
    )
    return rates.withColumn("health", F.when(F.col("slow_rate") > 50, "critical").when(F.col("slow_rate") > 20, "attention").otherwise("healthy"))


def trend(events: DataFrame, unit: str = "day") -> DataFrame:
    """Events, users and mean value by hour or day; empty buckets in between count 0."""
    stamp = F.col("ts").cast("timestamp")
    found = events.groupBy(F.date_trunc(unit, stamp).alias("bucket")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 9).alias("mean_value"))
    edges = found.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).filter("a is not null")
    buckets = edges.select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("bucket"))
    return buckets.join(found, "bucket", "left").select("bucket", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("users", F.lit(0)).alias("users"), "mean_value")


def sliding_rate(events: DataFrame, width: str = "2 hours", slide: str = "1 hour") -> DataFrame:
    """Events and errors in sliding windows, by window start."""
    w = F.window(F.col("ts").cast("timestamp"), width, slide)
    return events.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.count_if(_failed()).alias("errors")).select(F.col("w.start").alias("window_start"), "events", "errors")


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Each user's runs of events with gaps under ``gap_minutes``."""
    w = F.session_window(F.col("ts").cast("timestamp"), f"{gap_minutes} minutes")
    return events.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event")).select("user_id", F.col("w.start").alias("session_start"), "events", "first_event")


def latest_state(events: DataFrame) -> DataFrame:
    """The latest state of each key, and how many it went through; one aggregation, no sort."""
    return events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("event_id"), F.count_distinct("event_type").alias("states"))


def trailing_runs(events: DataFrame, least: int = 3) -> DataFrame:
    """Length of the run of equal actions that ends each user's history, and whether it is a loop: events after the last different one."""
    last = events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("action"))
    marked = events.join(last, "user_id")
    cut = marked.groupBy("user_id", "action").agg(F.max(F.when(F.col("event_type") != F.col("action"), F.col("event_id"))).alias("other"))
    after = events.select("user_id", "event_id").join(cut, "user_id").filter(F.col("other").isNull() | (F.col("event_id") > F.col("other")))
    return after.groupBy("user_id", "action").agg(F.count(F.lit(1)).alias("run_length")).withColumn("is_loop", F.col("run_length") >= least)


def performance_report(events: DataFrame, by: str, slow: float = 20.0) -> DataFrame:
    """By ``by``: mean, p95 (nearest rank), success, error, empty and slow rates in percent, the health verdict and the first insight that holds."""
    base = events.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("value"), 9).alias("mean_value"),
        _rate(F.count_if(~_failed())).alias("success_rate"),
        _rate(F.count_if(_failed())).alias("error_rate"),
        _rate(F.count_if(F.col("value") <= 0)).alias("empty_rate"),
        _rate(F.count_if(F.col("value") > slow)).alias("slow_rate"),
    )
    p95 = percentiles(events, by, "value", (0.95,)).select(by, F.col("nearest_p95").alias("p95"))
    health = F.when(F.col("n") == 0, "unknown").when((F.col("error_rate") > 5) | (F.col("success_rate") < 95), "critical").when(F.col("empty_rate") > 20, "attention").otherwise("healthy")
    insight = F.when(F.col("mean_value") > 15, "latency").when(F.col("error_rate") > 5, "errors").when(F.col("empty_rate") > 20, "no documents").otherwise("none")
    return base.join(p95, by, "left").withColumn("health", health).withColumn("insight", insight)


def stage_durations(steps: DataFrame) -> DataFrame:
    """steps: (doc_id, stage, ms). One row per document: total and the time of each of the stages extract, chunk and embed; 0 for a stage it lacks."""
    each = [F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("ms"))), F.lit(0.0)).alias(f"{s}_ms") for s in ("extract", "chunk", "embed")]
    return steps.groupBy("doc_id").agg(*each, F.coalesce(F.sum("ms"), F.lit(0.0)).alias("total_ms"))


def node_report(nodes: DataFrame) -> DataFrame:
    """nodes: (task_id, node_id, status, start_ms, end_ms). One row per task: nodes, how many failed, the task's status and duration from first start to last end.

    A task fails with any of its nodes, runs while any has not ended, and else is done.
    """
    out = nodes.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(F.col("end_ms").isNull()).alias("open"),
        (F.max("end_ms") - F.min("start_ms")).alias("duration_ms"),
    )
    status = F.when(F.col("failed") > 0, "FAILED").when(F.col("open") > 0, "RUNNING").otherwise("DONE")
    return out.select("task_id", "nodes", "failed", status.alias("status"), F.when(F.col("open") == 0, F.col("duration_ms")).alias("duration_ms"))


def counter_rates(events: DataFrame, widths: tuple[int, ...] = (1, 2, 5), unit: str = "minute") -> DataFrame:
    """By key and step (one ``unit``): the increase over each of the widths that end with the step, and the rate a second. One sum a step, then a frame over steps."""
    seconds = {"minute": 60, "hour": 3600, "day": 86400}[unit]
    step = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (1_000_000 * seconds)).cast("long")
    sums = events.groupBy("event_type", step.alias("step")).agg(F.count(F.lit(1)).alias("c"))
    out = sums
    for w in widths:
        frame = W.partitionBy("event_type").orderBy("step").rangeBetween(1 - w, 0)
        out = out.withColumn(f"increase_{w}", F.sum("c").over(frame)).withColumn(f"rate_{w}", F.round(F.col(f"increase_{w}") / (w * seconds), 9))
    return out.drop("c")
