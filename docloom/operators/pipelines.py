"""Graphs of pipeline nodes that each name their next one: order, cycles, and what a task runs of them.

Every node has one way on, so all are ranked at once by doubling: in each round a node learns the end of its way and
the steps to it from the node that it has reached so far, which is twice as far as in the round before. A pipeline
of n nodes takes log2(n) rounds, each one join on node keys. A node whose way has not ended then leads into a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written


def ranked(nodes: DataFrame) -> DataFrame:
    """nodes: (pipeline_id, node_id, next_node_id). (pipeline_id, node_id, end_node, steps_left, place, cyclic, on_cycle, dangling).

    place: from 0 at the start farthest from the end, so every node stands after those that lead to it. Nodes that
    lead into a cycle are cyclic and have neither end nor place; on_cycle tells those of the cycle itself. A next
    node that is not there ends the way (dangling). A pipeline's node ids differ; rows without one are left out.
    """
    given = nodes.filter("pipeline_id is not null and node_id is not null").select("pipeline_id", "node_id", "next_node_id")
    there = given.select("pipeline_id", F.col("node_id").alias("next_node_id"), F.lit(True).alias("there"))
    linked = given.join(there, ["pipeline_id", "next_node_id"], "left")
    known = F.coalesce("there", F.lit(False))
    state = written(
        linked.select(
            "pipeline_id", "node_id", F.when(known, F.col("next_node_id")).alias("reached"), known.cast("long").alias("steps"), F.coalesce(F.when(known, F.col("next_node_id")), F.col("node_id")).alias("end_node"), (F.col("next_node_id").isNotNull() & ~known).alias("dangling")
        ),
        "ranks",
    )
    most = given.groupBy("pipeline_id").count().agg(F.max("count").alias("m")).first()["m"] or 0
    for _ in range(most.bit_length()):  # after them every way of at most ``most`` steps has ended
        beyond = state.select("pipeline_id", F.col("node_id").alias("reached"), F.col("reached").alias("then"), F.col("steps").alias("more"), F.col("end_node").alias("later"))
        met = state.join(beyond, ["pipeline_id", "reached"], "left")
        state = written(met.select("pipeline_id", "node_id", F.col("then").alias("reached"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("later", "end_node").alias("end_node"), "dangling"), "ranks")
    cyclic = F.col("reached").isNotNull()
    on_cycle = state.filter(cyclic).select("pipeline_id", F.col("reached").alias("node_id")).distinct().withColumn("hit", F.lit(True))
    farthest = state.filter(~cyclic).groupBy("pipeline_id", "end_node").agg(F.max("steps").alias("most"))
    out = state.join(on_cycle, ["pipeline_id", "node_id"], "left").join(farthest, ["pipeline_id", "end_node"], "left")
    ends = lambda c: F.when(~cyclic, c)
    return out.select("pipeline_id", "node_id", ends(F.col("end_node")).alias("end_node"), ends(F.col("steps")).alias("steps_left"), ends(F.col("most") - F.col("steps")).alias("place"), cyclic.alias("cyclic"), F.coalesce("hit", F.lit(False)).alias("on_cycle"), "dangling")


def task_paths(tasks: DataFrame, nodes: DataFrame, order: DataFrame) -> DataFrame:
    """What each task runs. tasks: (task_id, pipeline_id, attributes map); nodes: (pipeline_id, node_id, field, value); order: ``ranked``.

    A node runs where it has no field, or the task's attribute of that name is the value; else it is passed over.
    (task_id, pipeline_id, node_id, place, runs); nodes of cycles are never reached.
    """
    conditions = nodes.select("pipeline_id", "node_id", "field", "value").join(order.filter("not cyclic").select("pipeline_id", "node_id", "place"), ["pipeline_id", "node_id"])
    runs = F.col("field").isNull() | F.coalesce(F.try_element_at("attributes", F.col("field")) == F.col("value"), F.lit(False))
    return tasks.join(conditions, "pipeline_id").select("task_id", "pipeline_id", "node_id", "place", runs.alias("runs"))


def task_report(paths: DataFrame, done: DataFrame) -> DataFrame:
    """done: (task_id, node_id, status, duration_ms). Per task: nodes that should run, passed over, run, the first node that failed, the sum of durations up to it, and its status.

    What stands after a failed node is not reached and does not count, whatever its records say. A task without a
    failure is DONE when all its nodes have a DONE record, else RUNNING.
    """
    joined = paths.join(done, ["task_id", "node_id"], "left")
    failing = F.struct(F.col("place"), F.col("node_id"))
    first = F.min(F.when(F.col("runs") & (F.col("status") == "FAILED"), failing)).over(W.partitionBy("task_id"))
    counted = joined.withColumn("first", first).withColumn("before", F.col("first").isNull() | (F.struct(F.col("place"), F.col("node_id")) <= F.col("first")))
    ran = F.col("runs") & F.col("before") & F.col("status").isNotNull()
    out = counted.groupBy("task_id").agg(
        F.count_if("runs").alias("expected"),
        F.count_if(~F.col("runs")).alias("passed_over"),
        F.count_if(ran).alias("ran"),
        F.count_if(ran & (F.col("status") == "DONE")).alias("done"),
        F.first("first.node_id").alias("failed_node"),
        F.coalesce(F.sum(F.when(ran, F.col("duration_ms"))), F.lit(0)).cast("long").alias("duration_ms"),
    )
    status = F.when(F.col("failed_node").isNotNull(), "FAILED").when(F.col("done") == F.col("expected"), "DONE").otherwise("RUNNING")
    return out.select("task_id", "expected", "passed_over", "ran", "failed_node", "duration_ms", status.alias("status"))
