"""Conversation memory over messages (conv_id, id, role, text): budgets, windows, gaps, summary triggers.

Ids ascend within a conversation. Frames run inside one conversation; sums of tokens never collect texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cut_to_tokens, tokens_of_memory


def budget_prefix(messages: DataFrame, budget: int = 3000) -> DataFrame:
    """The newest messages of each conversation that fit the budget together; the first that does not ends it."""
    newest = W.partitionBy("conv_id").orderBy(F.col("id").desc()).rowsBetween(W.unboundedPreceding, 0)
    sized = messages.withColumn("tokens", tokens_of_memory(F.coalesce("text", F.lit(""))))
    return sized.withColumn("cumulative", F.sum("tokens").over(newest)).filter(F.col("cumulative") <= budget)


def latest(messages: DataFrame, n: int = 10) -> DataFrame:
    """The newest n messages of each conversation, place 1 the newest."""
    return messages.withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("id").desc()))).filter(F.col("place") <= n)


def gap(messages: DataFrame, window: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Messages above their conversation's watermark (conv_id, watermark; none: every id from 0 on) that the hot window (conv_id, id) lacks."""
    above = messages.join(watermarks, "conv_id", "left").filter(F.col("id") > F.coalesce("watermark", F.lit(-1)))
    return above.drop("watermark").join(window.select("conv_id", "id"), ["conv_id", "id"], "left_anti")


def summary_due(messages: DataFrame, most: int = 8, tokens: int = 2500) -> DataFrame:
    """Conversations whose hot window has ``most`` messages or ``tokens`` tokens, with the watermark a summary would set."""
    sized = messages.withColumn("tokens", tokens_of_memory(F.coalesce("text", F.lit(""))))
    sums = sized.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("tokens").alias("tokens"), F.max("id").alias("watermark"))
    return sums.withColumn("due", (F.col("messages") >= most) | (F.col("tokens") >= tokens))


def prompt(messages: DataFrame) -> DataFrame:
    """One text per conversation: each message under its role, oldest first."""
    ordered = F.array_sort(F.collect_list(F.struct("id", "role", "text")))
    lines = F.transform(ordered, lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["text"], F.lit(""))))
    return messages.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("prompt"))


def tally(outcomes: DataFrame, ok: str = "ok") -> DataFrame:
    """Total, succeeded and failed of a bulk action."""
    return outcomes.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(ok)).alias("succeeded"), F.count_if(~F.col(ok)).alias("failed"))


def bounded(messages: DataFrame, summaries: DataFrame, budget: int = 3000) -> DataFrame:
    """(conv_id, summary, summary_tokens, ids, used): the summary first, cut to the budget; then the newest messages that still fit, oldest first. summaries: (conv_id, summary)."""
    cut = F.when(tokens_of_memory(F.col("summary")) > budget, cut_to_tokens(F.col("summary"), budget)).otherwise(F.coalesce("summary", F.lit("")))
    taken = F.least(F.coalesce(tokens_of_memory(F.col("summary")), F.lit(0)), F.lit(budget)).cast("long")
    short = summaries.select("conv_id", cut.alias("summary"), taken.alias("summary_tokens"))
    newest = W.partitionBy("conv_id").orderBy(F.col("id").desc()).rowsBetween(W.unboundedPreceding, 0)
    sized = messages.select("conv_id", "id", tokens_of_memory(F.coalesce("text", F.lit(""))).alias("tokens")).withColumn("cumulative", F.sum("tokens").over(newest))
    left = F.lit(budget) - F.coalesce("summary_tokens", F.lit(0))
    before = F.col("cumulative") - F.col("tokens")
    fits = sized.join(short, "conv_id", "left").withColumn("kept", (F.col("cumulative") <= left) & (before < left))
    return fits.groupBy("conv_id").agg(
        F.coalesce(F.first("summary"), F.lit("")).alias("summary"),
        F.coalesce(F.first("summary_tokens"), F.lit(0)).cast("long").alias("summary_tokens"),
        F.array_sort(F.collect_list(F.when(F.col("kept"), F.col("id")))).alias("ids"),
        (F.coalesce(F.first("summary_tokens"), F.lit(0)) + F.coalesce(F.sum(F.when(F.col("kept"), F.col("tokens"))), F.lit(0))).cast("long").alias("used"),
    )


def rolled(messages: DataFrame, watermarks: DataFrame, summarised: DataFrame, most: int = 8, tokens: int = 2500) -> DataFrame:
    """Conversations whose messages above the watermark are due: their new watermark and summary. summarised: (conv_id, new_summary) from a model that was given prompt().

    Without a new summary the watermark stays, so nothing is lost; what is summarised never comes back.
    """
    above = messages.join(watermarks, "conv_id", "left").filter(F.col("id") > F.coalesce("watermark", F.lit(-1)))
    due = summary_due(above.drop("watermark"), most, tokens).filter("due").select("conv_id", "messages", F.col("watermark").alias("reached"))
    joined = due.join(summarised, "conv_id", "left").join(watermarks, "conv_id", "left")
    done = F.col("new_summary").isNotNull() & (F.col("new_summary") != "")
    return joined.select("conv_id", "messages", done.alias("rolled"), F.when(done, F.col("reached")).otherwise(F.coalesce("watermark", F.lit(-1))).alias("watermark"), F.when(done, F.col("new_summary")).alias("summary"))


def restored(messages: DataFrame, window: DataFrame, expected: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Messages to put back where the window holds fewer than expected (conv_id, expected): those of the gap among the newest max(10, expected) above the watermark."""
    present = window.groupBy("conv_id").agg(F.count(F.lit(1)).alias("present"))
    lacks = expected.join(present, "conv_id", "left").filter(F.coalesce("present", F.lit(0)) < F.col("expected")).select("conv_id", "expected")
    above = messages.join(lacks, "conv_id").join(watermarks, "conv_id", "left").filter(F.col("id") > F.coalesce("watermark", F.lit(-1)))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("id").desc()))
    newest = above.withColumn("place", place).filter(F.col("place") <= F.greatest(F.lit(10), F.col("expected"))).drop("place", "expected", "watermark")
    return newest.join(window.select("conv_id", "id"), ["conv_id", "id"], "left_anti")


def history(messages: DataFrame, summaries: DataFrame, n: int = 5) -> DataFrame:
    """The answer of the history action: the summary, then the first n messages, a line each."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("id"))
    first = messages.withColumn("place", place).filter(F.col("place") <= n)
    return prompt(first).join(summaries, "conv_id", "left").select("conv_id", F.concat_ws("\n", F.nullif("summary", F.lit("")), "prompt").alias("answer"))


def sectioned(parts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """parts: (conv_id, *names). One prompt of sections, each under its name; empty ones are left out."""
    each = [F.when(F.coalesce(n, F.lit("")) != "", F.concat(F.lit(f"## {n}\n"), F.col(n))) for n in names]
    return parts.select("conv_id", F.concat_ws("\n\n", *each).alias("prompt"))
