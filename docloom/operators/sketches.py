"""Counters, quantiles and distinct keys by small steps of time, kept as sketches that merge into any window.

Each group and step has one row: count, least and most, a KLL sketch of the values and an HLL sketch of the keys, both
of bounded size. Coarser levels (minutes into hours into days) are merged from the finer ones, never from the rows.
A window is covered by the coarsest steps that fit and finer ones at its two ends, so it reads at most two steps'
parts of each level but the coarsest, whatever its length. New rows are sketched alone and merged into the table.

Stated errors: a quantile's rank is off by ``RANK_ERROR`` of the rows at most, a distinct count by ``KEY_ERROR`` of
itself. They are three times what a KLL sketch keeps in 99 of 100 cases and five standard errors of an HLL union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: Sizes of the sketches.
KLL_K, HLL_LG_K = 800, 12
RANK_ERROR = 3 * 2.296 / KLL_K**0.9723
KEY_ERROR = 5 * 1.04 / 2 ** (HLL_LG_K / 2)
#: Steps of a level that make one of the next: minutes, hours, days.
FACTORS = (60, 24)


def by_step(df: DataFrame, group: str, at: str, value: str, key: str, step_s: int = 60) -> DataFrame:
    """(group, step, n, least, most, kll, hll). Null and NaN values and null keys are left out, so n may be 0; rows without a time have no step; a null group is one."""
    v = F.when(~F.isnan(value), F.col(value).cast("double"))
    step = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(step_s * 1_000_000)).cast("long")
    rows = df.select(F.col(group).alias("group"), step.alias("step"), v.alias("v"), F.col(key).alias("key")).filter("step is not null")
    return rows.groupBy("group", "step").agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.kll_sketch_agg_double("v", KLL_K).alias("kll"), F.hll_sketch_agg("key", HLL_LG_K).alias("hll"))


def merged(sketches: DataFrame, *by: str | Column) -> DataFrame:
    """One row for each combination of by, from the rows' sketches alone."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("kll", KLL_K).alias("kll"), F.hll_union_agg("hll").alias("hll"))


def levels(steps: DataFrame, factors: tuple[int, ...] = FACTORS) -> DataFrame:
    """Steps of every level as one written table, with level (0: as given). Each level is merged from the one before."""
    at = written(steps.select(F.lit(0).alias("level"), "group", "step", "n", "least", "most", "kll", "hll"), "sketches")
    out = at
    for i, factor in enumerate(factors):
        up = merged(at, "group", F.floor(F.col("step") / factor).cast("long").alias("step"))
        at = written(up.select(F.lit(i + 1).alias("level"), *[c for c in at.columns if c != "level"]), "sketches")
        out = out.unionByName(at)
    return out


def extended(table: DataFrame, more: DataFrame) -> DataFrame:
    """The levels of a table and of later rows, late ones for old steps too, as one; (level, group, step) stays a key."""
    return merged(table.unionByName(more), "level", "group", "step").select(*table.columns)


def covered(start: Column, end: Column, factors: tuple[int, ...] = FACTORS) -> Column:
    """Steps (level, step) that make up start to end (not included), the coarsest that fit."""
    parts = []
    span = lambda level, a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda s: F.struct(F.lit(level).alias("level"), s.alias("step")))).otherwise(F.array().cast("array<struct<level:int,step:bigint>>"))
    for level, factor in enumerate(factors):
        lo, hi = F.ceil(start / factor).cast("long"), F.floor(end / factor).cast("long")
        fits = lo < hi
        parts += [span(level, start, F.when(fits, lo * factor).otherwise(end)), F.when(fits, span(level, hi * factor, end)).otherwise(span(level, end, end))]
        start, end = F.when(fits, lo).otherwise(F.lit(0)), F.when(fits, hi).otherwise(F.lit(0))
    return F.concat(*parts, span(len(factors), start, end))


def over(table: DataFrame, windows: DataFrame, factors: tuple[int, ...] = FACTORS) -> DataFrame:
    """windows: (window_id, start, end) in steps of level 0, end not included. (group, window_id, n, least, most, kll, hll); groups without a row in a window have none."""
    asked = windows.select("window_id", F.explode(covered(F.col("start").cast("long"), F.col("end").cast("long"), factors)).alias("c")).select("window_id", "c.level", "c.step")
    return merged(table.join(asked, ["level", "step"]), "group", "window_id")


def figures(sketches: DataFrame, *by: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """by, n, least, most, a quantile p50 and so on for each of ps (null without values), keys with keys_low and keys_high, and rank_error."""
    quantiles = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("kll", F.lit(float(p)))).alias(f"p{round(100 * p)}") for p in ps]
    keys = F.hll_sketch_estimate("hll")
    return sketches.select(*by, "n", "least", "most", *quantiles, keys.alias("keys"), F.floor(keys * (1 - KEY_ERROR)).alias("keys_low"), F.ceil(keys * (1 + KEY_ERROR)).alias("keys_high"), F.lit(RANK_ERROR).alias("rank_error"))
