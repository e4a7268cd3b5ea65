"""Mixing sources to target weights by hash-threshold histograms, in native column functions only.

Every document gets a 60-bit hash. A source's budget is a number of whole passes over the source plus a
rest; the documents of the rest are those whose hash lies under a threshold. The threshold is found from
histograms of token counts by hash bucket: the bucket in which the running sum crosses the budget is split
again by the next bits, and only that one, so documents are never sorted. A larger budget has a higher
threshold, so mixes of rising budgets are nested.

Defined cases: a null text has size 0; null sources form one source, ordered last; a null doc_id hashes as
the word "null"; rows with the same doc_id are chosen together; an empty table gives an empty result; an
extra column stays untouched in ``mix_rows`` and is ignored by ``mix``, whose own columns win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import word_count, written

#: Bits of the hash that each histogram looks at, from the top.
LEVELS = (15, 15, 15, 15)
BITS = sum(LEVELS)
#: Up to so many sources the table of thresholds is broadcast; beyond, Spark joins by shuffle and splits hot sources.
BROADCAST_SOURCES = 20_000


def draw(doc_id: str = "doc_id") -> Column:
    """A hash of the document's id in [0, 2**60)."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def source_key(source: str = "source") -> Column:
    """A join key without nulls."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """sizes: one row per source (key, source, source_size). Adds target.

    Targets share the sum of all sizes by weight; none exceeds cap times its source, and what is above goes
    to the others by weight. With ceilings ordered by ceiling / weight, the water level is the first
    (rest / weights left) below the next ceiling's ratio. One row per source meets in the windows, never
    a document.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    by_ratio = W.orderBy("ratio", "key")
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    levelled = (
        sizes.withColumn("weight", weight)
        .withColumn("ceiling", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("ceiling") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("water", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"])
    )
    return levelled.select("key", "source", "source_size", F.least("ceiling", F.coalesce(F.col("water") * F.col("weight"), F.col("ceiling"))).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """sized: (key, size, h); budgets: (key, rest). Adds below: documents of the source with h < below make up the rest.

    ``prefix`` holds the bits settled so far and ``taken`` the tokens under that prefix. Each level sums
    tokens by the next bits within the prefix alone, and moves into the bucket where the running sum reaches
    the rest. The last bucket is one hash value: it is taken if that comes nearer to the rest.
    """
    left = sum(levels)
    state = budgets.filter("rest > 0").select("key", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("taken"))
    for bits in levels:
        inside = sized.join(F.broadcast(state) if _few(state) else state, "key").filter(F.shiftright("h", left) == F.col("prefix"))
        left -= bits
        bucket = F.shiftright("h", left)
        sums = inside.groupBy("key", "rest", "taken", bucket.alias("prefix")).agg(F.sum("size").alias("tokens"))
        running = F.col("taken") + F.sum("tokens").over(W.partitionBy("key").orderBy("prefix"))
        crossed = sums.withColumn("upto", running).filter("upto >= rest").groupBy("key").agg(F.min(F.struct("prefix", "rest", "upto", "tokens")).alias("b"))
        state = written(crossed.select("key", "b.rest", "b.prefix", (F.col("b.upto") - F.col("b.tokens")).alias("taken"), F.col("b.upto").alias("upto")), "threshold")
        done, state = state, state.drop("upto")
    nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("taken")
    return done.select("key", (F.col("prefix") + nearer.cast("long")).alias("below"))


def _few(per_source: DataFrame) -> bool:
    return per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """The sized documents (doc_id, key, size, h), written once, and the plan by source (key, source_size, target, passes, below)."""
    sized = written(docs.select("doc_id", F.col("source").cast("string").alias("source"), source_key().alias("key"), word_count("text").alias("size"), draw().alias("h")), "sized")
    sizes = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, cap)
    passes = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)).cast("long")
    budgets = written(targets.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "budgets")
    return sized, budgets.join(thresholds(sized, budgets), "key", "left").select("key", "source_size", "target", "passes", F.coalesce("below", F.lit(0)).alias("below"))


def copies() -> Column:
    """How often a document with hash h is taken under its source's plan."""
    return F.col("passes") + (F.col("h") < F.col("below")).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    sized, sources = plan(docs, weights, cap)
    sources = written(sources, "sources")
    joined = sized.join(F.broadcast(sources) if _few(sources) else sources, "key")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mix_rows(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """The mixed documents themselves, each row as often as the mix takes it, with the columns of docs."""
    _, sources = plan(docs, weights, cap)
    sources = written(sources, "sources")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source_key().alias("key"), draw().alias("h"))
    joined = keyed.join(F.broadcast(sources) if _few(sources) else sources, "key")
    return joined.select("row", F.explode(F.array_repeat(F.lit(True), copies().cast("int")))).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 3.0::DOUBLE AS ceiling, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM sizes),
levels AS (
  SELECT *, ceiling / weight AS ratio,
         (total - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
water AS (SELECT arg_min(level, ratio) AS water FROM levels WHERE ratio > level),
targets AS (SELECT source, source_size, least(ceiling, coalesce(water * weight, ceiling)) AS target FROM levels, water),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM targets),
run AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.passes, b.target - b.passes * b.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h) AS upto
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (passes + CASE WHEN rest > 0 AND (upto < rest OR (upto - size < rest AND upto - rest < rest - (upto - size))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""
