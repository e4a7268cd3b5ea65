"""Retrieval and answer quality, and latency percentiles. Sums and counts per query or group; no group is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def query_quality(hits: DataFrame, golden: DataFrame, ks: tuple[int, ...] = (3, 5, 10), k: int = 10) -> DataFrame:
    """hits: (query_id, rank, relevant boolean); golden: (query_id, n_golden). One row per query: hit_k, reciprocal rank, and NDCG by three conventions.

    ndcg_log2 discounts by log2(rank + 1) and takes the retrieved hits first as ideal; ndcg_sqrt discounts by
    sqrt(rank + 1) and takes all golden rows (k at most) as ideal; ndcg_gain discounts by rank, with the same
    ideal. Queries without hits count 0.
    """
    rel = F.when(F.col("relevant"), 1.0).otherwise(0.0)
    within = F.col("rank") <= k
    aggs = [F.max(F.when((F.col("rank") <= x) & F.col("relevant"), 1).otherwise(0)).alias(f"hit_{x}") for x in ks]
    aggs += [
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.sum(F.when(within & F.col("relevant"), 1).otherwise(0)).alias("found"),
        F.sum(F.when(within, rel / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("log2"),
        F.sum(F.when(within, rel / F.sqrt(F.col("rank") + 1)).otherwise(0.0)).alias("sqrt"),
        F.sum(F.when(within, rel / F.col("rank")).otherwise(0.0)).alias("gain"),
    ]
    per = golden.join(hits.groupBy("query_id").agg(*aggs), "query_id", "left").fillna(0)

    def ideal(n: Column, discount) -> Column:
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / discount(i)))

    most = F.least(F.col("n_golden"), F.lit(k))
    ratio = lambda got, best: F.round(F.coalesce(F.col(got) / best, F.lit(0.0)), 6).alias(f"ndcg_{got}")
    return per.select(
        "query_id",
        *[F.coalesce(F.col(f"hit_{x}"), F.lit(0)).alias(f"hit_{x}") for x in ks],
        F.round(F.when(F.col("first") > 0, 1.0 / F.col("first")).otherwise(0.0), 6).alias("rr"),
        ratio("log2", ideal(F.col("found"), lambda i: F.log2(i + 1))),
        ratio("sqrt", ideal(most, lambda i: F.sqrt(i + 1))),
        ratio("gain", ideal(most, lambda i: i)),
    )


def report(per_query: DataFrame) -> DataFrame:
    """Means over queries; mrr_answered leaves out queries without any hit."""
    names = [c for c in per_query.columns if c not in ("query_id", "rr")]
    means = [F.round(F.avg(c), 6).alias(c) for c in names]
    return per_query.agg(F.count(F.lit(1)).alias("n"), *means, F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg(F.when(F.col("rr") > 0, F.col("rr"))), 6).alias("mrr_answered"))


def reordered(before: DataFrame, after: DataFrame) -> DataFrame:
    """Queries whose ranking changed: any (query, rank) with another chunk."""
    a, b = (x.select("query_id", "rank", F.col("chunk_id").alias(n)) for x, n in ((before, "a"), (after, "b")))
    changed = a.join(b, ["query_id", "rank"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return changed.select("query_id").distinct().agg(F.count(F.lit(1)).alias("n_reordered"))


def round_half_up(x: Column, digits: int = 2) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def answer_score(faithfulness: Column, relevancy: Column, precision: Column, recall: Column) -> Column:
    """0.3 faithfulness + 0.3 relevancy + 0.2 precision + 0.2 recall, two digits."""
    return round_half_up(faithfulness * 0.3 + relevancy * 0.3 + precision * 0.2 + recall * 0.2)


#: Rank error of the sketch that brackets a percentile, as a share of the rows is 1 / SKETCH.
SKETCH = 2_000


def percentiles(df: DataFrame, group: str, value: str, ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """By group: floor_p (the value at place int(n * p) from 0) and nearest_p (place ceil(n * p) - 1), exact.

    A sketch brackets each place within a few thousandths of the ranks. What lies below a bracket is only
    counted; the values inside are counted by value and put in order, so no group is sorted or gathered whole.
    """
    given = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("__g"), F.col(value).alias("__v"))
    near = 2 / SKETCH
    edges = [e for p in ps for e in (max(0.0, p - near), min(1.0, p + near))]
    bounds = given.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"), F.percentile_approx("__v", edges, SKETCH).alias("__e"))
    # The outermost brackets are open, for places at the ends.
    places = [F.struct(F.lit(i).alias("i"), (F.col("__least") if p <= near else F.col("__e")[2 * i]).alias("lo"), (F.col("__most") if p + near >= 1 else F.col("__e")[2 * i + 1]).alias("hi")) for i, p in enumerate(ps)]
    brackets = bounds.select(F.col("__g").alias("__k"), "__n", F.array(*places).alias("__b"))
    rows = given.join(brackets, F.col("__g").eqNullSafe(F.col("__k"))).select("__g", "__n", "__v", F.explode(F.filter("__b", lambda b: F.col("__v") <= b["hi"])).alias("__b"))
    inside = rows.groupBy("__g", "__n", F.col("__b.i").alias("i"), F.when(F.col("__v") >= F.col("__b.lo"), F.col("__v")).alias("__v")).agg(F.count(F.lit(1)).alias("c"))
    run = inside.withColumn("upto", F.sum("c").over(W.partitionBy("__g", "i").orderBy(F.col("__v").asc_nulls_first())))
    out = [F.max("__n").alias("n")]
    for i, p in enumerate(ps):
        tag, mine = f"p{round(100 * p)}", (F.col("i") == i) & F.col("__v").isNotNull()
        out.append(F.min(F.when(mine & (F.col("upto") > F.floor(F.col("__n") * F.lit(p))), F.col("__v"))).alias(f"floor_{tag}"))
        out.append(F.min(F.when(mine & (F.col("upto") >= F.ceil(F.col("__n") * F.lit(p))), F.col("__v"))).alias(f"nearest_{tag}"))
    return run.groupBy(F.col("__g").alias(group)).agg(*out)


def judged(answers: DataFrame) -> DataFrame:
    """answers: (answer_id, question vector, inferred array of vectors, verdicts array of strings, supported, claims, found, truths). The four figures that need no model.

    relevancy: mean cosine of the question and the inferred questions, 1 at most, 0.5 for none; precision: share
    of verdicts that say true; faithfulness: supported of all claims; recall: truths found, 0 without a truth.
    """
    from ..functions.vectors import cosine

    likeness = F.transform("inferred", lambda v: cosine(F.col("question"), v))
    mean = F.aggregate(likeness, F.lit(0.0), lambda s, x: s + x) / F.size("inferred")
    true = F.size(F.filter("verdicts", lambda v: F.lower(v).contains("true")))
    share = lambda part, whole, none: F.when(F.coalesce(whole, F.lit(0)) > 0, part / whole).otherwise(F.lit(none))
    return answers.select(
        "answer_id",
        F.round(share(F.col("supported"), F.col("claims"), 0.0), 6).alias("faithfulness"),
        F.round(F.when(F.size("inferred") > 0, F.least(F.lit(1.0), mean)).otherwise(0.5), 6).alias("relevancy"),
        F.round(share(true, F.size("verdicts"), 0.0), 6).alias("precision"),
        F.round(share(F.col("found"), F.col("truths"), 0.0), 6).alias("recall"),
    )


def histogram(df: DataFrame, group: str, value: str, edges: tuple[float, ...]) -> DataFrame:
    """Cumulative buckets by group: (group, le, count), the last bucket without an upper edge (le null)."""
    buckets = F.array(*[F.struct(F.lit(float(e)).alias("le"), F.count_if(F.col(value) <= e).alias("count")) for e in edges], F.struct(F.lit(None).cast("double").alias("le"), F.count(value).alias("count")))
    return df.groupBy(group).agg(buckets.alias("b")).select(group, F.explode("b").alias("b")).select(group, "b.*")


def histogram_quantile(buckets: DataFrame, group: str, q: float) -> DataFrame:
    """The q-quantile from cumulative buckets (group, le, count), linear inside its bucket; in the open bucket the last edge."""
    order = W.partitionBy(group).orderBy(F.col("le").asc_nulls_last())
    run = buckets.withColumn("total", F.max("count").over(W.partitionBy(group))).withColumn("below", F.coalesce(F.lag("count").over(order), F.lit(0))).withColumn("from", F.coalesce(F.lag("le").over(order), F.lit(0.0)))
    inside = run.filter((F.col("count") >= F.col("total") * q) & (F.col("total") > 0)).groupBy(group).agg(F.min_by(F.struct("from", "le", "below", "count", "total"), F.struct(F.col("le").isNull(), "le")).alias("b"))
    width = F.col("b.le") - F.col("b.from")
    value = F.when(F.col("b.le").isNull() | (F.col("b.count") == F.col("b.below")), F.col("b.from")).otherwise(F.col("b.from") + width * (F.col("b.total") * q - F.col("b.below")) / (F.col("b.count") - F.col("b.below")))
    return inside.select(group, F.round(value, 6).alias("quantile"))


def by_mode(per_query: DataFrame, mode: str = "mode") -> DataFrame:
    """per_query: (mode, latency, hit_5, rr). Count, latency figures, Hit@5 and MRR of each mode."""
    base = per_query.groupBy(mode).agg(F.round(F.avg("latency"), 6).alias("mean"), F.max("latency").alias("most"), F.round(F.avg("hit_5"), 6).alias("hit_5"), F.round(F.avg("rr"), 6).alias("mrr"))
    return base.join(percentiles(per_query, mode, "latency"), mode)
