"""Retrieval for batches of queries: exact vector and BM25 top-k, rank fusion, reranking, merging into parents, context.

Every operator takes all queries at once. Ranking keeps the best k of each query before anything is shuffled
(Spark limits window groups on the map side), so a shuffle moves k rows a query and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import snippet, tokens_of_context
from ..functions.vectors import cosine
from ..sources.tables import new_dir
from . import nearest, postings
from .nearest import VectorIndex
from .postings import Postings

#: Candidates that each path gives to fusion.
POOL = 20
#: Constant of reciprocal rank fusion.
RRF_K = 60


def ranked(df: DataFrame, by: Column, k: int | None, id_col: str = "chunk_id", name: str = "rank") -> DataFrame:
    """Numbers each query's rows from 1 by ``by`` descending, ties to the smaller id, and keeps k."""
    out = df.withColumn(name, F.row_number().over(W.partitionBy("query_id").orderBy(by.desc(), id_col)))
    return out.filter(F.col(name) <= k) if k else out


def vector_topk(rows: DataFrame | VectorIndex, queries: DataFrame, k: int = POOL, same: str | None = None) -> DataFrame:
    """rows: (chunk_id, vector[, same]), or their stored index; queries: (query_id, vector[, same]). Inner product, exact.

    ``same`` names a column that must agree (a knowledge base). Rows without an index get one first.
    """
    index = rows if isinstance(rows, VectorIndex) else nearest.build(rows, new_dir(rows.sparkSession, "vectors"), same)
    return nearest.search(index, queries, k, same)


def bm25_topk(rows: DataFrame | Postings, queries: DataFrame, k: int = POOL, same: str | None = None) -> DataFrame:
    """rows: (chunk_id, content[, same]), or their stored index; queries: (query_id, query[, same]). A query's distinct terms, any of them; document statistics over all rows."""
    index = rows if isinstance(rows, Postings) else postings.build(rows, new_dir(rows.sparkSession, "postings"), same)
    return postings.search(index, queries, k, same)


def rrf(*paths: DataFrame, k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """paths: (query_id, chunk_id, rank). Sum of 1 / (constant + rank); a missing path adds nothing."""
    union = paths[0].select("query_id", "chunk_id", "rank")
    for p in paths[1:]:
        union = union.unionByName(p.select("query_id", "chunk_id", "rank"))
    fused = union.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"), F.count(F.lit(1)).alias("paths"))
    return ranked(fused, F.col("score"), k)


def hybrid(rows: DataFrame, queries: DataFrame, pool: int = POOL, k: int | None = None) -> DataFrame:
    """rows: (chunk_id, content, vector); queries: (query_id, query, vector)."""
    return rrf(vector_topk(rows.filter("vector is not null"), queries, pool), bm25_topk(rows, queries, pool), k=k)


def rerank_cosine(hits: DataFrame, rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Orders hits by cosine of query and row (0 without a vector); the old score stays beside the new relevance."""
    with_rows = hits.select("query_id", "chunk_id", "score").join(rows.select("chunk_id", "vector"), "chunk_id", "left")
    both = with_rows.join(queries.select("query_id", F.col("vector").alias("__q")), "query_id")
    relevance = F.round(F.coalesce(cosine(F.col("__q"), F.col("vector")), F.lit(0.0)), 6)
    return ranked(both.select("query_id", "chunk_id", "score", relevance.alias("relevance")), F.col("relevance"), k)


def rerank_scores(hits: DataFrame, scores: DataFrame, k: int = 10, least: int = 2) -> DataFrame:
    """scores: (query_id, chunk_id, new_score) from a model. Queries with at most ``least`` hits stay as they are."""
    n = F.count(F.lit(1)).over(W.partitionBy("query_id"))
    joined = hits.withColumn("__n", n).join(scores, ["query_id", "chunk_id"], "left")
    relevance = F.when(F.col("__n") <= least, F.col("score")).otherwise(F.coalesce("new_score", "score"))
    return ranked(joined.select("query_id", "chunk_id", "score", relevance.alias("relevance")), F.col("relevance"), k)


def auto_merge(hits: DataFrame, ratio: float = 0.5, least: int = 2, k: int | None = None) -> DataFrame:
    """hits: (query_id, chunk_id string, parent string, siblings, score, content). Enough leaves of a parent become the parent.

    Merged when hits / siblings >= ratio and at least ``least`` are hit; its score is the mean times (hits / siblings + 0.5).
    """
    parent = F.coalesce("parent", "chunk_id")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("chunk_id"), F.col("content"), F.col("score"))))
    grouped = hits.groupBy("query_id", parent.alias("parent"), F.col("parent").isNotNull().alias("has_parent")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.coalesce("siblings", F.lit(1))).alias("siblings"), F.avg("score").alias("mean"), ordered.alias("members")
    )
    hit = F.col("n") / F.greatest(F.col("siblings"), F.lit(1))
    merge = F.col("has_parent") & (hit >= ratio) & (F.col("n") >= least)
    one = F.array(F.struct(F.col("parent").alias("chunk_id"), F.round(hit * F.col("mean") + 0.5 * F.col("mean"), 6).alias("score"), F.array_join(F.col("members.content"), " ").alias("content"), F.col("n").alias("merged_from")))
    leaves = F.transform("members", lambda m: F.struct(m["chunk_id"].alias("chunk_id"), F.round(m["score"], 6).alias("score"), m["content"].alias("content"), F.lit(1).cast("long").alias("merged_from")))
    flat = grouped.select("query_id", F.explode(F.when(merge, one).otherwise(leaves)).alias("m")).select("query_id", "m.*")
    return ranked(flat, F.col("score"), k)


def expand_window(hits: DataFrame) -> DataFrame:
    """Leaves with a window take it as content; original_content keeps theirs."""
    use = (F.col("level") == "leaf") & F.col("window_content").isNotNull() & (F.col("window_content") != "")
    return hits.withColumn("original_content", F.when(use, F.col("content"))).withColumn("window_applied", F.coalesce(use, F.lit(False))).withColumn("content", F.when(use, F.col("window_content")).otherwise(F.col("content")))


def context_budget(hits: DataFrame, budget: int = 4000) -> DataFrame:
    """hits: (query_id, chunk_id, rank, content). The longest prefix by rank within the budget; the first always stays."""
    order = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    sized = hits.withColumn("tokens", tokens_of_context(F.col("content"))).withColumn("cumulative", F.sum("tokens").over(order))
    return sized.filter((F.col("cumulative") <= budget) | (F.col("rank") == 1))


def context_text(hits: DataFrame) -> DataFrame:
    """One text per query, each source under its mark."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "content")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("【文档】"), x["content"])), "\n\n")
    return hits.groupBy("query_id").agg(F.regexp_replace(text, r"\s+$", "").alias("context"))


def citations(hits: DataFrame, most: int = 200) -> DataFrame:
    """(query_id, rank, chunk_id, snippet, score)."""
    return hits.select("query_id", "rank", "chunk_id", snippet(F.col("content"), most).alias("snippet"), "score")


def first_sources(hits: DataFrame, n: int = 5) -> DataFrame:
    """The first n different chunks of each query by first rank, over all actions."""
    first = hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("first_rank"))
    return first.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("first_rank", "chunk_id"))).filter(F.col("place") <= n)


def golden_hits(rows: DataFrame, golden: DataFrame, edge: int = 60) -> DataFrame:
    """rows: (chunk_id, content); golden: (item_id, passage). Pairs where a row holds the passage, its first or its last ``edge`` characters.

    A row and an edge share the edge's inner words, so pairs meet on hashes of three words in a row; passages
    whose edges have fewer inner words meet on one. What meets is verified.
    """
    edges = F.array(F.substring("passage", 1, edge), F.right("passage", F.lit(edge)))
    cut = golden.select("item_id", "passage", F.explode(edges).alias("edge")).withColumn("inner", F.slice(F.split("edge", " "), 2, 10_000))
    inner = F.slice("inner", 1, F.greatest(F.size("inner") - 1, F.lit(0)))
    keyed = cut.withColumn("inner", inner).select("item_id", "edge", F.when(F.size("inner") >= 3, F.xxhash64(F.array_join(F.slice("inner", 1, 3), " "))).otherwise(F.xxhash64(F.try_element_at("inner", F.lit(1)))).alias("key"), (F.size("inner") >= 3).alias("three"))
    words = rows.select("chunk_id", F.split("content", " ").alias("w")).filter(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.size("w"))
    grams = F.array_union(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("w", i, 3), " "))), F.transform("w", lambda x: F.xxhash64(x)))
    met = words.select("chunk_id", F.explode(F.array_distinct(grams)).alias("key")).join(F.broadcast(keyed.select("item_id", "edge", "key")) if golden.count() <= 10_000 else keyed.select("item_id", "edge", "key"), "key").select("chunk_id", "item_id", "edge").distinct()
    return met.join(rows, "chunk_id").filter(F.contains("content", F.col("edge"))).select("chunk_id", "item_id").distinct()


def search_with_rerank(rows: DataFrame | VectorIndex, queries: DataFrame, scores: DataFrame | None = None, k: int = 10, pool: int = POOL, strict_limit: bool = True) -> DataFrame:
    """A vector pool, reordered by a model's scores (query_id, chunk_id, new_score). Without scores the pool stays as it is, cut to k only if strict_limit."""
    hits = vector_topk(rows, queries, pool)
    if scores is None:
        plain = hits.withColumn("relevance", F.col("score"))
        return plain.filter(F.col("rank") <= k) if strict_limit else plain
    return rerank_scores(hits, scores, k)


def hierarchical(leaves: DataFrame, hits: DataFrame, k: int = POOL) -> DataFrame:
    """hits: (query_id, chunk_id, score), 3 * k a query at best; leaves: (chunk_id, parent, siblings, level, content, window_content).

    Leaves whose parents are hit often enough become the parent (2 * k stay); single leaves take their window; best k.
    """
    known = hits.select("query_id", "chunk_id", "score").join(leaves, "chunk_id")
    merged = auto_merge(known.select("query_id", "chunk_id", "parent", "siblings", "score", "content"), k=2 * k).drop("rank")
    windows = merged.join(leaves.select("chunk_id", "level", "window_content"), "chunk_id", "left")
    expanded = expand_window(windows)
    return ranked(expanded.select("query_id", "chunk_id", "score", "content", "merged_from", "window_applied"), F.col("score"), k)


def route(candidates: dict[str, DataFrame], strategy: str, scores: DataFrame | None = None, k: int = 10) -> DataFrame:
    """The candidates of the strategy ("hierarchical" or "hybrid", which is also taken for any other name), all of them reordered by the scores if given, then the best k."""
    hits = candidates["hierarchical" if strategy == "hierarchical" and "hierarchical" in candidates else "hybrid"].select("query_id", "chunk_id", "score")
    if scores is None:
        return ranked(hits.withColumn("relevance", F.col("score")), F.col("score"), k)
    return rerank_scores(hits, scores, k)


def understood(messages: DataFrame, rules: list) -> DataFrame:
    """messages: (query_id, message, condensed, expansions). (query_id, query, steps): each step falls back to the one before; what a model gave is a column, null where it failed."""
    from .language import map_terms

    stands = F.coalesce(F.trim("condensed") != "", F.lit(False))
    said = F.when(stands, F.col("condensed")).otherwise(F.col("message"))  # as the model gave it, blanks at its ends too
    mapped = map_terms(said, rules)
    more = F.coalesce("expansions", F.array().cast("array<string>"))
    steps = F.concat(F.when(stands, F.array(F.lit("condense"))).otherwise(F.array().cast("array<string>")), F.when(mapped != said, F.array(F.lit("map"))).otherwise(F.array().cast("array<string>")), F.when(F.size(more) > 0, F.array(F.lit("expand"))).otherwise(F.array().cast("array<string>")))
    return messages.select("query_id", F.concat_ws(" ", mapped, more).alias("query"), steps.alias("steps"))


def retrieval_context(messages: DataFrame, rules: list, rows: DataFrame, vectors: DataFrame, asked: DataFrame, k: int = 5, budget: int = 4000, indexes: tuple[VectorIndex, Postings] | None = None) -> DataFrame:
    """The whole path of a message: understood, searched both ways, reordered by cosine, cut to the budget. (query_id, steps, sources, context); a message without sources has none and an empty context.

    rows: (chunk_id, content); vectors: (chunk_id, vector); asked: (query_id, vector); indexes: those of vectors and rows, if stored.
    """
    queries = understood(messages, rules)
    vector_index, text_index = indexes or (vectors, rows)
    hits = rrf(vector_topk(vector_index, asked, POOL), bm25_topk(text_index, queries, POOL))
    best = rerank_cosine(hits.drop("rank"), vectors, asked, k)
    kept = context_budget(best.join(rows.select("chunk_id", F.coalesce("content", F.lit("")).alias("content")), "chunk_id"), budget)
    found = kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("sources")).join(context_text(kept), "query_id")
    return queries.select("query_id", "steps").join(found, "query_id", "left").select("query_id", F.when(F.col("sources").isNull(), F.col("steps")).otherwise(F.concat("steps", F.array(F.lit("retrieve")))).alias("steps"), F.coalesce("sources", F.array()).alias("sources"), F.coalesce("context", F.lit("")).alias("context"))


def knowledge_action(hits: DataFrame) -> DataFrame:
    """The answer of the knowledge action: every hit (query_id, rank, chunk_id, content) as a line [id] content, best first."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content")))
    lines = F.transform(ordered, lambda x: F.concat(F.lit("["), x["chunk_id"].cast("string"), F.lit("] "), F.coalesce(x["content"], F.lit(""))))
    return hits.groupBy("query_id").agg(F.array_join(lines, "\n").alias("answer"))
