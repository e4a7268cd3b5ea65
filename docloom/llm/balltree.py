"""Exact top-k search by inner product: ball trees per shard, branch and bound.

Vectors are dealt to shards of about ``shard_rows`` rows by hash; each shard builds a tree of balls (centre,
radius) and is written once. Queries come in blocks, which stream past the tree of the shard they ask. A node's score is at most q . centre + |q| * radius;
nodes are taken in order of that bound and the search of a query ends when the best open bound falls under
its kth score. Each block first searches one home shard; the kth scores found there go with the queries to
all other shards, whose roots and subtrees are cut by them from the start.

Defined cases: vectors that are null or hold null, non-finite or no components take no part; vectors of
other lengths are only compared with their like; ties go to the smaller vec_id; rows that repeat a vec_id
count as rows of their own but never against a query of their id, and queries that repeat an id share its
k places; fewer candidates than k give them all; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, written

LEAF = 128
SHARD_ROWS = 8_192
BLOCK_ROWS = 1_024


class BallTree:
    """Nodes in arrays: centre, radius, the rows [lo, hi) of the reordered vectors, and the left child (right follows; -1: leaf)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], vectors[order]
        centre, radius, span, child = [], [], [], []

        def add(lo: int, hi: int) -> int:
            v = self.vectors[lo:hi]
            c = v.mean(axis=0)
            centre.append(c)
            radius.append(float(np.sqrt(((v - c) ** 2).sum(axis=1).max())))
            span.append((lo, hi))
            child.append(-1)
            return len(span) - 1

        queue = [add(0, len(ids))] if len(ids) else []
        for node in queue:
            lo, hi = span[node]
            if hi - lo <= leaf or radius[node] == 0:
                continue
            v = self.vectors[lo:hi]
            a = v[((v - centre[node]) ** 2).sum(axis=1).argmax()]
            b = v[((v - a) ** 2).sum(axis=1).argmax()]
            by = np.argsort(v @ (b - a), kind="stable")
            self.vectors[lo:hi], self.ids[lo:hi] = v[by], self.ids[lo:hi][by]
            half = lo + (hi - lo) // 2
            child[node] = add(lo, half)
            queue += [child[node], add(half, hi)]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.span, self.child = span, child

    def search(self, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its up to k best (index, ids, scores) that reach floor, its kth score so far (-inf: none)."""
        norms = np.sqrt((queries**2).sum(axis=1))
        bounds = queries @ self.centre.T + norms[:, None] * self.radius[None, :]
        bounds += 1e-9 * (1 + np.abs(bounds))
        for i in range(len(queries)):
            kth, q, own, ub = floor[i], queries[i], query_ids[i], bounds[i].tolist()
            best_ids, best = np.empty(0, np.int64), np.empty(0)
            open_nodes = [(-ub[0], 0)]
            while open_nodes:
                bound, node = heapq.heappop(open_nodes)
                if -bound < kth:
                    break
                if (c := self.child[node]) >= 0:
                    heapq.heappush(open_nodes, (-ub[c], c))
                    heapq.heappush(open_nodes, (-ub[c + 1], c + 1))
                    continue
                lo, hi = self.span[node]
                scores, ids = self.vectors[lo:hi] @ q, self.ids[lo:hi]
                good = (scores >= kth) & (ids != own)
                if good.any():
                    best, best_ids = np.concatenate([best, scores[good]]), np.concatenate([best_ids, ids[good]])
                    if len(best) > k:
                        top = np.lexsort((best_ids, -best))[:k]
                        best, best_ids = best[top], best_ids[top]
                    if len(best) >= k:
                        kth = max(kth, best.min())
            if len(best):
                yield i, best_ids, best


def usable(vectors: DataFrame, id_col: str, vec_col: str, component: Column | None = None) -> DataFrame:
    """(id, v array<double>) of the vectors that take part, each component mapped if asked for."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)


def _matrix(lists: pd.Series) -> np.ndarray:
    return np.array(lists.tolist(), dtype=np.float64)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, leaf: int = LEAF) -> DataFrame:
    """rows, queries: (id, v array<double>). Returns query_id, rank, vec_id, score."""
    rows, queries = rows.withColumn("dim", F.size("v")), queries.withColumn("dim", F.size("v"))
    n, m = rows.count(), queries.count()
    shards, n_blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(pdf.id.to_numpy(np.int64), _matrix(pdf.v), leaf)
        return pd.DataFrame({"dim": pdf.dim.iloc[:1], "shard": pdf["shard"].iloc[:1], "tree": [pickle.dumps(tree)]})

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": pdf.dim.iloc[:1], "block": pdf["block"].iloc[:1], "ids": [pdf.id.to_numpy(np.int64).tobytes()], "queries": [_matrix(pdf.v).tobytes()]})

    trees = written(rows.withColumn("shard", deal(shards)).groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary"), "trees")
    blocks = written(queries.withColumn("block", deal(n_blocks)).groupBy("dim", "block").applyInPandas(block, "dim int, block int, ids binary, queries binary"), "query-blocks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = held = None
        for pdf in batches:
            for r in pdf.itertuples():
                if r.tree is not None:  # sorted first: the tree that the blocks after it ask
                    tree, held = pickle.loads(r.tree), (r.dim, r.shard)
                    continue
                if held != (r.dim, r.shard):  # no vectors of that length in the shard
                    continue
                ids = np.frombuffer(r.ids, np.int64)
                q, floor = np.frombuffer(r.queries).reshape(len(ids), r.dim), np.full(len(ids), -np.inf)
                if r.floors is not None:
                    at = dict(zip(np.frombuffer(r.floor_ids, np.int64).tolist(), np.frombuffer(r.floors).tolist(), strict=True))
                    floor = np.array([at.get(i, -np.inf) for i in ids.tolist()])
                out = [(np.full(len(found), ids[i]), found, scores) for i, found, scores in tree.search(q, ids, floor, k)]
                if out:
                    yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    def searched(asking: DataFrame, asked: DataFrame) -> DataFrame:
        """asking: (dim, shard, block, ids, queries, floor_ids, floors); asked: the trees. A shard's tree is loaded once and the blocks that ask it stream past it."""
        nothing = [F.lit(None).cast(asking.schema[c].dataType).alias(c) for c in asking.columns if c not in ("dim", "shard")]
        both = asked.select("dim", "shard", *nothing, "tree").unionByName(asking.withColumn("tree", F.lit(None).cast("binary")))
        dealt = both.repartition(partitions(rows.sparkSession), "dim", "shard").sortWithinPartitions("dim", "shard", F.col("block").asc_nulls_first())
        return dealt.mapInPandas(run, "query_id long, vec_id long, score double")

    none = [F.lit(None).cast("binary").alias(c) for c in ("floor_ids", "floors")]
    home = F.pmod("block", F.lit(shards)).cast("int")
    found = written(searched(blocks.select("*", home.alias("shard"), *none), trees.filter(F.col("shard") < n_blocks)), "home")
    if shards > 1:

        def kths(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "floor_ids": [pdf.query_id.to_numpy(np.int64).tobytes()], "floors": [pdf.kth.to_numpy(float).tobytes()]})

        kth = found.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        floors = kth.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")).groupBy("block").applyInPandas(kths, "block int, floor_ids binary, floors binary")
        others = blocks.join(floors, "block", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter(F.col("shard") != home)
        found = found.unionByName(searched(others, trees))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """Components become floor(scale * x); queries are the rows whose vec_id is divisible by every."""
    rows = usable(embeddings, "vec_id", "embedding")
    rows = written(rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double"))), "integers")
    return top_k(rows, rows.filter(F.pmod("id", F.lit(every)) == 0), k).withColumn("score", F.col("score").cast("long"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
