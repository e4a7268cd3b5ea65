"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is two aggregations and joins over the links; hot nodes are aggregated with partial sums and
their joins may be split by Spark. Rounds are written to the shared folder, so a lost executor costs one
round at most. Links are first thinned inside each partition to a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the links a-b, for the nodes that are not the smallest themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (root[root] != root).any():
            root = root[root]
        if (root[u] == root[v]).all():
            break
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


def thinned(links: DataFrame, batch: int = 500_000) -> DataFrame:
    """(a, b) with the same components as before, at most one link a node and batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= batch:
                whole = pd.concat(held)
                x, y = forest(whole.a.to_numpy(np.int64), whole.b.to_numpy(np.int64))
                yield pd.DataFrame({"a": x, "b": y})
                held, n = [], 0
        if n:
            whole = pd.concat(held)
            x, y = forest(whole.a.to_numpy(np.int64), whole.b.to_numpy(np.int64))
            yield pd.DataFrame({"a": x, "b": y})

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInPandas(run, "a long, b long")


def components(links: DataFrame, most_rounds: int = 60, thin: bool = True) -> DataFrame:
    """links: (a, b). Returns (node, component) of the linked nodes; component is the smallest node reachable. thin: not needed for links that are forests already."""
    now = written((thinned(links) if thin else links.filter("a <> b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, written(small.unionByName(down.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "links")
        discard(before)
        got = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.count_distinct("a").alias("nodes")).first()
        if got["n"] == got["nodes"] and now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        if (got["n"], got["h"]) == state:
            raise RuntimeError("rounds no longer change the links")
        state = (got["n"], got["h"])
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
