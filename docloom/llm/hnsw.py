"""Embedding near-dedup: navigable small-world graphs per shard, audited, cosines verified, components united.

Equal vectors of a label become one node with a weight. The nodes of a label are dealt to shards of about
``shard_rows``; every shard builds a layered graph, and the nodes query every shard of their label: within a
shard each its own graph, between two shards those of the one the graph of the other, so that a pair counts for
both ends or none. A search by beam finds the way to the threshold; from its hits a block of queries goes on
along the graph while new places are within the threshold, so dense groups are found whole. An audit compares
queries that have links with brute force over the shard, themselves left out, and doubles the beam until their
mean recall reaches ``audit_recall``; what it reached is returned. Every pair is verified by its cosine in double
precision before it counts.

Within a shard, links become counts and local components; between shards only (node, component) links travel,
never all pairs. Each shard's graph is loaded once and the blocks of queries pass through.

Defined cases: vectors that are null, zero, or hold null, non-finite or no components, and those with a null
label or vec_id, link with nothing and are components of their own (component null for a null id); lengths
are only compared with their like; equal vectors link with each other; rows that share a vec_id count as
vectors of their own in n_links, and as one node of the components; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written
from .components import components, forest

M = 12
BUILD_BEAM = 32
SHARD_ROWS = 16_384
QUERY_BLOCK = 512


class Graph:
    """Layers of neighbour tables over unit vectors. Points arrive in batches no larger than what stands; a batch also sees itself."""

    def __init__(self, unit: np.ndarray, m: int = M, beam: int = BUILD_BEAM, batch: int = QUERY_BLOCK):
        n = len(unit)
        self.unit = unit
        rng = np.random.default_rng(7)
        level = np.minimum((-np.log(1 - rng.random(n)) / math.log(m)).astype(int), 6)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        for layer in range(int(level.max()) + 1 if n else 0):
            members = np.flatnonzero(level >= layer)
            self.layers.append((members, self._connect(unit[members], 2 * m if layer == 0 else m, beam, batch)))

    @staticmethod
    def _connect(unit: np.ndarray, degree: int, beam: int, batch: int) -> np.ndarray:
        """The neighbour table of one layer, -1 for none: a point links to its nearest, half of its places at first; the rest is for what links back."""
        n = len(unit)
        near = np.full((n, degree), -1, np.int64)
        done = 0
        while done < n:
            size = min(batch, max(64, done), n - done)
            new = np.arange(done, done + size)
            sims = unit[new] @ unit[new].T
            np.fill_diagonal(sims, -2)
            cand = np.broadcast_to(new, (size, size))
            if done:
                found, score = beam_search(unit, near, unit[new], beam, entries(done))
                cand, sims = np.concatenate([cand, found], axis=1), np.concatenate([sims, score], axis=1)
            keep = min(degree // 2, cand.shape[1])
            best = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
            ids, s = np.take_along_axis(cand, best, 1), np.take_along_axis(sims, best, 1)
            ids = np.where(s > -2, ids, -1)
            near[new, :keep] = ids
            back_to, back_from = ids.ravel(), np.repeat(new, keep)
            ok = back_to >= 0
            add_back(unit, near, back_to[ok], back_from[ok], s.ravel()[ok])
            done += size
        return near

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the beam's best per query, best first (-1 and -2 for none)."""
        start = None
        for members, near in reversed(self.layers[1:]):
            entry = entries(len(members)) if start is None else np.searchsorted(members, start)
            found, _ = beam_search(self.unit[members], near, queries, 4, entry)
            start = members[np.maximum(found[:, :2], 0)]
        members, near = self.layers[0]
        spread = np.broadcast_to(entries(len(members)), (len(queries), len(entries(len(members)))))
        entry = spread if start is None else np.concatenate([start, spread], axis=1)
        return beam_search(self.unit, near, queries, beam, entry)


def entries(n: int) -> np.ndarray:
    """A few starting points spread over the points 0 to n - 1."""
    return np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))


def add_back(unit: np.ndarray, near: np.ndarray, to: np.ndarray, source: np.ndarray, cosine: np.ndarray) -> None:
    """Links back: each target keeps the nearest of its places and the newcomers, and a quarter of its places for the farthest, so that dense groups stay reachable from outside."""
    degree = near.shape[1]
    order = np.lexsort((-cosine, to))
    to, source = to[order], source[order]
    targets, begin, count = np.unique(to, return_index=True, return_counts=True)
    # A target has room for degree newcomers: the nearest ones are looked at.
    width = int(min(count.max(), degree)) if len(count) else 0
    if not width:
        return
    place = np.arange(width)
    pick = begin[:, None] + np.minimum(place[None, :], count[:, None] - 1)
    fresh = np.where(place[None, :] < count[:, None], source[pick], -1)
    both = np.concatenate([near[targets], fresh], axis=1)
    sims = np.einsum("ijk,ik->ij", unit[np.maximum(both, 0)], unit[targets])
    sims[both < 0] = -2
    ordered = np.sort(np.where(both < 0, -1, both), axis=1)
    by_id = np.argsort(both, axis=1, kind="stable")
    repeat = np.zeros_like(both, bool)
    np.put_along_axis(repeat, by_id[:, 1:], (ordered[:, 1:] == ordered[:, :-1]), axis=1)
    sims[repeat] = -2
    order = np.argsort(-sims, axis=1, kind="stable")
    held, far = (sims > -2).sum(axis=1), degree // 4
    take = np.arange(degree)[None, :]
    take = np.where((take >= degree - far) & (held > degree)[:, None], held[:, None] - degree + take, take)
    best = np.take_along_axis(order, take, 1)
    kept = np.take_along_axis(both, best, 1)
    near[targets] = np.where(np.take_along_axis(sims, best, 1) > -2, kept, -1)


def beam_search(unit: np.ndarray, near: np.ndarray, queries: np.ndarray, beam: int, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All queries hop together: each expands its best unexpanded place until none is left."""
    n = len(queries)
    if entry.ndim == 1:
        entry = np.broadcast_to(entry, (n, len(entry)))
    ids = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -2.0)
    seen = np.ones((n, beam), bool)
    fresh = np.sort(entry, axis=1)
    fresh = np.where(np.concatenate([np.zeros((n, 1), bool), fresh[:, 1:] == fresh[:, :-1]], axis=1), -1, fresh)
    live = np.arange(n)
    while len(live):
        s = np.einsum("ijk,ik->ij", unit[np.maximum(fresh, 0)], queries[live])
        s[fresh < 0] = -2
        s[(fresh[:, :, None] == ids[live][:, None, :]).any(axis=2)] = -2
        all_ids, all_s = np.concatenate([ids[live], fresh], axis=1), np.concatenate([sims[live], s], axis=1)
        all_seen = np.concatenate([seen[live], s <= -2], axis=1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam] if all_s.shape[1] > beam else np.broadcast_to(np.arange(all_s.shape[1]), all_s.shape)
        ids[live], sims[live], seen[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_s, all_seen))
        open_s = np.where(seen[live], -3.0, sims[live])
        at = open_s.argmax(axis=1)
        more = open_s[np.arange(len(live)), at] > -2
        live, at = live[more], at[more]
        seen[live, at] = True
        fresh = near[ids[live, at]]
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(sims > -2, ids, -1), sims


def found_from(graph: Graph, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs with cosine >= threshold for a block of queries: hits of a beam search, and what the graph leads to from hits."""
    near, near_by = graph.layers[0][1], threshold - 1e-9
    ids, sims = graph.search(queries, beam)
    seen = np.zeros(len(graph.unit), bool)
    fresh = np.unique(ids[sims >= near_by])
    seen[fresh] = True
    pairs = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    while len(fresh):
        hits = []
        for x in range(0, len(fresh), 4_096):
            some = fresh[x : x + 4_096]
            q, at = np.nonzero(queries @ graph.unit[some].T >= near_by)
            pairs.append((q, some[at]))
            hits.append(some[np.unique(at)])
        ahead = np.unique(near[np.concatenate(hits)])
        ahead = ahead[ahead >= 0]
        fresh = ahead[~seen[ahead]]
        seen[fresh] = True
    q, row = (np.concatenate(x) for x in zip(*pairs, strict=True))
    exact = np.empty(len(q), bool)
    for x in range(0, len(q), 200_000):
        part = slice(x, x + 200_000)
        exact[part] = np.einsum("ij,ij->i", queries[q[part]], graph.unit[row[part]]) >= threshold
    return q[exact], row[exact]


def audited(graph: Graph, queries: np.ndarray, own: bool, threshold: float, beam: int, audit_recall: float = 0.98, audit: int = 64) -> tuple[int, float | None]:
    """(beam, recall): the beam with which queries that have links find audit_recall of them on average. own: the queries are the graph's points, and a point is no link of itself.

    One query in ``audit`` is probed, 64 at least; while fewer than 16 of them have links, four times as many, up to one in four.
    """
    n, size = len(queries), len(graph.unit)
    number = min(n, max(64, n // audit))
    while True:
        probe = np.unique(np.linspace(0, n - 1, number).astype(int))
        truth = np.stack(np.nonzero(queries[probe] @ graph.unit.T >= threshold), axis=1)
        if own:
            truth = truth[probe[truth[:, 0]] != truth[:, 1]]
        linked = np.unique(truth[:, 0])
        if len(linked) >= 16 or number >= max(64, n // 4) or number == n:
            break
        number = min(n, number * 4)
    if not len(linked):
        return beam, None
    probe = probe[linked]
    want = np.bincount(np.searchsorted(linked, truth[:, 0]), minlength=len(linked))
    while True:
        got = np.zeros(len(probe))
        for x in range(0, len(probe), QUERY_BLOCK):
            part = probe[x : x + QUERY_BLOCK]
            q, row = found_from(graph, queries[part], threshold, beam)
            other = part[q] != row if own else np.ones(len(q), bool)
            got[x : x + QUERY_BLOCK] = np.bincount(q[other], minlength=len(part))
        recall = float(np.minimum(1, got / want).mean())
        if recall >= audit_recall or beam >= size:
            return beam, recall
        beam *= 2


def neighbours(graph: Graph, queries: np.ndarray, threshold: float, beam: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first query, query, row) of each block of queries."""
    for x in range(0, len(queries), QUERY_BLOCK):
        q, row = found_from(graph, queries[x : x + QUERY_BLOCK], threshold, beam)
        yield x, q + x, row


def both_ways(bits: np.ndarray, n: int, step: int = 2_048) -> np.ndarray:
    """Adjacency as bits, made symmetric tile by tile."""
    for i in range(0, n, step):
        for j in range(0, i + step, step):
            a = np.unpackbits(bits[i : i + step, j // 8 : (j + step) // 8], axis=1).astype(bool)
            b = np.unpackbits(bits[j : j + step, i // 8 : (i + step) // 8], axis=1).astype(bool)
            either = a[:, : len(b)] | b[:, : len(a)].T
            bits[i : i + step, j // 8 : (j + step) // 8] = np.packbits(either, axis=1)
            bits[j : j + step, i // 8 : (i + step) // 8] = np.packbits(either.T, axis=1)
    return bits


def linked_within(unit: np.ndarray, weight: np.ndarray, threshold: float, beam: int) -> tuple[Graph, np.ndarray, np.ndarray, float | None]:
    """The graph of a shard, and for each node the weight of its links (its own copies as well), the first node of its local component, and the audit's recall."""
    n = len(unit)
    graph = Graph(unit)
    beam, recall = audited(graph, unit, True, threshold, beam)
    bits, edges = np.zeros((n, -(-n // 8)), np.uint8), [np.empty((0, 2), np.int64)]
    for first, q, row in neighbours(graph, unit, threshold, beam):
        hit = np.zeros((min(QUERY_BLOCK, n - first), n), bool)
        hit[q - first, row] = True
        bits[first : first + len(hit)] = np.packbits(hit, axis=1)
        other = q != row
        edges.append(np.stack(forest(q[other], row[other]), axis=1) if other.any() else edges[0])
    bits = both_ways(bits, n)
    links = np.empty(n, np.int64)
    for x in range(0, n, QUERY_BLOCK):
        links[x : x + QUERY_BLOCK] = np.unpackbits(bits[x : x + QUERY_BLOCK], axis=1, count=n) @ weight
    own = np.unpackbits(bits, axis=1, count=n)[np.arange(n), np.arange(n)] if n <= QUERY_BLOCK else (bits[np.arange(n), np.arange(n) // 8] >> (7 - np.arange(n) % 8).astype(np.uint8)) & 1
    links += np.where(own > 0, -1, weight - 1)
    pairs, root = np.concatenate(edges), np.arange(n)
    node, least = forest(pairs[:, 0], pairs[:, 1])
    root[node] = least
    return graph, links, root, recall


def unit_rows(vectors: pd.Series) -> np.ndarray:
    v = np.array(vectors.tolist(), np.float64)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, shard_rows: int = SHARD_ROWS, beam: int = 24) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, recall (what the audit of its node's shard reached; null: no probed node had links)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    whole = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    rows = written(rows.withColumn("takes", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole, F.lit(False))), "vectors")
    takes = rows.filter("takes")
    # Equal vectors are one node: summed up before the shuffle, so a vector that a third of all rows hold is one row a task.
    nodes = takes.groupBy("label", "v").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "label", F.size("v").alias("dim"), "v", "weight", "least"), "nodes")
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("shards"))
    dealt = written(nodes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), "shards").cast("int")), "dealt")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("least", kind="stable")
        ids, weight = pdf["node"].to_numpy(np.int64), pdf["weight"].to_numpy(np.int64)
        graph, links, root, recall = linked_within(unit_rows(pdf["v"]), weight, threshold, beam)
        first = pdf.iloc[0]
        own = pd.DataFrame({"label": first["label"], "dim": first["dim"], "shard": first["shard"], "node": ids, "n_links": links, "other": ids[root], "recall": recall, "graph": None})
        if first["shards"] == 1:
            return own
        blob = pickle.dumps((graph, ids, weight, root))
        return pd.concat([own, pd.DataFrame({"label": [first["label"]], "dim": [first["dim"]], "shard": [first["shard"]], "node": [None], "n_links": [0], "other": [None], "recall": [None], "graph": [blob]})])

    label = dict(embeddings.dtypes)["label"]
    built = written(dealt.groupBy("label", "dim", "shard").applyInPandas(build, f"label {label}, dim int, shard int, node long, n_links long, other long, recall double, graph binary"), "graphs")
    found = built.filter("graph is null").select("node", "n_links", "other", "recall")
    graphs = built.filter("graph is not null").select("label", "dim", "shard", "graph")
    if graphs.limit(1).count():
        found = written(found.unionByName(_between(dealt, graphs, threshold, beam)), "found")
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"), F.min("recall").alias("recall"))
    least = nodes.select("node", "least")
    linked = found.filter("other <> node").select("node", "other").distinct().join(least, "node").join(least.select(F.col("node").alias("other"), F.col("least").alias("b")), "other")
    named = written(nodes.join(counts, "node").select("label", "v", "least", "n_links", "recall", "weight"), "counts")
    known = takes.join(named, ["label", "v"])
    members = known.filter("weight > 1").select(F.col("vec_id").alias("a"), F.col("least").alias("b"))
    classes = components(linked.select(F.col("least").alias("a"), "b").unionByName(members)).withColumnRenamed("node", "vec_id")
    alone = rows.filter(~F.col("takes")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("double").alias("recall"))
    out = known.select("vec_id", "n_links", "recall").unionByName(alone).join(classes, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), (F.col("vec_id") == component).alias("kept"), "recall")


def _between(dealt: DataFrame, graphs: DataFrame, threshold: float, beam: int, block_rows: int = 1_024) -> DataFrame:
    """Nodes of each shard against the graphs of the later shards of their label: counts for both ends, and links to the components found there."""
    label = dict(dealt.dtypes)["label"]
    keys = ["label", "dim", "to", "block"]
    pieces = F.lit(max(1, SHARD_ROWS // block_rows))
    blocked = dealt.filter("shards > 1").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), pieces).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        return pd.DataFrame({"label": [first["label"]], "dim": [first["dim"]], "shard": [first["shard"]], "shards": [first["shards"]], "data": [pickle.dumps((pdf["node"].to_numpy(np.int64), pdf["weight"].to_numpy(np.int64), unit_rows(pdf["v"])))]})

    blocks = blocked.groupBy("label", "dim", "shard", "block").applyInPandas(pack, f"label {label}, dim int, shard int, shards int, data binary")
    asking = blocks.filter("shard < shards - 1").withColumn("to", F.explode(F.sequence(F.col("shard") + 1, F.col("shards") - 1)))
    asking = asking.select("label", "dim", "to", F.lit(1).alias("block"), "data")
    both = graphs.select("label", "dim", F.col("shard").alias("to"), F.lit(0).alias("block"), F.col("graph").alias("data")).unionByName(asking)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, data in zip(pdf["block"], pdf["data"], strict=True):
                if block == 0:  # sorted first: the graph that the blocks after it ask
                    graph, there, weight, root = pickle.loads(data)
                    wide = None
                    continue
                ids, own_weight, unit = pickle.loads(data)
                if wide is None:
                    wide, recall = audited(graph, unit, False, threshold, beam)
                links, back, edges = np.zeros(len(ids)), np.zeros(len(there)), [np.empty((0, 2), np.int64)]
                for _, q, row in neighbours(graph, unit, threshold, wide):
                    links += np.bincount(q, weight[row], len(ids))
                    back += np.bincount(row, own_weight[q], len(there))
                    edges.append(np.unique(np.stack([q, root[row]], axis=1), axis=0))
                e, hit = np.unique(np.concatenate(edges), axis=0), np.flatnonzero(back)
                one = np.flatnonzero(links)
                yield pd.DataFrame({"node": ids[one], "n_links": links[one].astype(np.int64), "other": ids[one], "recall": recall})
                yield pd.DataFrame({"node": there[hit], "n_links": back[hit].astype(np.int64), "other": there[hit], "recall": recall})
                yield pd.DataFrame({"node": ids[e[:, 0]], "n_links": np.zeros(len(e), np.int64), "other": there[e[:, 1]], "recall": recall})

    streamed = both.repartition(partitions(dealt.sparkSession), "label", "dim", "to").sortWithinPartitions(*keys)
    return streamed.select("block", "data").mapInPandas(run, "node long, n_links long, other long, recall double")
