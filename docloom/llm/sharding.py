"""Sharding by a hierarchical weighted hash tree: region, rack, shard, each chosen by weighted hash draws.

At every level each child draws -ln(u) / weight with u hashed from the row's key and the child's name; the
least draw wins. A child whose weight rises can only win rows, one whose weight falls can only lose them,
and the draws of the others do not change: rows move into or out of the changed subtree alone. A grown
cluster gets its new shard as a new region of one rack, so that one more shard takes rows only into itself.

Defined cases: a null doc_id is a key of its own; rows with one doc_id share a shard; a null text has size
``overhead`` and the checksum of no bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import utf8, written

#: Rows of a shard that are numbered together; a shard with more is numbered in blocks.
SLOT_BLOCK = 20_000


@dataclass(frozen=True)
class Tree:
    """regions[i][j] lists the (shard, weight) of rack j of region i; a rack's weight and a region's are sums."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @property
    def n_shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a region and rack of its own."""
        return Tree((*self.regions, (((self.n_shards, weight),),)))


def balanced(n_shards: int, racks: int = 4, rack_shards: int = 4, base: int = 32) -> Tree:
    """base shards in regions of racks x rack_shards, and each further shard as grown() adds it.

    Every count from base on grows from the one before, so the law of one more shard holds at each step.
    """
    if n_shards < base:
        raise ValueError(f"at least {base} shards, or another base")
    at, regions = 0, []
    while at < base:
        region = []
        for _ in range(racks):
            if rack := tuple((s, 1.0) for s in range(at, min(base, at + rack_shards))):
                region.append(rack)
            at += len(rack)
        regions.append(tuple(region))
    tree = Tree(tuple(regions))
    while tree.n_shards < n_shards:
        tree = tree.grown()
    return tree


def _draw(key: Column, level: str, name: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of the hash of key, level and name."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), name), 12)
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))) / weight


def _choose(key: Column, level: str, names: list[int], weights: list[float]) -> Column:
    """The name whose draw is least, ties to the smaller name; nothing to draw for a single child."""
    if len(names) == 1:
        return F.lit(names[0])
    draws = [F.struct(_draw(key, level, F.lit(n), F.lit(float(w))).alias("d"), F.lit(n).alias("n")) for n, w in zip(names, weights, strict=True)]
    return F.least(*draws)["n"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key. Racks draw under names counted over the tree, so that a draw never depends on siblings."""
    region_weight = [sum(w for rack in region for _, w in rack) for region in tree.regions]
    region = _choose(key, "region", list(range(len(tree.regions))), region_weight)
    by_region, number = [], 0
    for racks in tree.regions:
        names = list(range(number, number + len(racks)))
        number += len(racks)
        rack = _choose(key, "rack", names, [sum(w for _, w in r) for r in racks])
        by_rack = [_choose(key, "shard", [s for s, _ in r], [w for _, w in r]) for r in racks]
        by_region.append(_switch(rack, names, by_rack))
    return _switch(region, list(range(len(by_region))), by_region).cast("int")


def _switch(chosen: Column, names: list[int], values: list[Column]) -> Column:
    """The value beside the chosen name; only that branch is evaluated."""
    out = values[-1]
    for name, value in zip(names[-2::-1], values[-2::-1], strict=True):
        out = F.when(chosen == name, value).otherwise(out)
    return out


def with_slots(sharded: DataFrame, block_rows: int = SLOT_BLOCK) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps.

    Rows of a shard are dealt into blocks by hash, numbered within the block, and moved by the sum of the
    blocks before; so no task holds a whole shard, whatever its size.
    """
    rows = written(sharded, "sharded")
    n = rows.count()
    blocks = max(1, -(-n // (block_rows * max(1, rows.select("shard").distinct().count()))))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = dealt.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).select("shard", "block", F.coalesce(before, F.lit(0)).alias("start"))
    numbered = dealt.withColumn("rank", F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(starts, ["shard", "block"]).withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long")).drop("block", "rank", "start")


def assign(docs: DataFrame, n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard with one more (grown_shard)."""
    tree = balanced(n_shards)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    sharded = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(utf8("text")).cast("long").alias("text_crc32"),
        shard_of(key, tree).alias("shard"),
        shard_of(key, tree.grown()).alias("grown_shard"),
    )
    return with_slots(sharded).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
