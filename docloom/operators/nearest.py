"""Exact vector search by inner product over a stored index of bounded blocks.

The index is a table of blocks of at most ``BLOCK`` vectors that lie near each other, each with its centre and
radius. No vector of a block has a larger product with a query than centre · query + radius * |query|, so a block
whose bound lies under the k-th score that a query has so far cannot change its result.

Building: rows go to the nearest of some centres, are dealt by ranges of (part, centre, hash), so that a centre of
very many rows is spread over tasks, and are cut in two by the widest direction until a block is small enough.
Adding rows writes further blocks beside the others.

Searching goes from near to far in waves: each query first reads the blocks of highest bounds, and with its k-th
score from them only what may still hold a better one. Bounds are products of packs of queries and packs of
centres; what is written between the waves are pairs of query and block, and the best k of each query.

Defined cases: vectors that are null or hold null or non-finite components take no part, as rows and as queries; a
query of a null part finds nothing; all vectors of an index have one length; equal scores go to the smaller id;
fewer rows than k give all of them; without rows or queries nothing is found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import giving_back, small_batches, written

#: Of the stored form; another number wherever it changes, so that nothing reads an index of another form.
FORMAT = 1
BLOCK = 256
#: Centres that rows are dealt by: a product of rows and at most so many vectors.
CENTRES = 256
#: Rows of one centre that are cut into blocks together.
TOGETHER = 8_192
#: Blocks whose bounds are taken together, and queries.
BOUNDS, QUERIES = 4_096, 256
#: Queries of one block that are scored together.
ASKING = 1_024
#: Blocks that a query reads in each wave, highest bounds first, before it reads all that are left.
WAVES = (2, 16)
#: Scores are rounded to six digits, so a bound counts as reached within one of the last.
_EDGE = 1e-6
#: Rows of a batch that a task gives back.
_ROWS = 50_000
Batches = Iterator[pa.RecordBatch]


def whole(vector: Column) -> Column:
    """Whether a vector is there, and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles from a column of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(column):
        return flat.reshape(0, 0)
    if len(flat) % len(column) or (len(set(np.diff(column.offsets.to_numpy()).tolist())) > 1):
        raise ValueError("vectors of one index have one length")
    return flat.reshape(len(column), -1)


def blocks_of(points: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of the points in blocks of at most so many, cut at the median of the widest direction."""
    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        if len(at) <= most:
            yield at
            continue
        inside = points[at]
        spread = inside - inside.mean(axis=0)
        # The direction of the point farthest from the mean: near the widest one, without a decomposition.
        far = spread[np.argmax(np.einsum("ij,ij->i", spread, spread))]
        order = np.argsort(spread @ far, kind="stable")
        stack += [at[order[len(at) // 2 :]], at[order[: len(at) // 2]]]


@dataclass(frozen=True)
class VectorIndex:
    """Blocks (block, part, n, centre, radius, ids, vectors) in a folder."""

    spark: SparkSession
    folder: str

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/blocks")

    def add(self, rows: DataFrame, same: str | None = None, block: int = BLOCK) -> VectorIndex:
        """Writes the blocks of further rows (chunk_id, vector[, same]) beside those that are there."""
        part = F.col(same).cast("string") if same else F.lit("")
        given = rows.select(part.alias("part"), "chunk_id", "vector").filter(F.col("part").isNotNull() & whole(F.col("vector")))
        n = max(1, min(CENTRES, -(-given.count() // (4 * block))))
        sample = given.select(F.xxhash64("vector").alias("h"), "vector").orderBy("h").limit(n).select("vector").toArrow()["vector"].combine_chunks()
        centres = np.unique(matrix(sample), axis=0)
        id_type, vector_type = (given.schema[c].dataType.simpleString() for c in ("chunk_id", "vector"))
        dealt = given.mapInArrow(lambda batches: _assigned(batches, centres), f"part string, chunk_id {id_type}, vector {vector_type}, cell int")
        cells = dealt.repartitionByRange("part", "cell", F.xxhash64("chunk_id")).sortWithinPartitions("part", "cell")
        schema = f"block long, part string, n int, centre binary, radius double, ids array<{id_type}>, vectors binary"
        with small_batches(self.spark):
            cells.mapInArrow(lambda batches: giving_back(_blocks(batches, block)), schema).write.mode("append").parquet(f"{self.folder}/blocks")
        return self


def build(rows: DataFrame, folder: str, same: str | None = None, block: int = BLOCK) -> VectorIndex:
    """A new index in folder. same: a column whose values are searched apart, such as a knowledge base."""
    return VectorIndex(rows.sparkSession, folder).add(rows, same, block)


def _assigned(batches: Batches, centres: np.ndarray) -> Batches:
    for batch in batches:
        x = matrix(batch.column("vector"))
        cell = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1) if len(x) else np.empty(0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])


def _blocks(batches: Batches, most: int) -> Batches:
    """Sorted rows as blocks, each of a random 63-bit number."""
    held: list[pa.RecordBatch] = []

    def put() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        points = matrix(rows["vector"].chunk(0))
        ids, out = rows["chunk_id"].chunk(0), []
        for at in blocks_of(points, most):
            inside = points[at]
            centre = inside.mean(axis=0)
            radius = float(np.sqrt(((inside - centre) ** 2).sum(axis=1).max())) * (1 + 1e-12)
            out.append((uuid.uuid4().int >> 65, rows["part"][0].as_py(), len(at), centre.tobytes(), radius, at, inside.tobytes()))
        places = np.concatenate([o[5] for o in out])
        offsets = pa.array(np.concatenate([[0], np.cumsum([o[2] for o in out])]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, ids.take(pa.array(places)))
        column = lambda i, kind: pa.array([o[i] for o in out], kind)
        return pa.RecordBatch.from_arrays([column(0, pa.int64()), column(1, pa.string()), column(2, pa.int32()), column(3, pa.binary()), column(4, pa.float64()), lists, column(6, pa.binary())], names=["block", "part", "n", "centre", "radius", "ids", "vectors"])

    now, size = None, 0
    for batch in batches:
        part, cell = (batch.column(c).to_pylist() for c in ("part", "cell"))
        at = 0
        while at < batch.num_rows:
            if held and ((part[at], cell[at]) != now or size >= TOGETHER):
                yield put()
                size = 0
            now, end = (part[at], cell[at]), at
            while end < batch.num_rows and (part[end], cell[end]) == now and size < TOGETHER:
                end, size = end + 1, size + 1
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield put()


def _list(batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
    """A row's list of numbers, without copies of the batch; nulls of doubles are nan."""
    return batch.column(column)[i].values.to_numpy(zero_copy_only=False)


def _floors(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    return np.where(np.isnan(values), -np.inf, values)


def _bounds(packs: Batches, most: int | None, id_type: pa.DataType) -> Batches:
    """Pairs of a query and a block whose bound reaches the query's floor, for each pack of both; the ``most`` highest of each query at best."""
    for batch in packs:
        for r in range(batch.num_rows):
            queries, blocks = batch.column("queries")[r].values, _list(batch, "blocks", r)
            q = _list(batch, "v", r).reshape(len(queries), -1)
            c = np.frombuffer(batch.column("centres")[r].as_buffer()).reshape(len(blocks), -1)
            bound = q @ c.T + np.sqrt((q**2).sum(axis=1))[:, None] * _list(batch, "radii", r)
            ok = bound + _EDGE + 1e-9 * np.abs(bound) >= _floors(_list(batch, "floors", r))[:, None]
            parts = pa.concat_arrays([batch.column("query_parts")[r].values, batch.column("block_parts")[r].values]).dictionary_encode().indices.to_numpy()
            ok &= parts[: len(queries), None] == parts[len(queries) :]
            if most is not None and most < bound.shape[1]:
                near = np.argpartition(np.where(ok, -bound, np.inf), most - 1, axis=1)[:, :most]
                chosen = np.zeros_like(ok)
                np.put_along_axis(chosen, near, True, axis=1)
                ok &= chosen
            i, j = np.nonzero(ok)
            for a in range(0, len(i), _ROWS):
                x, y = i[a : a + _ROWS], j[a : a + _ROWS]
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(x)).cast(id_type), pa.array(blocks[y], pa.int64()), pa.array(bound[x, y])], names=["query_id", "block", "bound"])


def _scored(rows: Batches, k: int, types: list[pa.DataType]) -> Batches:
    """rows: a block beside the queries that ask it. Their best k rows there, and what comes within rounding of the k-th."""
    for batch in rows:
        for r in range(batch.num_rows):
            ids, asked = batch.column("ids")[r].values, batch.column("queries")[r].values
            x = np.frombuffer(batch.column("vectors")[r].as_buffer()).reshape(len(ids), -1)
            q = _list(batch, "v", r).reshape(len(asked), -1)
            floors = _floors(_list(batch, "floors", r))
            for a in range(0, len(asked), QUERIES):
                score = q[a : a + QUERIES] @ x.T
                floor = floors[a : a + QUERIES]
                if k < x.shape[0]:
                    floor = np.maximum(floor, -np.partition(-score, k - 1, axis=1)[:, k - 1])
                i, j = np.nonzero(score + _EDGE + 1e-9 * np.abs(score) >= floor[:, None])
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(i + a)).cast(types[0]), ids.take(pa.array(j)).cast(types[1]), pa.array(score[i, j])], names=["query_id", "chunk_id", "score"])


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _packed(rows: DataFrame, n: int, size: int, name: str, *columns: Column) -> DataFrame:
    """Rows in about n / size groups by hash of the id."""
    groups = max(1, -(-n // size))
    return rows.groupBy(F.pmod(F.xxhash64(name), F.lit(groups)).cast("int").alias("pack")).agg(F.collect_list(F.struct(name, *columns)).alias("rows"))


def _in_one(batches: Batches, column: str, name: str) -> Batches:
    """A column of lists of binaries as one binary each, under another name."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            keep = [n for n in batch.schema.names if n != column]
            whole_row = b"".join(x.as_buffer() for x in row.column(column)[0].values)
            yield pa.RecordBatch.from_arrays([*[row.column(n) for n in keep], pa.array([whole_row], pa.binary())], names=[*keep, name])


def searched(index: VectorIndex, queries: DataFrame, k: int, same: str | None = None, waves: tuple[int, ...] = WAVES) -> tuple[DataFrame, DataFrame]:
    """queries: (query_id, vector[, same]). (query_id, chunk_id, score, rank): each query's best k; and (query_id, block): what was read for it."""
    spark, blocks = index.spark, index.blocks()
    part = F.col(same).cast("string") if same else F.lit("")
    asked = queries.select("query_id", part.alias("part"), F.transform("vector", lambda x: x.cast("double")).alias("vector")).filter(F.col("part").isNotNull() & whole(F.col("vector")))
    id_types = [_arrow(asked.schema["query_id"].dataType), _arrow(blocks.schema["ids"].dataType.elementType)]
    sides = blocks.select("block", "part", "centre", "radius")
    n_blocks, n_asked = sides.count(), asked.count()
    groups = max(1, -(-n_blocks // BOUNDS))
    bound_packs = _packed(sides, n_blocks, BOUNDS, "block", F.col("part"), F.col("centre"), F.col("radius")).select(
        "pack", F.col("rows.block").alias("blocks"), F.col("rows.part").alias("block_parts"), F.col("rows.radius").alias("radii"), F.col("rows.centre").alias("c")
    )
    bound_packs = bound_packs.mapInArrow(lambda b: _in_one(b, "c", "centres"), "pack int, blocks array<long>, block_parts array<string>, radii array<double>, centres binary")
    salts = max(1, -(-n_asked // ASKING))
    query_type, hit_type = asked.schema["query_id"].dataType.simpleString(), blocks.schema["ids"].dataType.elementType.simpleString()
    pair_schema, hit_schema = f"query_id {query_type}, block long, bound double", f"query_id {query_type}, chunk_id {hit_type}, score double"
    best = seen = None
    before = 0
    for most in [*[w for w in waves if 4 * w <= n_blocks], None]:
        floors = asked if best is None else asked.join(best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor")), "query_id", "left")
        floors = floors if best is not None else floors.withColumn("floor", F.lit(None).cast("double"))
        query_packs = _packed(floors, n_asked, QUERIES, "query_id", F.col("part"), F.col("vector"), F.col("floor")).select(
            F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("pack"), F.col("rows.query_id").alias("queries"), F.col("rows.part").alias("query_parts"), F.col("rows.floor").alias("floors"), F.flatten("rows.vector").alias("v")
        )
        met = query_packs.join(bound_packs, "pack").drop("pack")
        pairs = met.mapInArrow(lambda b, m=most, s=before: _bounds(b, None if m is None else m + s, id_types[0]), pair_schema)
        if seen is not None:
            pairs = pairs.join(seen, ["query_id", "block"], "left_anti")
        if most is not None:
            pairs = pairs.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "block"))).filter(F.col("r") <= most)
            before += most
        pairs = written(pairs.select("query_id", "block"), "visits")
        seen = pairs if seen is None else seen.unionByName(pairs)
        asking = pairs.join(floors, "query_id").groupBy("block", F.pmod(F.xxhash64("query_id"), F.lit(salts)).alias("salt")).agg(F.collect_list(F.struct("query_id", "vector", "floor")).alias("asking"))
        beside = blocks.select("block", "n", "ids", "vectors").join(asking, "block").select("ids", "vectors", F.col("asking.query_id").alias("queries"), F.col("asking.floor").alias("floors"), F.flatten("asking.vector").alias("v"))
        hits = beside.mapInArrow(lambda b: giving_back(_scored(b, k, id_types)), hit_schema).withColumn("score", F.round("score", 6))
        if best is not None:
            hits = hits.unionByName(best.select("query_id", "chunk_id", "score"))
        ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("rank") <= k)
        best = written(ranked, "best")  # the last too: callers read it more than once
    return best, seen


def search(index: VectorIndex, queries: DataFrame, k: int, same: str | None = None) -> DataFrame:
    return searched(index, queries, k, same)[0]

