"""BM25 over a stored inverted index with bounds for each block of postings.

Documents stand in ranges of at most ``RANGE``, near each other in length. The index holds one row for each range, with
its documents and their lengths, and one for each term and range: the places of the documents with the term, how
often it stands in each, and the largest count and least length among them. No document of a range scores more for a
term than these two allow, so the sum over a query's terms bounds its score in the range.

Building reads the texts once and shuffles nothing: a task counts the terms of a range in one sort of numbers. Adding
rows writes further ranges beside the others; statistics are sums over all ranges.

Searching: each query first scores the ranges of highest bounds, and with its k-th score from them only the ranges
that may still hold a better document. The postings of the queries' terms and the queries that ask a range meet as
rows of one order, so each is sent once; a task holds the postings of one range, adds up scores by place, and gives a
query's best k of the range. The texts are not read.

Defined cases: a null text has no terms and length 0, and counts as a document; a query's terms count once; a query
without known terms finds nothing; with ``same``, rows of a null value are in no search, but count for the
statistics; equal scores go to the smaller id; a row added twice is two documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import terms
from ..sources.tables import giving_back, small_batches, written

#: Of the stored form; another number wherever it changes, so that nothing reads an index of another form.
FORMAT = 2
K1, B = 1.2, 0.75
RANGE = 4_096
#: Documents, and bytes of their terms, that a task puts in order of length together.
TOGETHER, TOGETHER_BYTES = 4 * RANGE, 32 << 20
#: Terms of a range at most, unless one document has more: what a task sorts at once.
RANGE_TERMS = 4 << 20
#: Query terms up to which they are sent to the scan of the index.
FEW_TERMS = 100_000
#: Ranges that a query scores first.
NEAR = 2
_EDGE = 1e-6
#: Rows of a batch that a task gives back.
_ROWS = 50_000
Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Postings:
    """Rows in a folder: of ranges (term null; range, part, n, total, ids, lengths), and of terms in them (term, range, part, n, most, least, places, counts)."""

    spark: SparkSession
    folder: str
    id_type: str

    def schema(self) -> str:
        return f"term string, range long, part string, n int, total long, most int, least int, ids array<{self.id_type}>, lengths array<int>, places array<int>, counts array<int>"

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema()).parquet(f"{self.folder}/postings")

    def ranges(self) -> DataFrame:
        return self.table().filter("term is null").select("range", "part", "n", "total")

    def add(self, rows: DataFrame, same: str | None = None, size: int = RANGE) -> Postings:
        """Writes the postings of further rows (chunk_id, content[, same])."""
        part = F.col(same).cast("string") if same else F.lit("")
        tokens = rows.select(part.alias("part"), "chunk_id", terms(F.coalesce("content", F.lit(""))).alias("tokens"))
        if same:  # ranges hold one value, so its rows come together; a value of very many rows stays spread
            tokens = tokens.repartitionByRange("part", F.xxhash64("chunk_id")).sortWithinPartitions("part")
        with small_batches(self.spark):
            tokens.mapInArrow(lambda batches: giving_back(_counted(batches, size)), self.schema()).write.mode("append").parquet(f"{self.folder}/postings")
        return self


def build(rows: DataFrame, folder: str, same: str | None = None, size: int = RANGE) -> Postings:
    """A new index in folder. same: a column whose values are searched apart."""
    spark = rows.sparkSession
    id_type = rows.schema["chunk_id"].dataType.simpleString()
    spark.createDataFrame([(id_type,)], "id_type string").write.parquet(f"{folder}/about")
    return Postings(spark, folder, id_type).add(rows, same, size)


def load(spark: SparkSession, folder: str) -> Postings:
    return Postings(spark, folder, spark.read.parquet(f"{folder}/about").first()["id_type"])


def _counted(batches: Batches, size: int) -> Batches:
    held: list[pa.RecordBatch] = []
    weight = rows = 0
    part: str | None = None
    for batch in batches:
        parts, at = batch.column("part"), 0
        while at < batch.num_rows:
            now = parts[at].as_py()
            if held and (now != part or rows >= TOGETHER or weight >= TOGETHER_BYTES):
                yield from _ranges(held, part, size)
                held, weight, rows = [], 0, 0
            part, end = now, at + 1
            while end < batch.num_rows and parts[end].as_py() == part and rows + end - at < TOGETHER:
                end += 1
            piece = batch.slice(at, end - at)
            weight += len(piece.column("tokens").flatten()) * 12
            rows += end - at
            held.append(piece)
            at = end
    if held:
        yield from _ranges(held, part, size)


def _ranges(held: list[pa.RecordBatch], part: str | None, size: int) -> Batches:
    """Ranges of documents near in length: the postings of every term of each, and a row about the range."""
    table = pa.Table.from_batches(held).combine_chunks()
    tokens, ids = table["tokens"].chunk(0), table["chunk_id"].chunk(0)
    length = np.diff(tokens.offsets.to_numpy())
    order = np.argsort(length, kind="stable")
    ints = pa.list_(pa.int32())
    kinds = {"term": pa.string(), "range": pa.int64(), "part": pa.string(), "n": pa.int32(), "total": pa.int64(), "most": pa.int32(), "least": pa.int32(), "ids": pa.list_(ids.type), "lengths": ints, "places": ints, "counts": ints}

    def batch_of(rows: int, **columns) -> pa.RecordBatch:
        given = {k: columns.get(k, [None] * rows) for k in kinds}
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for k, c in given.items()], names=list(kinds))

    upto, b = np.cumsum(length[order]), 0
    while b < len(order):
        a, b = b, min(b + size, int(np.searchsorted(upto, (upto[b - 1] if b else 0) + RANGE_TERMS, side="right")))
        b = max(b, a + 1)
        at = order[a:b]
        mine = tokens.take(pa.array(at))
        n, number = length[at], uuid.uuid4().int >> 65
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), values)  # noqa: E731,B023
        yield batch_of(1, range=[number], part=[part], n=[len(at)], total=[int(n.sum())], ids=one(ids.take(pa.array(at))), lengths=one(pa.array(n, pa.int32())))
        words = mine.flatten().dictionary_encode()
        if not len(words) or part is None:
            continue
        by_term = pc.sort_indices(words.dictionary)
        kind = np.int32 if len(by_term) * len(at) < 2**31 else np.int64
        code_of = np.empty(len(by_term), kind)
        code_of[by_term.to_numpy()] = np.arange(len(by_term))
        key = code_of[words.indices.to_numpy()]
        key *= len(at)
        key += np.repeat(np.arange(len(at), dtype=kind), n)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count, key = np.diff(np.append(first, len(key))), key[first]
        code, doc = key // len(at), key % len(at)
        edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        offsets = pa.array(np.append(edge, len(code)), pa.int32())
        lists = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))  # noqa: E731,B023
        step = 20_000  # rows a batch
        whole = batch_of(
            len(edge), term=words.dictionary.take(by_term).cast(pa.string()), range=pa.array([number] * len(edge)), part=pa.array([part] * len(edge)), n=pa.array(np.diff(np.append(edge, len(code))), pa.int32()),
            most=pa.array(np.maximum.reduceat(count, edge), pa.int32()), least=pa.array(np.minimum.reduceat(n[doc], edge), pa.int32()), places=lists(doc), counts=lists(count),
        )
        yield from (whole.slice(i, step) for i in range(0, whole.num_rows, step))


def _part(idf: Column, tf: Column, length: Column, mean: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


def _met(batches: Batches, k: int, mean: float, id_type: pa.DataType, query_type: pa.DataType) -> Batches:
    """Rows in order of range: its documents, the postings of its terms, the queries that ask it. The best k of each query there, and what comes within rounding of the k-th."""
    ids, length, held, ready = pa.array([], id_type), np.empty(0), {}, {}
    for batch in batches:
        out: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
        size = 0
        column = {n: batch.column(n) for n in batch.schema.names}
        queries = column["query_id"].cast(query_type)
        told = [column[n].to_pylist() for n in ("terms", "idfs", "floor")]
        for i, kind in enumerate(column["kind"].to_pylist()):
            if kind == 0:
                ids, length, held, ready = column["ids"][i].values, column["lengths"][i].values.to_numpy(), {}, {}
            elif kind == 1:
                held[column["term"][i].as_py()] = (column["places"][i].values.to_numpy(), column["counts"][i].values.to_numpy())
            else:
                score = np.zeros(len(length))
                terms_, idfs, floor = (c[i] for c in told)
                for term, idf in zip(terms_, idfs, strict=True):
                    if term in held:  # a term that many of the documents hold has a share for each of them
                        at, tf = held.pop(term)
                        share = idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[at] / mean)))
                        if 8 * len(at) >= len(length):
                            dense = np.zeros(len(length))
                            dense[at] = share
                            at, share = None, dense
                        ready[term] = at, share
                    if term in ready:
                        at, share = ready[term]
                        if at is None:
                            score += share
                        else:
                            score[at] += share
                # What lies under the query's floor is left out first: of most ranges hardly a document is left.
                found = np.flatnonzero(score + _EDGE >= floor if floor is not None and floor > _EDGE else score > 0)
                if len(found) > k:
                    kept = score[found]
                    found = found[kept + _EDGE >= np.partition(kept, -k)[-k]]
                if len(found):
                    out.append((queries.take(pa.array(np.full(len(found), i))), ids.take(pa.array(found)), score[found]))
                    size += len(found)
                if size >= _ROWS:
                    yield _hits(out)
                    out, size = [], 0
        if out:
            yield _hits(out)


def _hits(out: list[tuple[pa.Array, pa.Array, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([q for q, _, _ in out]), pa.concat_arrays([c for _, c, _ in out]), pa.array(np.concatenate([x for _, _, x in out]))], names=["query_id", "chunk_id", "score"])


def searched(index: Postings, queries: DataFrame, k: int, same: str | None = None, near: int = NEAR) -> tuple[DataFrame, DataFrame]:
    """queries: (query_id, query[, same]). (query_id, chunk_id, score, rank): each query's best k; and (query_id, range): what was scored for it."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = index.spark
    stats = index.ranges().agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("ranges")).first()
    n, mean = float(stats["n"] or 0), float(stats["total"] or 0) / max(1, stats["n"] or 0) or 1.0
    part = F.col(same).cast("string") if same else F.lit("")
    asked = queries.select("query_id", part.alias("part"), F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    wanted = asked.select("term").distinct()
    if wanted.limit(FEW_TERMS + 1).count() <= FEW_TERMS:
        wanted = F.broadcast(wanted)
    rows = index.table().filter("term is not null").join(wanted, "term", "left_semi")
    sides = rows.select("term", "range", "part", "n", "most", "least")
    df = F.sum("n")
    weighed = written(asked.join(sides.groupBy("term").agg(F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5)).alias("idf")), "term"), "terms")
    bound = _part(F.col("idf"), F.col("most"), F.col("least"), mean)
    bounds = written(weighed.join(sides, ["term", "part"]).groupBy("query_id", "range").agg(F.sum(bound).alias("bound")), "bounds")
    asking = weighed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("t")).select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs"))
    documents = index.table().filter("term is null").select("range", F.lit(0).alias("kind"), "ids", "lengths")
    lists = rows.select("range", F.lit(1).alias("kind"), "term", "places", "counts")
    query_type = asked.schema["query_id"].dataType
    kinds = to_arrow_type(index.table().schema["ids"].dataType.elementType), to_arrow_type(query_type)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def scored(pairs: DataFrame) -> DataFrame:
        """pairs: (query_id, range, floor). Each query's best k of each of its ranges."""
        asks = pairs.join(asking, "query_id").select("range", F.lit(2).alias("kind"), "query_id", "terms", "idfs", "floor")
        met = documents.unionByName(lists, allowMissingColumns=True).unionByName(asks, allowMissingColumns=True)
        order = met.repartition(parts, "range").sortWithinPartitions("range", "kind")
        hits = order.mapInArrow(lambda b: giving_back(_met(b, k, mean, *kinds)), f"query_id {query_type.simpleString()}, chunk_id {index.id_type}, score double")
        return hits.withColumn("score", F.round("score", 6))

    def ranked(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("rank") <= k)

    none = F.lit(None).cast("double").alias("floor")
    if stats["ranges"] <= 4 * near:
        return written(ranked(scored(bounds.select("query_id", "range", none))), "hits"), bounds.select("query_id", "range")
    first = bounds.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "range"))).filter(F.col("r") <= near).select("query_id", "range")
    best = written(ranked(scored(first.select("query_id", "range", none))), "best")
    floors = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    left = bounds.join(first, ["query_id", "range"], "left_anti").join(floors, "query_id", "left")
    rest = written(left.filter(F.col("floor").isNull() | (F.col("bound") + _EDGE >= F.col("floor"))).select("query_id", "range", "floor"), "rest")
    return written(ranked(scored(rest).unionByName(best.select("query_id", "chunk_id", "score"))), "hits"), first.unionByName(rest.select("query_id", "range"))


def search(index: Postings, queries: DataFrame, k: int, same: str | None = None) -> DataFrame:
    return searched(index, queries, k, same)[0]
