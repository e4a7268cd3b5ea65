"""Passages in and against texts: exact containment, and likeness by the ratio of matching characters.

Containment meets on grams of 16 bytes. Of every five neighbouring grams the one of least hash is chosen, so a
passage of 20 bytes or more that stands in a text shares all its chosen grams with it. A passage asks by the one of
its grams that the fewest texts hold, and what meets is verified, so boilerplate that all texts share meets nothing.

Likeness is difflib's ratio 2 m / (a + b), m matching characters of texts with a and b characters. Texts and passages
stand in blocks ordered by length; blocks of fitting lengths meet pair by pair, so no key gathers texts and a
task holds two blocks. Before a pair is compared four bounds of m must reach what the threshold asks for:

- characters: the counts that both share;
- pairs of neighbouring characters: m characters in k stretches share m - k of them, and k is at most one more than
  the characters that do not match, so m is at most (shared + a + b + 1) / 3;
- places: as few characters do not match, a half of the passage matches within a bounded part of the text, and m is
  at most what the halves share with their parts.

Defined cases: case is ignored; null and empty texts match nothing, nor do passages under the shortest length;
rows of one id are rows of their own in the comparison and one in the result.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

GRAM, NEAR = 16, 5
#: Rows and characters of a block of texts, and rows of a block of passages.
BLOCK_ROWS, BLOCK_CHARS, BLOCK_PASSAGES = 512, 4 << 20, 128
#: Chosen grams of the passages up to which they are sent to the scan of the texts; beyond, both meet by shuffle.
FEW_GRAMS = 200_000
_ONE, _TWO = 64, 192
_MIX = np.uint64(0x9E3779B97F4A7C15)
Batches = Iterator[pa.RecordBatch]


def chosen(text: bytes, only: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the chosen grams of a text, each once, in order; none under GRAM + NEAR - 1 bytes. only: sorted hashes that others are left out against."""
    n = len(text) - GRAM + 1
    if n < NEAR:
        return np.empty(0, np.int64)
    x = np.frombuffer(text, np.uint8).astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = (h ^ x[i : i + n]) * _MIX
        h ^= h >> np.uint64(29)
    least = h[: n - NEAR + 1]
    for i in range(1, NEAR):
        least = np.minimum(least, h[i : n - NEAR + 1 + i])
    least = least.view(np.int64)
    if only is not None:
        least = least[only[np.minimum(np.searchsorted(only, least), len(only) - 1)] == least] if len(only) else least[:0]
    return np.unique(least)


def _grams(batches: Batches, id_type: pa.DataType, only: np.ndarray | None = None) -> Batches:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            piece = batch.slice(at, 500)
            grams = [chosen((t or "").encode(), only) for t in piece.column("t").to_pylist()]
            ids = piece.column("id").take(pa.array(np.repeat(np.arange(len(grams)), [len(g) for g in grams])))
            yield pa.RecordBatch.from_arrays([ids.cast(id_type), pa.array(np.concatenate(grams) if grams else [], pa.int64())], names=["id", "gram"])


def _with_grams(rows: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["id"].dataType
    return rows.mapInArrow(lambda b: _grams(b, to_arrow_type(kind), only), f"id {kind.simpleString()}, gram long")


def contained(rows: DataFrame, golden: DataFrame, shortest: int = 20) -> DataFrame:
    """rows: (chunk_id, content); golden: (item_id, passage) of at least ``shortest`` characters, 20 or more. (chunk_id, item_id): the passage stands in the content, ignoring case."""
    if shortest < GRAM + NEAR - 1:
        raise ValueError(f"passages of at least {GRAM + NEAR - 1} characters")
    texts = rows.filter(F.length("content") >= shortest).select("chunk_id", F.lower("content").alias("c"))
    asked = golden.filter(F.length("passage") >= shortest).select("item_id", F.lower("passage").alias("p")).distinct()
    wanted = written(_with_grams(asked.select(F.col("item_id").alias("id"), F.col("p").alias("t"))).withColumnRenamed("id", "item_id"), "passages")
    grams = wanted.select("gram").distinct()
    few = grams.limit(FEW_GRAMS + 1).toArrow()["gram"].to_numpy()
    few = np.sort(few) if len(few) <= FEW_GRAMS else None
    found = _with_grams(texts.select(F.col("chunk_id").alias("id"), F.col("c").alias("t")), few).withColumnRenamed("id", "chunk_id")
    held = written(found if few is not None else found.join(grams, "gram", "left_semi"), "grams")
    # A gram that no text holds is the rarest: its passage is in none.
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("item_id").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    met = held.join(rarest, "gram").select("chunk_id", "item_id").distinct()
    return met.join(texts, "chunk_id").join(asked, "item_id").filter(F.contains("c", F.col("p"))).select("chunk_id", "item_id").distinct()


def _blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    """rows: (id, t, n). (block, lo, hi, ids, texts) in order of length."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def put() -> pa.RecordBatch:
            nonlocal number, held, size
            table = pa.Table.from_batches(held).combine_chunks()
            lengths = table["n"].to_numpy()
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), table[c].chunk(0))
            out = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([int(lengths.min())], pa.int32()), pa.array([int(lengths.max())], pa.int32()), one("id"), one("t")], names=["block", "lo", "hi", "ids", "texts"])
            number, held, size = number + 1, [], 0
            return out

        rows_held = 0
        for batch in batches:
            lengths, at = batch.column("n").to_pylist(), 0
            while at < batch.num_rows:
                end = at
                while end < batch.num_rows and rows_held < most and size < BLOCK_CHARS:
                    size, rows_held, end = size + lengths[end], rows_held + 1, end + 1
                if end > at:
                    held.append(batch.slice(at, end - at))
                if rows_held >= most or size >= BLOCK_CHARS:
                    yield put()
                    rows_held = 0
                at = end
        if held:
            yield put()

    ordered = rows.repartitionByRange("n", F.xxhash64("id", "t")).sortWithinPartitions("n")
    return written(ordered.mapInArrow(run, f"block long, lo int, hi int, ids array<{id_type}>, texts array<string>"), name)


def _signs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The characters as numbers, and counts of hashed characters and of hashed neighbours."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return x, np.concatenate([np.bincount(x % _ONE, minlength=_ONE), np.bincount((x[:-1] * 31 + x[1:]) % _TWO, minlength=_TWO)])


def _by_place(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether the halves of x may match enough of the parts of y that they can reach if ``least`` characters match."""
    half, right, left = len(x) // 2, math.floor(len(y) - least), math.floor(len(x) - least)
    shared = lambda a, b: int(np.minimum(np.bincount(a % _ONE, minlength=_ONE), np.bincount(b % _ONE, minlength=_ONE)).sum())
    return shared(x[:half], y[: max(0, half + right)]) + shared(x[half:], y[max(0, half - left) :]) >= least - 1e-9


def _rows_of(text: str) -> tuple[int, dict[str, int]]:
    """The length of a text and for each character the places where it stands, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return len(text), out


def common(rows: tuple[int, dict[str, int]], text: str) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number."""
    n, places = rows
    whole = open_ = (1 << n) - 1
    for c in text:
        if c in places:
            met = open_ & places[c]
            open_ = ((open_ + met) | (open_ - met)) & whole
    return n - open_.bit_count()


def alike_pairs(passages: list[str], texts: list[str], threshold: float) -> Iterator[tuple[int, int]]:
    """Places of the passages and texts whose ratio reaches the threshold."""
    signs = [_signs(t) for t in texts]
    length = np.array([len(x) for x, _ in signs])
    counts = np.stack([c for _, c in signs])
    for i, passage in enumerate(passages):
        x, mine = _signs(passage)
        places = _rows_of(passage)
        total = len(x) + length
        shared = np.minimum(counts, mine)
        one, two = shared[:, :_ONE].sum(axis=1), shared[:, _ONE:].sum(axis=1)
        most = np.minimum(np.minimum(one, (two + total + 1) / 3), np.minimum(len(x), length))
        for j in np.flatnonzero(2 * most >= threshold * total).tolist():
            if not _by_place(x, signs[j][0], threshold * total[j] / 2):
                continue
            if 2 * common(places, texts[j]) < threshold * total[j] - 1e-9:
                continue
            m = difflib.SequenceMatcher(None, passage, texts[j])
            if m.quick_ratio() >= threshold and m.ratio() >= threshold:
                yield i, j


def alike(rows: DataFrame, golden: DataFrame, threshold: float = 0.75, shortest: int = 20) -> DataFrame:
    """(chunk_id, item_id) of contents and passages whose ratio of matching characters reaches the threshold, ignoring case."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = rows.sparkSession
    least = threshold / (2 - threshold)  # the shorter one's least share of the longer one
    asked = golden.filter(F.length("passage") >= shortest).select(F.col("item_id").alias("id"), F.lower("passage").alias("t")).withColumn("n", F.length("t"))
    ends = asked.agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
    texts = rows.filter(F.length("content") > 0).select(F.col("chunk_id").alias("id"), F.lower("content").alias("t")).withColumn("n", F.length("t"))
    texts = texts.filter(F.col("n").between(math.floor((ends["a"] or 0) * least), math.ceil((ends["b"] or -1) / least)))
    right = _blocks(texts, BLOCK_ROWS, "texts")
    left = _blocks(asked, BLOCK_PASSAGES, "passages")
    step = -math.log(least)
    band = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1))) / step)
    near = left.select(F.col("block").alias("pb"), F.col("lo").alias("plo"), F.col("hi").alias("phi"), F.explode(F.sequence(band("lo") - 1, band("hi") + 1)).alias("band"))
    met = right.select("block", "lo", "hi", F.explode(F.sequence(band("lo"), band("hi"))).alias("band")).join(near, "band")
    fits = (F.col("lo") * 1.0 <= F.col("phi") / least + 1e-6) & (F.col("hi") / least + 1e-6 >= F.col("plo"))
    pairs = met.filter(fits).select("pb", "block").distinct()
    both = pairs.join(left.select(F.col("block").alias("pb"), F.col("ids").alias("items"), F.col("texts").alias("passages")), "pb").join(right.select("block", "ids", "texts"), "block")
    kinds = {n: df.schema["id"].dataType for n, df in (("chunk_id", texts), ("item_id", asked))}

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for r in batch.to_pylist():
                found = list(alike_pairs(r["passages"], r["texts"], threshold))
                columns = [[r["ids"][j] for _, j in found], [r["items"][i] for i, _ in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(k)) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    schema = ", ".join(f"{n} {k.simpleString()}" for n, k in kinds.items())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return both.select("ids", "texts", "items", "passages").repartition(n, F.xxhash64("ids", "items")).mapInArrow(run, schema).distinct()


def passage_matches(rows: DataFrame, golden: DataFrame, threshold: float = 0.75, shortest: int = 20) -> DataFrame:
    """(chunk_id, item_id, contained): pairs where the content holds the passage or is like it."""
    inside = contained(rows, golden, shortest).withColumn("contained", F.lit(True))
    near = alike(rows, golden, threshold, shortest)
    return near.join(inside, ["chunk_id", "item_id"], "full").select("chunk_id", "item_id", F.coalesce("contained", F.lit(False)).alias("contained"))
