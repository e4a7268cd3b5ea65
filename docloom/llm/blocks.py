"""Blocks of documents, and the exchange that finds which of their hashes stand in more than one place.

A block holds a few megabytes of documents, all columns, as one compressed Arrow batch. Jobs that look at the
text more than once join small messages to blocks by number, so a shuffle moves few large compressed rows.
Numbers are given when the table is written and read back from it, so a lost task finds the same blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, partitions, written

BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 20_000
#: Counts in one byte: exact to 127, then rounded up.
STEPS = np.concatenate([np.arange(128), np.ceil(127 * 1.12 ** np.arange(1, 129))]).astype(np.int64)
Hashes = Callable[[pa.RecordBatch], np.ndarray]


def seal(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unseal(data: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the text column, and the end of each row's (null: empty), from 0."""
    column = batch.column(name).cast(pa.large_binary()).fill_null(b"")
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def packed(docs: DataFrame, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, data): the documents in blocks, written to the shared folder. A longer text makes a larger block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = rows = 0

        def block() -> pa.RecordBatch:
            nonlocal count, held, size, rows
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            number, count, held, size, rows = (task << 32) + count, count + 1, [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([seal(whole)], pa.binary())], names=["block", "data"])

        for batch in batches:
            _, offsets = texts(batch)
            at = 0
            while at < batch.num_rows:
                end = int(np.searchsorted(offsets, offsets[at] + block_bytes - size, side="left"))
                end = max(at + 1, min(end, batch.num_rows, at + block_rows - rows))
                held.append(batch.slice(at, end - at))
                size, rows, at = size + int(offsets[end] - offsets[at]), rows + end - at, end
                if size >= block_bytes or rows >= block_rows:
                    yield block()
        if held:
            yield block()

    return written(docs.mapInArrow(freed(run), "block long, data binary"), "blocks")


def parts_of(spark) -> int:
    """Parts of a packed exchange: several to a partition, so that they spread evenly."""
    return min(60_000, 4 * partitions(spark))


def _split(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (part, 48-bit key) of hashes as part << 48 | key, sorted; the place of each hash among them; and their counts."""
    part = (hashes & np.uint64(0xFFFF)) % np.uint64(parts)
    return np.unique((part << np.uint64(48)) | (hashes >> np.uint64(16)), return_inverse=True, return_counts=True)


def _key_bytes(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _keys(raw: bytes, part: int) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64) | np.uint64(part << 48)


def _by_part(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted part << 48 | key."""
    part = keys >> np.uint64(48)
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(keys) else [0]
    yield from ((int(part[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True))


def runs(batches: Iterator[pa.RecordBatch], key: str, columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """(value, rows) of each run of equal values of the key, over sorted batches."""
    now, held = None, []
    for batch in batches:
        for value, *row in zip(*(batch.column(c).to_pylist() for c in (key, *columns)), strict=True):
            if value != now and held:
                yield now, held
                held = []
            now = value
            held.append(tuple(row))
    if held:
        yield now, held


def with_counts(blocks: DataFrame, hashes: Hashes) -> DataFrame:
    """Adds replies to the blocks: for each part, half a byte for each distinct key of the block, the count of the key over all blocks.

    Counts are told as the least power of two that is not smaller (0: the key stands once), at most 15. Each block
    sends its distinct keys once, with its own count, to the part that their bits name; parts are settled one by one.
    """
    spark = blocks.sparkSession
    parts = parts_of(spark)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                keys, _, count = _split(hashes(unseal(data.as_py())), parts)
                few = np.searchsorted(STEPS, count).astype(np.uint8)
                rows = [(p, _key_bytes(keys[a:b]), few[a:b].tobytes()) for p, a, b in _by_part(keys)]
                columns = [pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int32()), (1, pa.binary()), (2, pa.binary()))]
                yield pa.RecordBatch.from_arrays([columns[0], pa.array([block] * len(rows), pa.int64()), *columns[1:]], names=["part", "block", "keys", "counts"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, got in runs(batches, "part", ("block", "keys", "counts")):
            key = np.concatenate([_keys(k, part) for _, k, _ in got])
            order = np.argsort(key)
            new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
            total = np.add.reduceat(STEPS[np.frombuffer(b"".join(c for _, _, c in got), np.uint8)[order]], np.flatnonzero(new))
            code = np.empty(len(key), np.uint8)
            code[order] = np.minimum(15, np.ceil(np.log2(total))).astype(np.uint8)[np.cumsum(new) - 1]
            ends = np.cumsum([len(c) for _, _, c in got]).tolist()
            packs = [_nibbles(code[e - len(c) : e]) for e, (_, _, c) in zip(ends, got, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in got], pa.int64()), pa.array([part] * len(got), pa.int32()), pa.array(packs, pa.binary())], names=["block", "part", "codes"])

    sent = blocks.mapInArrow(freed(send), "part int, block long, keys binary, counts binary").repartition(partitions(spark), "part").sortWithinPartitions("part")
    replies = sent.mapInArrow(freed(meet), "block long, part int, codes binary").groupBy("block").agg(F.collect_list(F.struct("part", "codes")).alias("replies"))
    # Replies grow with the input: they meet the blocks by shuffle at every size, never as a broadcast.
    return blocks.join(replies.hint("merge"), "block", "left")


def _nibbles(codes: np.ndarray) -> bytes:
    even = np.zeros(len(codes) + len(codes) % 2, np.uint8)
    even[: len(codes)] = codes
    return (even[::2] << 4 | even[1::2]).tobytes()


def counts_of(hashes: np.ndarray, replies: list[dict] | None, parts: int) -> np.ndarray:
    """The code of each hash of a block, from its replies."""
    keys, at, _ = _split(hashes, parts)
    codes, told = np.zeros(len(keys), np.uint8), {r["part"]: r["codes"] for r in replies or []}
    for p, a, b in _by_part(keys):
        both = np.frombuffer(told[p], np.uint8)
        codes[a:b] = np.stack([both >> 4, both & 15], axis=1).ravel()[: b - a]
    return codes[at.ravel()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


