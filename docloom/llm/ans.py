"""Token-id output in a static range asymmetric numeral system, and reading it back.

One table of token frequencies, counted over the whole corpus, serves every file. Documents in ascending
doc_id order are cut into blocks of at most ``BLOCK`` tokens. A block is coded by ``LANES`` interleaved
states, so that a step codes or decodes one token of each lane; every ``CHECKPOINT`` steps the states and the
place in the words are recorded, so that any stretch decodes without those before it, and each stretch has
a checksum of its tokens. A file set is two tables in the shared folder: ``frequencies`` and ``blocks``,
one row per block with its documents, payload and checkpoints.

Documents are dealt to range parts by quantiles of doc_id, packed and compressed, so the shuffle moves few
large rows; a part with many rows is only a larger file.

Defined cases: a null text is empty and keeps its end id; a null doc_id sorts first; rows with the same
doc_id follow each other in order of their tokens' checksum; an empty table gives no blocks and no rows;
extra columns are ignored; a text of any length spans as many blocks as it needs.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import partitions, shared_dir, written

END = 2
SCALE = 18
LOW = np.uint64(1 << 31)
LANES = 1024
CHECKPOINT = 256
BLOCK = LANES * CHECKPOINT * 2
#: Units of text, and pieces of them, that a worker remembers the ids of.
MEMORY = 400_000
_NULL = -(2**63)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


# What a vocabulary's file must say for the short way below to give the library's ids.
SHORT_WAY = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


@lru_cache(maxsize=2)
def short_way(path: str) -> bool:
    """Whether stretches between spaces encode on their own: the file says exactly SHORT_WAY, and special strings hold no space, are taken as they stand, and begin with "<|"."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = all(t["content"].startswith("<|") and " " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    return plain and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and all(spec.get(k) == v for k, v in SHORT_WAY.items())


#: Stretches for which normal form and lower case are plain, and their pieces as the vocabulary's file cuts them.
_PLAIN = re.compile(r"[\t\n\r!-~¡-±´-¸º»¿-ÿ]+")
_PIECE = re.compile(r"[a-zªµºß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\sa-zªµºß-öø-ÿ0-9]+")


class Pieces(dict):
    """Ids of a lower-case piece, by the library's merges."""

    def __init__(self, path: str):
        super().__init__()
        self.model = tokenizer(path).model
        self.stand_in = {b: c for c, b in byte_alphabet().items()}

    def __missing__(self, piece: str) -> bytes:
        signs = piece if piece.isascii() else "".join(map(self.stand_in.__getitem__, piece.encode()))
        ids = array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()
        if len(piece) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = ids
        return ids


class Units(dict):
    """Ids of the stretch between two spaces. This vocabulary drops white space, so stretches encode independently."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer, self.pieces = tokenizer(path), Pieces(path)

    def __missing__(self, unit: str) -> bytes:
        if _PLAIN.fullmatch(unit) and "<|" not in unit:
            ids = b"".join(map(self.pieces.__getitem__, _PIECE.findall(unit.lower())))
        else:
            ids = array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
        if len(unit) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[unit] = ids
        return ids


@lru_cache(maxsize=2)
def units_of(path: str) -> Units:
    """The table of this Python worker; its tasks share it one after the other."""
    return Units(path)


def encoder(path: str):
    """Ids of a whole text as bytes: by its stretches where the file allows it, else by the library on the whole text."""
    if not short_way(path):
        whole = tokenizer(path)
        return lambda text: array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
    look_up = units_of(path).__getitem__
    return lambda text: b"".join(map(look_up, text.split(" ")))


def _pack(doc_ids: list[int], ids: list[bytes]) -> bytes:
    import zstandard

    head = np.array([len(doc_ids)], "<i8").tobytes() + np.array(doc_ids, "<i8").tobytes() + np.array([len(x) // 4 for x in ids], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(ids))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    return np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n), np.frombuffer(raw, "<u4", -1, 8 + 16 * n)


def tokens(docs: DataFrame, path: str, bounds: list[int], end: int = END) -> DataFrame:
    """Packed ids by range part (part >= 0, blob), and each task's token counts (part -1, counts as 64-bit integers)."""
    size = tokenizer(path).get_vocab_size()
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tail = np.zeros(size, np.int64), int(end).to_bytes(4, "little")
        encode = encoder(path)
        for batch in batches:
            doc_ids = np.array([_NULL if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)
            ids = [encode(t) + tail if t else tail for t in batch.column("text").to_pylist()]
            counts += np.bincount(np.frombuffer(b"".join(ids), "<u4"), minlength=size)
            part = np.searchsorted(edges, doc_ids, side="right")
            rows = [(p, np.flatnonzero(part == p)) for p in np.unique(part).tolist()]
            blobs = [_pack(doc_ids[k].tolist(), [ids[i] for i in k]) for _, k in rows]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=["part", "blob"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "part int, blob binary")


def frequencies(packed: DataFrame) -> np.ndarray:
    """The quantised table: occurring tokens get at least 1 of 2**SCALE, the rest goes by count. The driver gets one row per task group, each bounded by the vocabulary."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                x = np.frombuffer(blob, "<i8")
                total = x.copy() if total is None else total + x
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["token", "n"])

    counted = packed.filter("part = -1").select("blob").mapInArrow(add, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.orderBy("token").toPandas()
    table = np.zeros(int(rows.token.max()) + 1 if len(rows) else 1, np.int64)
    if len(rows):
        n = rows.n.to_numpy()
        f = 1 + n * ((1 << SCALE) - len(n)) // max(1, n.sum())
        f[np.argmax(n)] += (1 << SCALE) - f.sum()
        table[rows.token.to_numpy()] = f
    return table


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[bytes, list[tuple[int, int, bytes]]]:
    """The words of a block, and its checkpoints: (step, words before it, states) for each stretch of CHECKPOINT steps."""
    n, steps = len(ids), -(-len(ids) // LANES)
    f, c = freq[ids].astype(np.uint64), start[ids].astype(np.uint64)
    state, words, marks, count = np.full(LANES, LOW, np.uint64), [], [], 0
    room, half = np.uint64(63 - SCALE), np.uint64(32)
    for step in range(steps - 1, -1, -1):
        a, b = step * LANES, min(n, (step + 1) * LANES)
        x, fs = state[: b - a], f[a:b]
        if (full := x >= (fs << room)).any():
            out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
            words.append(out)
            count += len(out)
            x[full] >>= half
        q = x // fs
        x[:] = (q << np.uint64(SCALE)) + (x - q * fs) + c[a:b]
        if step % CHECKPOINT == 0:
            marks.append((step, count, state.astype("<u8").tobytes()))
    payload = np.concatenate(words[::-1]).tobytes() if words else b""
    return payload, [(step, count - at, s) for step, at, s in marks[::-1]]


def decode_stretch(payload: bytes, n_tokens: int, step: int, word: int, states: bytes, symbol: np.ndarray, freq: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The ids from a checkpoint to the next, or to the end of the block."""
    last = min(-(-n_tokens // LANES), step + CHECKPOINT)
    words, state = np.frombuffer(payload, "<u4"), np.frombuffer(states, "<u8").astype(np.uint64)
    out, mask, scale, half = np.empty(min(n_tokens, last * LANES) - step * LANES, np.int64), np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for k in range(step, last):
        a, b = (k - step) * LANES, min(n_tokens - step * LANES, (k - step + 1) * LANES)
        x = state[: b - a]
        slot = x & mask
        s = symbol[slot]
        out[a:b] = s
        x[:] = freq[s] * (x >> scale) + slot - start[s]
        low = x < LOW
        if n := int(low.sum()):
            x[low] = (x[low] << half) | words[word : word + n].astype(np.uint64)
            word += n
    return out


_BLOCK = "part int, block int, n_tokens long, doc_ids binary, doc_seq binary, doc_piece binary, doc_tokens binary, payload binary, steps array<int>, words array<int>, states array<binary>, checksums array<long>"


def blocks(packed: DataFrame, freq: np.ndarray, block_tokens: int = BLOCK) -> DataFrame:
    """Blocks of the parts, each part's documents in ascending doc_id order."""
    start = np.concatenate([[0], np.cumsum(freq)[:-1]])
    names = [x.split()[0] for x in _BLOCK.split(", ")]

    def part_blocks(part: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        doc_ids, lengths, ids = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
        begin = np.cumsum(lengths) - lengths
        ties = np.zeros(len(doc_ids), np.int64)
        if len(np.unique(doc_ids)) < len(doc_ids):
            ties = np.array([zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(begin.tolist(), lengths.tolist(), strict=True)])
        order = np.lexsort((lengths, ties, doc_ids))
        doc_ids, lengths = doc_ids[order], lengths[order]
        ids = np.concatenate([ids[a : a + n] for a, n in zip(begin[order].tolist(), lengths.tolist(), strict=True)])
        ends = np.cumsum(lengths)
        for block, a in enumerate(range(0, len(ids), block_tokens)):
            b = min(len(ids), a + block_tokens)
            i, j = int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, b, side="left"))
            seq = np.arange(i, j + 1)
            first = ends[seq] - lengths[seq]
            inside = np.minimum(ends[seq], b) - np.maximum(first, a)
            piece = np.where((first >= a) & (ends[seq] <= b), -1, np.maximum(first, a) - first)
            payload, marks = encode_block(ids[a:b], freq, start)
            stops = [m[0] * LANES for m in marks[1:]] + [b - a]
            sums = [zlib.crc32(ids[a + m[0] * LANES : a + z].astype("<u4").tobytes()) for m, z in zip(marks, stops, strict=True)]
            values = [part, block, b - a, doc_ids[seq].astype("<i8").tobytes(), seq.astype("<i8").tobytes(), piece.astype("<i8").tobytes(), inside.astype("<i8").tobytes(), payload, [m[0] for m in marks], [m[1] for m in marks], [m[2] for m in marks], sums]
            types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if part != now and held:
                    yield from part_blocks(now, held)
                    held = []
                now = part
                held.append(blob)
        if held:
            yield from part_blocks(now, held)

    parts = packed.filter("part >= 0")
    return parts.repartition(partitions(packed.sparkSession), "part").sortWithinPartitions("part").mapInArrow(run, _BLOCK)


def write(docs: DataFrame, path: str, folder: str, end: int = END, part_docs: int = 8_000, block_tokens: int = BLOCK) -> None:
    """Writes the file set of all documents to folder."""
    spark = docs.sparkSession
    n = docs.count()
    parts = max(1, -(-n // part_docs))
    at = [i / parts for i in range(1, parts)]
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL))
    bounds = docs.agg(F.percentile_approx(ids, at, min(20 * parts, 2_000_000)).alias("q")).first()["q"] if at and n else []
    packed = written(tokens(docs, path, sorted(set(bounds or [])), end), "tokens")
    freq = frequencies(packed)
    used = np.flatnonzero(freq)
    spark.createDataFrame(pd.DataFrame({"token": used.astype(np.int64), "frequency": freq[used].astype(np.int64)}), "token long, frequency long").coalesce(1).write.parquet(f"{folder}/frequencies")
    blocks(packed, freq, block_tokens).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def _tables(spark: SparkSession, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """freq, start and symbol by slot, from the frequency file: a row for each token of the vocabulary at most."""
    rows = spark.read.schema("token long, frequency long").parquet(f"{folder}/frequencies").toPandas()
    freq = np.zeros(int(rows.token.max()) + 1 if len(rows) else 1, np.uint64)
    freq[rows.token.to_numpy()] = rows.frequency.to_numpy().astype(np.uint64)
    start = np.concatenate([np.zeros(1, np.uint64), np.cumsum(freq)[:-1].astype(np.uint64)])
    return freq, start, np.repeat(np.arange(len(freq)), freq.astype(np.int64))


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Pieces of documents, as decoded block by block: part, doc_seq (place in the part), doc_id, at (first token within the document; -1: the piece is the whole document), n_tokens, crc32, and ids unless not asked for. A stretch that fails its checksum raises."""
    freq, start, symbol = _tables(spark, folder)
    schema = "part int, doc_seq long, doc_id long, at long, n_tokens long, crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = []
                for step, word, states, crc in zip(r["steps"], r["words"], r["states"], r["checksums"], strict=True):
                    x = decode_stretch(r["payload"], r["n_tokens"], step, word, states, symbol, freq, start).astype("<u4").tobytes()
                    if zlib.crc32(x) != crc:
                        raise ValueError(f"part {r['part']}, block {r['block']}, step {step}: checksum")
                    ids.append(x)
                raw = b"".join(ids)
                doc_ids, seq, at, n = (np.frombuffer(r[k], "<i8") for k in ("doc_ids", "doc_seq", "doc_piece", "doc_tokens"))
                ends = 4 * np.cumsum(n)
                pieces = [raw[e - 4 * k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                null = pa.array(doc_ids, pa.int64(), mask=doc_ids == _NULL)
                columns = [pa.array(np.full(len(n), r["part"], np.int32)), pa.array(seq), null, pa.array(at), pa.array(n), pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                if with_ids:
                    columns.append(pa.array(pieces, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    fields = _BLOCK.replace(", ", ",\n")
    return spark.read.schema(fields).parquet(f"{folder}/blocks").mapInArrow(run, schema)


def crc32_combine(a: int, b: int, length: int) -> int:
    """The CRC-32 of two stretches joined, from theirs and the second's length in bytes: a is moved on by so many zero bytes."""

    def times(m: list[int], v: int) -> int:
        out = 0
        for row in m:
            if v & 1:
                out ^= row
            v >>= 1
        return out

    zero = [0xEDB88320, *[1 << i for i in range(31)]]
    for _ in range(3):
        zero = [times(zero, r) for r in zero]
    while length:
        if length & 1:
            a = times(zero, a)
        zero, length = [times(zero, r) for r in zero], length >> 1
    return a ^ b


def _join_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, crc = pdf.sort_values("at"), 0
    for c, n in zip(pdf.crc32.tolist(), pdf.n_tokens.tolist(), strict=True):
        crc = crc32_combine(crc, c, 4 * n)
    return pd.DataFrame({"part": pdf.part.iloc[:1], "doc_seq": pdf.doc_seq.iloc[:1], "doc_id": pdf.doc_id.iloc[:1], "n_tokens": [int(pdf.n_tokens.sum())], "crc32": [crc]})


def index(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. Only documents that span blocks are grouped."""
    pieces = written(read(spark, folder, with_ids=False), "pieces")
    spanning = pieces.filter("at >= 0").groupBy("part", "doc_seq").applyInPandas(_join_pieces, "part int, doc_seq long, doc_id long, n_tokens long, crc32 long")
    docs = pieces.filter("at < 0").select("part", "doc_seq", "doc_id", "n_tokens", "crc32").unionByName(spanning)
    totals = docs.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.sum("n_tokens").over(W.partitionBy("part").orderBy("doc_seq")) - F.col("n_tokens")
    return docs.withColumn("inside", inside).join(offsets, "part").select("doc_id", (F.col("offset") + F.col("inside")).cast("long").alias("start"), "n_tokens", F.col("crc32").alias("ids_crc32"))


def round_trip(docs: DataFrame, path: str, folder: str | None = None, block_tokens: int = BLOCK) -> DataFrame:
    """Writes the documents' file set and reads its index back."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/docloom/token-files-{uuid.uuid4().hex}"
    write(docs, path, folder, block_tokens=block_tokens)
    return index(spark, folder)
